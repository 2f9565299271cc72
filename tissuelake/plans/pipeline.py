"""Running requests: a cohort's slides through reading, segmentation, tiling, embedding, pooling and receipts.

Each step ends at a written table (of the store, or of the scratch folder) and the next one starts from it, so that no
plan is larger than a step and a lost executor costs the tasks of one step.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuelake.functions import numerics as N
from tissuelake.functions.geometry import coarsest_level_over, first_level_under
from tissuelake.functions.identity import fingerprint
from tissuelake.functions.pixels import outlined, png, resized, tinted
from tissuelake.operators import multiplex, pooling, regions, segment, stain, tiling
from tissuelake.operators.embed import Embedder, embed
from tissuelake.operators.quality import CLASSES, qc_layer, rule_classes, tiled_classes
from tissuelake.plans import cohort, plugins
from tissuelake.plans.request import SCHEMA_VERSION, Request, run_hash
from tissuelake.plans.resume import bound_elsewhere, complete_models, complete_slide_vectors, complete_slides, complete_tools, missing
from tissuelake.scratch import written
from tissuelake.sources.omezarr import read_slides
from tissuelake.sources.store import Store, names_clash

SEGMENT_MPP = 8.0
GRID = ["slide_id", "grid_key"]
_CELLS = "slide_id string, row int, col int, x long, y long, tissue_frac float, error string"
_ERRORS = "slide_id string, error string"


def slides_of(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A cohort's slides with identities and scales, in a written table; sources of one identity are an error.

    A source that can't be opened is a row with its error.
    """
    named = written(cohort.identified(manifest), "manifest")
    cohort.require_unique(named)
    paths = [r["path"] for r in named.select("path").collect()]  # a cohort's list, not its slides
    found = cohort.calibrated(read_slides(spark, paths), named)
    return written(found.join(named.select("path", "slide_id", "source_uri"), "path"), "slides")


def levels_of(slides: DataFrame) -> DataFrame:
    return slides.select("slide_id", F.explode("levels").alias("l")).select("slide_id", "l.level", "l.ds_x", "l.ds_y", "l.off_x", "l.off_y")


def panel_of(slides: DataFrame) -> DataFrame:
    """slide_id, source_index and source_name of every channel."""
    return slides.where("channel_names is not null").select("slide_id", F.posexplode("channel_names").alias("source_index", "source_name"))


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def output_name(model: Embedder, request: Request) -> str:
    """Under which name an output is stored: the model's, with the settings of a multiplex strategy."""
    if request.multiplex is None:
        return model.name
    settings = {"strategy": request.multiplex, "percentiles": list(request.percentiles), "markers": list(request.markers or []), "bounds_px": request.bounds_px}
    return multiplex.effective_key(model.name, request.aggregation, settings)


def digest_of(model: Embedder, request: Request) -> str:
    made = {"model": model.name, "dim": model.dim, "preprocessing": repr(model.signature()), "amp": request.amp, "stain": request.stain, "half": request.half}
    return fingerprint(made if request.multiplex is None else made | {"output": output_name(model, request)})["digest"]


def base_key(request: Request) -> str:
    return f"mpp{request.mpp:g}_px{request.patch_px}"


def wanted_outputs(store: Store, slides: DataFrame, requests: list[tuple[Request, list[Embedder]]]) -> DataFrame:
    """A row for each output that a cohort's request asks of each slide, of all its geometries."""
    rows = [(store.label(base_key(r), r.grid_hash()), output_name(m, r), digest_of(m, r)) for r, ms in requests for m in ms]
    asked = store.spark.createDataFrame(rows, "grid_key string, model string, digest string")
    own = slides.select("slide_id", "source_uri").withColumns({"config_hash": F.lit(run_hash([r for r, _ in requests])), "output_uri": F.lit(store.path)})
    return own.crossJoin(F.broadcast(asked))  # the request's own few outputs


def whole_models(store: Store, grid_key: str | None = None, slides: DataFrame | None = None) -> DataFrame:
    """The whole outputs of a store, of one grid and some slides if given."""
    some = lambda t: store.table(t, grid_key) if slides is None else store.table(t, grid_key).join(slides.select("slide_id"), "slide_id", "left_semi")
    return complete_models(some("patches"), some("features"), some("outputs"))


def finished_slides(store: Store, slides: DataFrame, requests: list[tuple[Request, list[Embedder]]]) -> DataFrame:
    """slide_ids for which a run of these requests has nothing to do."""
    wanted = wanted_outputs(store, slides, requests)
    keys = {store.label(base_key(r), r.grid_hash()) for r, _ in requests}
    whole = None
    for key in sorted(keys):
        part = whole_models(store, key, slides)
        whole = part if whole is None else whole.unionByName(part)
    return complete_slides(store.raw("receipts"), wanted, whole, store.table("grids"))


def _cells(slides: DataFrame, n: int, request: Request) -> DataFrame:
    """All cells of new grids with their tissue fraction, or a slide's error."""
    if request.no_segmentation:
        rows = tiling.cells(slides.select("slide_id", "xs", "ys"))
        return rows.select("slide_id", "row", "col", "x", "y", F.lit(1.0).cast("float").alias("tissue_frac"), F.lit(None).cast("string").alias("error"))
    columns = ["slide_id", "path", "float_scale", "mpp_level0", "downsamples", "xs", "ys", "level0_patch"]
    if request.multiplex:
        nuclear = multiplex.nuclear_families(panel_of(slides)).withColumnRenamed("channels", "nuclear")
        slides, columns = slides.join(nuclear, "slide_id", "left"), [*columns, "nuclear", "families"]

    def work(s: dict, image: np.ndarray, ds: float, raw: np.ndarray) -> Iterator[pd.DataFrame]:
        if request.multiplex:
            if s["families"] is None or len(s["families"]) != 1:
                raise ValueError("nuclear segmentation needs channels of one nuclear stain")
            mask = segment.segmenter("nuclear", list(s["nuclear"]))(raw)
        else:
            mask = segment.segmenter(request.segmenter)(image)
        for part in segment.zonal(mask.astype(np.uint8), [1], s, ds):
            yield part.rename(columns={"class_1": "tissue_frac"})

    return regions.map_coarse(slides.select(*columns), n, SEGMENT_MPP, work, _CELLS, rgb=not request.multiplex)


def build_grids(store: Store, slides: DataFrame, request: Request, key: str) -> DataFrame:
    """Write the grids that slides lack, header last; errors of slides whose grid can't be made."""
    scaled = slides if request.source_mpp is None else slides.withColumn("mpp_level0", F.coalesce("mpp_level0", F.lit(request.source_mpp)))
    planned = written(tiling.planned_grids(scaled, request.mpp, request.patch_px, request.step_px, tolerance=request.tolerance, snap=request.snap, upsample=request.upsample), "grids")
    unplanned = planned.where("plan is null").select("slide_id", F.concat(F.lit(f"no readable level for {request.mpp:g} micrometres a pixel; the source's scale is "), F.coalesce(F.col("mpp_level0").cast("string"), F.lit("unknown"))).alias("error"))
    good = planned.where("plan is not null")
    n = good.count()
    if not n:
        return unplanned
    cells = written(_cells(good, n, request), "cells")
    broken = cells.where("error is not null").groupBy("slide_id").agg(F.min("error").alias("error"))
    batch, keyed = uuid.uuid4().hex, {"batch": F.lit(None), "grid_key": F.lit(key)}
    keyed["batch"] = F.lit(batch)
    sound = cells.where("error is null")
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    if not request.no_segmentation:
        store.append("cells", sound.select("slide_id", *long("row", "col"), "tissue_frac", N.quantised(F.col("tissue_frac")).alias("mask_u8")).withColumns(keyed))
    patches = plugins.get("patchers", request.patcher)(sound, ["slide_id"], request.threshold)
    store.append("patches", patches.select("slide_id", *long("patch_idx", "x", "y", "row", "col"), "tissue_frac").withColumns(keyed))
    counts = store.raw("patches").where((F.col("grid_key") == key) & (F.col("batch") == batch)).groupBy("slide_id").agg(F.count("*").alias("n_patches"))
    made = good.join(broken, "slide_id", "left_anti").join(counts, "slide_id", "left")
    segmenter = "none" if request.no_segmentation else "nuclear" if request.multiplex else request.segmenter
    store.append("grids", made.select("slide_id", F.lit(request.grid_hash()).alias("grid_hash"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(segmenter).alias("segmenter"), F.lit(float(request.mpp)).alias("target_mpp"), "plan.achieved_mpp", "mpp_level0", "scale_x", "scale_y", "origin_x", "origin_y", F.lit(request.patch_px).alias("patch_px"), F.lit(request.step_px or request.patch_px).alias("step_px"), "level0_patch", "level0_step", F.col("plan.level").alias("read_level"), "plan.read_px", F.coalesce("n_patches", F.lit(0)).cast("long").alias("n_patches"), F.size("ys").cast("long").alias("n_rows"), F.size("xs").cast("long").alias("n_cols"), "source_uri", "channel_names", F.lit(now()).alias("written_utc")).withColumns(keyed))
    return unplanned.unionByName(broken)


def markers_of(slides: DataFrame, n: int, request: Request) -> tuple[DataFrame, DataFrame]:
    """slide_id, position, source_index, low and high of the markers that a slide's patches are cut into, and errors."""
    columns = ["slide_id", "path", "float_scale", "mpp_level0", "downsamples", first_level_under(F.col("levels"), request.bounds_px).cast("int").alias("read_level")]

    def work(s: dict, image: np.ndarray, ds: float, raw: np.ndarray) -> Iterator[pd.DataFrame]:
        bounds = multiplex.image_bounds(raw, *request.percentiles)
        yield pd.DataFrame({"slide_id": s["slide_id"], "source_index": range(len(bounds)), "low": [b[0] for b in bounds], "high": [b[1] for b in bounds]})

    small = slides.select(*columns)
    unbounded = small.where("read_level is null").select("slide_id", F.lit(f"no level has sides of {request.bounds_px} pixels at most").alias("error"))
    found = written(regions.map_coarse(small.where("read_level is not null"), n, SEGMENT_MPP, work, "slide_id string, source_index int, low double, high double, error string", rgb=False), "bounds")
    broken = found.where("error is not null").select("slide_id", "error").unionByName(unbounded)
    bounds, panel = found.where("error is null").drop("error"), panel_of(slides)
    if request.markers:
        chosen = written(multiplex.marker_choices(panel, list(request.markers)), "markers")
        bad = chosen.where("n <> 1").groupBy("slide_id").agg(F.concat(F.lit("markers missing or ambiguous: "), F.array_join(F.array_sort(F.collect_list("marker")), ", ")).alias("error"))
        broken = broken.unionByName(bad)
        chosen = chosen.join(bad, "slide_id", "left_anti").select("slide_id", "position", "source_index")
    else:
        chosen = panel.select("slide_id", F.col("source_index").alias("position"), "source_index")
    return chosen.join(bounds, ["slide_id", "source_index"]).select("slide_id", "position", "source_index", "low", "high"), broken


def stain_fits(slides: DataFrame, n: int, method: str) -> DataFrame:
    """slide_id and fit of each slide's coarse level, from its table of colours."""

    def work(s: dict, image: np.ndarray, ds: float, raw: np.ndarray) -> Iterator[pd.DataFrame]:
        yield stain.colours(image, s["slide_id"])

    table = regions.map_coarse(slides.select("slide_id", "path", "float_scale", "mpp_level0", "downsamples"), n, SEGMENT_MPP, work, f"{stain.COLOURS}, error string")
    return written(stain.fits(written(table.where("error is null").drop("error"), "colours"), method), "stain-fits")


def pixels_of(slides: DataFrame, patches: DataFrame, grids: DataFrame, request: Request, rgb: bool = True) -> DataFrame:
    """Pixels of patches at exactly the request's scale."""
    placed = written(patches.join(grids.select(*GRID, "read_level", "read_px"), GRID).join(slides.select("slide_id", "path", "float_scale"), "slide_id").select("slide_id", "path", "float_scale", "patch_idx", "x", "y", "read_level", F.col("read_px").alias("read_w"), F.col("read_px").alias("read_h")), "windows")
    windows = regions.read_windows(placed, levels_of(slides))
    return regions.read_patches(windows, request.read_block, placed.count(), rgb, request.patch_px)


def embed_grid(store: Store, slides: DataFrame, request: Request, models: list[Embedder], key: str, force: bool) -> DataFrame:
    """Write the outputs that slides' grids lack, commit rows last; errors of slides that couldn't be embedded."""
    spark = store.spark
    own = lambda t: store.table(t, key).join(slides.select("slide_id"), "slide_id", "left_semi")
    names = {output_name(m, request): m for m in models}
    outputs = spark.createDataFrame([(name, digest_of(m, request), m.dim) for name, m in names.items()], "model string, digest string, embedding_dim int")
    grids = written(own("grids"), "own-grids")
    asked = grids.select(*GRID, F.col("batch").alias("grid_batch")).crossJoin(F.broadcast(outputs))  # a request's models
    lacking = written(asked if force else missing(asked, whole_models(store, key, slides)), "lacking")
    todo = {r["model"] for r in lacking.select("model").distinct().collect()}
    if not todo:
        return spark.createDataFrame([], _ERRORS)
    some = written(slides.join(lacking.select("slide_id").distinct(), "slide_id", "left_semi"), "todo-slides")
    n, run = some.count(), [m for name, m in names.items() if name in todo]
    errors = spark.createDataFrame([], _ERRORS)
    pixels = pixels_of(some, store.table("patches", key).join(lacking.select("slide_id").distinct(), "slide_id", "left_semi"), grids, request, rgb=not request.multiplex)
    if request.multiplex:
        markers, errors = markers_of(some, n, request)
        errors = written(errors, "marker-errors")
        vectors = plugins.get("multiplex_strategies", request.multiplex)(pixels, markers, run, request.aggregation, request.half, request.batch)
        named = spark.createDataFrame([(m.name, output_name(m, request)) for m in run], "model string, output string")
        vectors = vectors.join(F.broadcast(named), "model").withColumn("model", F.col("output")).drop("output")
        lacking = written(_with_dims(lacking, vectors, store, request, markers), "lacking-wide") if request.aggregation == "concat" else lacking
    else:
        if request.stain:
            pixels = stain.corrected(pixels, stain_fits(some, n, request.stain))
        vectors = embed(pixels, run, request.half, request.batch)
    batch = uuid.uuid4().hex
    store.append("features", vectors.join(lacking.select("slide_id", "model", "digest", "grid_key"), ["slide_id", "model"]).withColumn("batch", F.lit(batch)))
    failed = store.raw("features").where((F.col("grid_key") == key) & (F.col("batch") == batch) & F.col("error").isNotNull()).groupBy("slide_id").agg(F.min("error").alias("error"))
    errors = written(errors.unionByName(failed).groupBy("slide_id").agg(F.min("error").alias("error")), "embed-errors")
    store.append("outputs", lacking.join(errors, "slide_id", "left_anti").withColumns({"batch": F.lit(batch), "written_utc": F.lit(now())}))
    return errors


def _with_dims(lacking: DataFrame, vectors: DataFrame, store: Store, request: Request, markers: DataFrame) -> DataFrame:
    """lacking whose widths are those of all markers one after the other."""
    n = markers.groupBy("slide_id").agg(F.count("*").cast("int").alias("n_"))
    return lacking.join(n, "slide_id").withColumn("embedding_dim", F.col("embedding_dim") * F.col("n_")).drop("n_")


def run(spark: SparkSession, store: Store, manifest: DataFrame, requests: list[tuple[Request, list[Embedder]]], slide_models: dict[str, str] | None = None, force: bool = False) -> DataFrame:
    """Bring a store up to date with requests over a cohort; slide_id, status and error of each slide.

    What is whole already is left alone; with force it is made anew and replaces what was there. A slide that fails
    gets a receipt with its error and doesn't stop the others. Everything becomes visible by commit rows written last,
    so that a run that stops anywhere can be run again. slide_models: output key to pooling (mean, max or meanmax).
    """
    began = now()
    slides = slides_of(spark, manifest)
    done = spark.createDataFrame([], "slide_id string") if force else written(finished_slides(store, slides, requests), "finished")
    left = written(slides.join(done, "slide_id", "left_anti"), "todo")
    skipped = done.select("slide_id", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    if not left.limit(1).count():
        return skipped
    errors = left.where("error is not null").select("slide_id", "error")
    foreign = bound_elsewhere(store.table("grids"), left)
    clashing = left.join(store.table("grids").select("slide_id", F.col("channel_names").alias("had_")), "slide_id").where(names_clash("had_", "channel_names")).select("slide_id").distinct()
    errors = errors.unionByName(foreign.select("slide_id", F.lit("the store holds another source under this id").alias("error"))).unionByName(clashing.select("slide_id", F.lit("the source's channels were named otherwise").alias("error")))
    errors = written(errors, "errors")
    for request, models in requests:
        key = store.label(base_key(request), request.grid_hash())
        todo = left.join(errors, "slide_id", "left_anti")
        unsound = store.unsound_grids(key, request.grid_hash())
        have = store.table("grids", key).select("slide_id").join(unsound, "slide_id", "left_anti")
        new = todo if force else todo.join(have, "slide_id", "left_anti")
        errors = written(errors.unionByName(build_grids(store, new, request, key)), "errors")
        todo = left.join(errors, "slide_id", "left_anti")
        errors = written(errors.unionByName(embed_grid(store, todo, request, models, key, force)), "errors")
        for name, how in (slide_models or {}).items():
            pool_stored(store, key, name, how, [output_name(m, request) for m in models])
    finished = now()
    failures = errors.groupBy("slide_id").agg(F.min("error").alias("error"))
    names = sorted({output_name(m, r) for r, ms in requests for m in ms})
    dims = {output_name(m, r): m.dim for r, ms in requests for m in ms}
    counts = store.table("patches").groupBy("slide_id").agg(F.count("*").alias("n_patches"))
    receipts = left.drop("error").join(counts, "slide_id", "left").join(failures, "slide_id", "left")
    columns = {"status": F.when(F.col("error").isNull(), "complete").otherwise("failed"), "output_uri": F.lit(store.path), "reader": F.lit("omezarr"), "models": F.array(*map(F.lit, names)), "config_hash": F.lit(run_hash([r for r, _ in requests])), "n_patches": F.coalesce("n_patches", F.lit(0)).cast("long"), "model_dims": F.create_map(*(x for k, v in dims.items() for x in (F.lit(k), F.lit(v)))), "started_utc": F.lit(began), "finished_utc": F.lit(finished), "elapsed_s": F.lit((finished - began).total_seconds()), "schema_version": F.lit(SCHEMA_VERSION)}
    made = written(receipts.withColumns(columns).select("slide_id", "source_uri", "error", *columns), "receipts")
    store.append("receipts", made)
    return made.select("slide_id", "status", "error").unionByName(skipped)


def pool_stored(store: Store, grid_key: str, key: str, how: str, models: list[str] | None = None) -> None:
    """Slide vectors by one pooling of whole models of a grid, of slides that lack them."""
    whole = whole_models(store, grid_key)
    whole = whole if models is None else whole.where(F.col("model").isin(models))
    name = F.concat_ws("_", F.lit(key), F.col("model"))
    have = complete_slide_vectors(store.table("slide_vectors", grid_key), whole).select(*GRID, F.col("patch_model").alias("model"), "output_key")
    lacking = written(whole.withColumn("output_key", name).join(have, [*GRID, "model", "output_key"], "left_anti").drop("output_key"), "to-pool")
    if not lacking.limit(1).count():
        return
    rows = store.features(grid_key).join(lacking, [*GRID, "model", "digest"], "left_semi")
    vectors = plugins.get("slide_embedders", how)(rows, [*GRID, "model", "digest", "batch"])
    store.append("slide_vectors", vectors.select(*GRID, name.alias("output_key"), F.col("model").alias("patch_model"), F.col("digest").alias("patch_digest"), F.col("batch").alias("patch_batch"), F.size("vec").alias("dim"), "vec", F.lit(now()).alias("written_utc")))


def score_quality(spark: SparkSession, store: Store, slides: DataFrame, tool: str = "rules", classify=rule_classes, mpp: float = SEGMENT_MPP, tile: int = 512, force: bool = False) -> DataFrame:
    """A quality layer of all patches of a store's slides, marked complete last; errors of slides that failed.

    Classes come from tiles of a coarse level; a cell's shares from their sums under it. Slides whose layer is whole are left alone.
    """
    grids = store.table("grids").join(slides.select("slide_id"), "slide_id", "left_semi")
    done = complete_tools(store.table("qc"), store.table("patches"), store.table("qc_status")).where(F.col("tool") == tool)
    todo = written(grids if force else grids.join(done, GRID, "left_anti"), "qc-grids")
    n = todo.count()
    if not n:
        return spark.createDataFrame([], _ERRORS)
    axes = slides.join(todo.select(*GRID, "level0_patch", "level0_step"), "slide_id").select("slide_id", "grid_key", "path", "float_scale", "mpp_level0", "downsamples", "level0_patch", tiling.axis(F.col("width"), F.col("level0_patch"), F.col("level0_step")).alias("xs"), tiling.axis(F.col("height"), F.col("level0_patch"), F.col("level0_step")).alias("ys"))

    def work(s: dict, image: np.ndarray, ds: float, raw: np.ndarray) -> Iterator[pd.DataFrame]:
        for part in segment.zonal(tiled_classes(image, classify, tile), list(CLASSES), s, ds):
            yield part.assign(grid_key=s["grid_key"])

    shares = ", ".join(f"class_{k} float" for k in CLASSES)
    found = written(regions.map_coarse(axes, n, mpp, work, f"slide_id string, grid_key string, row int, col int, {shares}, error string"), "qc-cells")
    errors = written(found.where("error is not null").select("slide_id", "error").distinct(), "qc-errors")
    patches = store.table("patches").join(todo.select(*GRID), GRID, "left_semi")
    scored = patches.join(found.where("error is null").select(*GRID, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *(f"class_{k}" for k in CLASSES)), [*GRID, "row", "col"])
    batch = uuid.uuid4().hex
    store.append("qc", qc_layer(scored, tool, CLASSES).withColumn("batch", F.lit(batch)))
    good = todo.join(errors, "slide_id", "left_anti")
    store.append("qc_status", good.select(*GRID, F.lit(tool).alias("tool"), F.lit(True).alias("complete"), F.lit(batch).alias("batch"), F.col("batch").alias("grid_batch"), F.lit(now()).alias("written_utc")))
    return errors


def thumbnail(slides: DataFrame, patches: DataFrame | None = None, mpp: float = SEGMENT_MPP, max_px: int | None = None, segmenter: str | None = None, side: str = "level0_patch") -> DataFrame:
    """slide_id, png and error: the coarse level with tissue tinted and patches outlined.

    With max_px the coarsest level that isn't smaller is read and shrunk to it. The patches of a slide, whose number its
    own area bounds, come to the task that draws it.
    """
    columns = ["slide_id", "path", "float_scale", "mpp_level0", "downsamples"]
    rows = slides.select(*columns, *([coarsest_level_over(F.col("levels"), max_px).cast("int").alias("read_level")] if max_px else []))
    if patches is not None:
        rows = rows.join(patches.groupBy("slide_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.max(side).alias("side")), "slide_id", "left")

    def work(s: dict, image: np.ndarray, ds: float, raw: np.ndarray) -> Iterator[pd.DataFrame]:
        mask = segment.segmenter(segmenter)(image) if segmenter else None
        if max_px and max(image.shape[:2]) > max_px:
            h, w = image.shape[:2]
            square = np.pad(image, ((0, max(h, w) - h), (0, max(h, w) - w), (0, 0)), mode="edge")
            small = lambda v: max(1, round(v * max_px / max(h, w)))
            image, ds = resized(square, max_px)[: small(h), : small(w)], ds * max(h, w) / max_px
            mask = None if mask is None else mask[np.arange(small(h)) * h // small(h)][:, np.arange(small(w)) * w // small(w)]
        if mask is not None:
            image = tinted(image, mask, (0, 160, 0))
        at = lambda v: int(round(v / ds))
        places = zip(s["xs"], s["ys"], strict=True) if s.get("xs") is not None else ()
        yield pd.DataFrame({"slide_id": [s["slide_id"]], "png": [png(outlined(image, [(at(x), at(y), at(s["side"]), at(s["side"])) for x, y in places], (200, 0, 0)))]})

    return regions.map_coarse(rows, 1 if slides.isEmpty() else slides.count(), mpp, work, "slide_id string, png binary, error string")
