"""Command line: info, sample, embed, embed-many, slide-embed, verify, quality, validate, compare, export, thumbnail, models."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from tissuelake.operators.embed import HistogramEmbedder, MeanEmbedder, ProjectionEmbedder
from tissuelake.plans import cohort, conformance, pipeline, plugins, registry
from tissuelake.plans.request import Request
from tissuelake.plans.resume import receipt_totals
from tissuelake.session import local_session
from tissuelake.sources import export
from tissuelake.sources.files import stores_below
from tissuelake.sources.omezarr import Image, write_sample
from tissuelake.sources.store import Store
from tissuelake.sources.text import read_extractions, read_manifest

EMBEDDERS = {"mean": lambda: MeanEmbedder("mean"), "histogram": lambda: HistogramEmbedder("histogram", 24), "projection": lambda: ProjectionEmbedder("projection", 32)}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tissuelake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [x := sub.add_parser(name), *(x.add_argument(a) for a in args)][0]
    add("info", "slide")
    s = add("sample", "path")
    s.add_argument("--size", type=int, default=1024)
    s.add_argument("--mpp", type=float, default=0.5)
    for name in ("embed", "embed-many", "verify"):
        e = add(name, "slides", "store")
        e.add_argument("--model", action="append", default=None)
        e.add_argument("--plan")
        e.add_argument("--mpp", type=float)
        e.add_argument("--patch-px", type=int)
        e.add_argument("--step-px", type=int)
        e.add_argument("--source-mpp", type=float)
        e.add_argument("--segmenter", default="otsu")
        e.add_argument("--multiplex")
        e.add_argument("--marker", action="append", default=None)
        e.add_argument("--aggregation", default="mean", choices=("mean", "concat"))
        e.add_argument("--sink", default="parquet")
        e.add_argument("--model-options", default="{}", type=registry.json_object)
        e.add_argument("--no-seg", action="store_true")
        e.add_argument("--stain", choices=("macenko", "reinhard", "vahadane"))
        e.add_argument("--pool", action="append", default=[], choices=("mean", "max", "meanmax"))
        e.add_argument("--read-block", type=int, default=8)
        e.add_argument("--shard-index", type=int, default=0)
        e.add_argument("--shard-count", type=int, default=1)
        e.add_argument("--force", action="store_true")
    add("validate", "store")
    se = add("slide-embed", "store")
    se.add_argument("--pool", action="append", required=True, choices=("mean", "max", "meanmax"))
    se.add_argument("--grid")
    add("quality", "slides", "store")
    add("compare", "a", "b")
    x = add("export", "store", "out")
    x.add_argument("--layout", default="trident", choices=(*export.LAYOUTS, "tiles", "geojson"))
    x.add_argument("--grid")
    x.add_argument("--model", action="append")
    x.add_argument("--overwrite", action="store_true")
    add("thumbnail", "slide", "out").add_argument("--max-px", type=int)
    add("models")
    return p


def _requests(spark, a) -> list[tuple[Request, list]]:
    plan = read_extractions(spark, a.plan) if a.plan else None
    groups = registry.geometries(a.model or ["mean"], a.mpp, a.patch_px, plan)
    options = {"multiplex": a.multiplex, "markers": tuple(a.marker) if a.marker else None, "aggregation": a.aggregation}
    embedder = lambda m: EMBEDDERS[m]() if m in EMBEDDERS and not a.model_options else plugins.get("embedders", m)(m, **a.model_options)
    return [(Request(g.models, g.mpp, g.patch_px, a.step_px, a.segmenter, no_segmentation=a.no_seg, source_mpp=a.source_mpp, stain=a.stain, read_block=a.read_block, **options), [embedder(m) for m in g.models]) for g in groups]


def _manifest(spark, a):
    if a.command == "embed":
        return spark.createDataFrame([(a.slides, a.source_mpp)], "path string, source_mpp double")
    found = _listed(spark, a.slides, a.source_mpp) if not a.slides.endswith((".csv", ".txt", ".tsv")) else read_manifest(spark, a.slides)
    named = cohort.identified(found)
    cohort.require_unique(named)  # of the whole cohort, before it is cut into shards
    return cohort.strided(named, a.shard_index, a.shard_count).select("path", "source_mpp")


def _listed(spark, folder, source_mpp=None):
    return spark.createDataFrame([(p, source_mpp) for p in stores_below(spark, folder)], "path string, source_mpp double")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "models":
        for m in (registry.BUILT_IN | registry.PUBLISHED).values():
            print(f"{m.name}\t{m.dim}\t{m.mpp or registry.DEFAULT_MPP}\t{m.px}")
        return 0
    if a.command == "sample":
        print(write_sample(a.path, a.mpp, a.size))
        return 0
    if a.command == "info":
        image = Image(a.slide)
        print(f"{image.levels[0][1]} x {image.levels[0][2]} px, {image.mpp} micrometres a pixel, {image.channels} channels {image.names or ''}")
        for level, w, h, dx, dy, *_ in image.levels:
            print(f"  level {level}: {w} x {h}, downsample {dx:g} x {dy:g}")
        return 0
    spark = local_session()
    try:
        return _run(spark, a)
    finally:
        spark.stop()


def _run(spark, a) -> int:
    if a.command in ("embed", "embed-many"):
        done = pipeline.run(spark, plugins.get("sinks", a.sink)(spark, a.store), _manifest(spark, a), _requests(spark, a), {p: p for p in a.pool}, a.force)
        totals = {r["status"]: r["n"] for r in receipt_totals(done).collect()}
        for r in done.where("error is not null").orderBy("slide_id").limit(100).collect():
            print(f"{r['slide_id']}: {r['error']}", file=sys.stderr)
        print(", ".join(f"{n} {s}" for s, n in sorted(totals.items())))
        return int("failed" in totals)
    if a.command == "verify":
        store, requests = Store(spark, a.store), _requests(spark, a)
        slides = cohort.identified(_manifest(spark, a))
        lacking = [r[0] for r in slides.select("slide_id").join(pipeline.finished_slides(store, slides, requests), "slide_id", "left_anti").collect()]
        print("complete" if not lacking else "incomplete: " + ", ".join(sorted(lacking)))
        return int(bool(lacking))
    if a.command == "validate":
        s = Store(spark, a.store)
        found = conformance.violations(s.table("grids"), s.table("patches"), s.features(), s.table("outputs"), s.table("cells"), s.table("slide_vectors"), s.table("qc")).limit(1000).collect()
        for r in found:
            print(f"{r['slide_id']} {r['grid_key']}: {r['violation']}")
        return int(bool(found))
    if a.command == "slide-embed":
        s = Store(spark, a.store)
        key = s.grid(a.grid)
        for how in a.pool:
            pipeline.pool_stored(s, key, how, how)
        return 0
    if a.command == "quality":
        errors = pipeline.score_quality(spark, Store(spark, a.store), pipeline.slides_of(spark, _listed(spark, a.slides))).limit(100).collect()
        for r in errors:
            print(f"{r['slide_id']}: {r['error']}", file=sys.stderr)
        return int(bool(errors))
    if a.command == "compare":
        keys = ["slide_id", "grid_key", "patch_idx"]
        rows = conformance.compared(Store(spark, a.a).features(), Store(spark, a.b).features(), keys).collect()
        for r in rows:
            print(f"{r['model']}: {'equal' if r['ok'] else 'different'}, largest difference {r['max_abs_diff']}")
        return int(not rows or not all(r["ok"] for r in rows))
    if a.command == "export":
        s = Store(spark, a.store)
        key = s.grid(a.grid)
        own = lambda t: s.table(t, key)
        if a.layout == "tiles":
            export.tiles(own("patches"), own("grids")).join(export.observations(own("patches"), own("grids"), own("cells")), ["slide_id", "grid_key", "patch_idx"]).write.mode("overwrite" if a.overwrite else "error").parquet(a.out)
        elif a.layout == "geojson":
            sized = own("patches").join(own("grids").select("slide_id", "level0_patch"), "slide_id")
            export.write_geojson(sized, F.col("level0_patch"), a.out, a.overwrite)
        else:
            f = s.features(key)
            models = export.selected_models(f, a.model)
            export.write_layout(export.layout(own("patches"), f.where(F.col("model").isin(models)), own("grids"), a.layout), a.out, a.overwrite)
        return 0
    slides = pipeline.slides_of(spark, spark.createDataFrame([(a.slide, None)], "path string, source_mpp double"))
    drawn = pipeline.thumbnail(slides, max_px=a.max_px).first()
    if drawn["error"]:
        raise SystemExit(drawn["error"])
    part = f"{a.out}.part"
    with open(part, "wb") as f:
        f.write(drawn["png"])
    os.replace(part, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
