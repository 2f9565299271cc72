"""Multiplex panels: selection, normalisation and aggregation of markers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuelake.functions.identity import canonical_json
from tissuelake.functions.names import identity, marker_candidates, marker_name, nuclear_kind
from tissuelake.operators.embed import embed

# Ranges of integer pixel types.
RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295), "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647), "bool": (0, 1)}


def percentile_bounds(pixels: DataFrame, keys: list[str], value: str, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """keys, low and high: exact linear percentiles of each marker. For bounded levels: it holds distinct values."""
    return pixels.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low / 100), F.lit(high / 100))).alias("p")).select(*keys, F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))


def type_bounds(pixels: DataFrame, keys: list[str], value: str, dtype: str) -> DataFrame:
    """keys, low and high from the pixel type; floats must lie in [0, 1]."""
    if dtype in RANGES:
        low, high = RANGES[dtype]
        return pixels.select(*keys).distinct().select(*keys, F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    seen = pixels.groupBy(*keys).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    fit = (F.col("lo_") >= 0) & (F.col("hi_") <= 1)
    return seen.select(*keys, F.when(fit, 0.0).otherwise(F.raise_error(F.lit("floating-point pixels must lie in [0, 1]")).cast("double")).alias("low"), F.lit(1.0).alias("high"))


def require_bounds(bounds: DataFrame) -> DataFrame:
    """bounds in single precision, or an error where a range is empty or not finite."""
    low, high = F.col("low").cast("float"), F.col("high").cast("float")
    bad = low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high) | (high <= low)
    return bounds.withColumn("low", F.when(bad, F.raise_error(F.lit("a marker's normalisation range is degenerate")).cast("float")).otherwise(low)).withColumn("high", high)


def unit_interval(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def normalised(pixels: DataFrame, bounds: DataFrame, keys: list[str], value: str, as_uint8: bool = False) -> DataFrame:
    """pixels with unit: each value between its marker's bounds on [0, 1], or rounded to 0..255."""
    joined = pixels.join(bounds, keys)
    unit = unit_interval(F.col(value), F.col("low"), F.col("high"))
    return joined.withColumn("unit", F.rint(unit * 255).cast("short") if as_uint8 else unit)


def marker_choices(panel: DataFrame, requested: list[str]) -> DataFrame:
    """slide_id, position, marker, n (channels of that name), source_index and source_name of the requested markers.

    panel: slide_id, source_index, source_name. Names are compared by identity (form, case and outer spaces don't matter).
    """
    wanted = panel.sparkSession.createDataFrame(list(enumerate(requested)), "position int, marker string").withColumn("id_", identity("marker"))
    named = panel.withColumn("id_", identity("source_name"))
    slides = panel.select("slide_id").distinct().crossJoin(F.broadcast(wanted))
    return slides.join(named, ["slide_id", "id_"], "left").groupBy("slide_id", "position", "marker").agg(F.count("source_index").alias("n"), F.min("source_index").alias("source_index"), F.min("source_name").alias("source_name"))


def selected(panel: DataFrame, requested: list[str]) -> DataFrame:
    """The panel's channels of the requested markers in request order; a missing or ambiguous one is an error."""
    error = F.raise_error(F.concat(F.lit("marker "), "marker", F.lit(" is missing or ambiguous"))).cast("int")
    return marker_choices(panel, requested).withColumn("source_index", F.when(F.col("n") == 1, F.col("source_index")).otherwise(error)).drop("n")


def resolved_markers(panel: DataFrame, vocabulary: DataFrame, name: str = "source_name") -> DataFrame:
    """panel with marker_id: the vocabulary's entry of each channel by its name, a synonym or a CD token in it.

    vocabulary: marker, marker_id. Candidates carry their priority, and the first that the vocabulary has wins.
    """
    tried = panel.withColumn("candidates_", marker_candidates(marker_name(F.col(name))))
    keys = panel.columns
    joined = tried.select(*keys, F.posexplode_outer("candidates_").alias("try_", "marker")).join(vocabulary, "marker", "left")
    return joined.groupBy(*keys).agg(F.min(F.when(F.col("marker_id").isNotNull(), F.struct("try_", "marker", "marker_id"))).alias("m")).select(*keys, "m.marker", "m.marker_id")


def nuclear_families(panel: DataFrame) -> DataFrame:
    """slide_id, channels (in source order) and families of the nuclear stains that each slide has."""
    kinds = panel.withColumn("kind_", nuclear_kind(identity("source_name"))).where("kind_ is not null")
    return kinds.groupBy("slide_id").agg(F.array_sort(F.collect_list("source_index")).alias("channels"), F.array_sort(F.collect_set("kind_")).alias("families"))


def nuclear_channels(panel: DataFrame) -> DataFrame:
    """slide_id, channels and family; several stain families in one slide are an error."""
    error = F.raise_error(F.lit("nuclear segmentation needs one stain family")).cast("string")
    return nuclear_families(panel).select("slide_id", "channels", F.when(F.size("families") == 1, F.get("families", F.lit(0))).otherwise(error).alias("family"))


def nuclear_mean(pixels: DataFrame, channels: DataFrame) -> DataFrame:
    """One nuclear signal a pixel: the mean of the slide's nuclear channels in single precision."""
    wanted = channels.select("slide_id", F.explode("channels").alias("c"))
    return pixels.join(F.broadcast(wanted), ["slide_id", "c"]).groupBy("slide_id", "y", "x").agg(F.avg(F.col("v").cast("float")).cast("float").alias("v"))


def aggregated(marker_vectors: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """One vector a patch from those of its markers: their mean, or one after the other in marker order."""
    if how == "concat":
        return marker_vectors.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "vec"))), lambda s: s["vec"])).alias("vec"))
    if how != "mean":
        raise ValueError(f"unknown aggregation {how!r}")
    from tissuelake.operators.pooling import mean_pool

    return mean_pool(marker_vectors, keys)


def named_channels(panel: DataFrame, names: list[str]) -> DataFrame:
    """panel with blank source names filled from a complete positional list; a different name or count is an error."""
    spark = panel.sparkSession
    given = spark.createDataFrame(list(enumerate(names)), "source_index int, given_ string")
    joined = panel.join(F.broadcast(given), "source_index", "full")
    clash = (F.col("source_name") != "") & (identity("source_name") != identity("given_"))
    wrong = F.col("slide_id").isNull() | F.col("given_").isNull() | clash
    named = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("channel names don't fit the source's")).cast("string")).when(F.coalesce("source_name", F.lit("")) == "", F.col("given_")).otherwise(F.col("source_name"))
    return joined.select("slide_id", "source_index", named.alias("source_name"))


def standardised(unit: Column, mean: Column, std: Column) -> Column:
    """A marker's unit-interval value by the vocabulary's statistics."""
    return (unit - mean) / std


def effective_key(model: str, how: str, settings: dict) -> str:
    """Name of a channelwise output; other settings give another name."""
    return f"{model}__channelwise_{how}_{hashlib.sha256(canonical_json(settings).encode()).hexdigest()[:16]}"


def image_bounds(image: np.ndarray, low: float, high: float) -> list[tuple[float, float]]:
    """Exact linear percentiles of each channel of one image; an empty range is an error."""
    out = [tuple(float(np.float32(v)) for v in np.percentile(image[..., c], [low, high])) for c in range(image.shape[-1])]
    if bad := [c for c, (a, b) in enumerate(out) if not (np.isfinite(a) and np.isfinite(b) and a < b)]:
        raise ValueError(f"the normalisation range of channels {bad} is degenerate")
    return out


def marker_images(patches: DataFrame, markers: DataFrame) -> DataFrame:
    """One RGB patch a marker: its channel between its bounds on 0..255, repeated three times.

    patches: native pixels as read. markers: slide_id, position, source_index, low, high; a few rows a slide, gathered to
    an array and joined by slide. Patches that couldn't be read keep their error, once for each marker.
    """
    own = markers.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("position", "source_index", "low", "high"))).alias("markers"))
    patches = patches if "error" in patches.columns else patches.withColumn("error", F.lit(None).cast("string"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                image = None if r.pixels is None else np.frombuffer(r.pixels, r.dtype).reshape(r.height, r.width, r.channels)
                for m in r.markers:
                    pixels = None
                    if image is not None:
                        low, high = np.float32(m["low"]), np.float32(m["high"])
                        unit = np.clip((image[..., m["source_index"]].astype(np.float32) - low) / (high - low), 0, 1)
                        pixels = np.repeat(np.rint(unit * 255).astype(np.uint8)[..., None], 3, axis=2).tobytes()
                    rows.append((r.slide_id, r.patch_idx, m["position"], r.height, r.width, 3, "uint8", pixels, r.error))
            yield pd.DataFrame(rows, columns=["slide_id", "patch_idx", "position", "height", "width", "channels", "dtype", "pixels", "error"])

    return patches.join(own, "slide_id").mapInPandas(run, "slide_id string, patch_idx long, position int, height int, width int, channels int, dtype string, pixels binary, error string")


def embed_markers(patches: DataFrame, markers: DataFrame, models: list, how: str = "mean", half: bool = True, batch: int = 256) -> DataFrame:
    """slide_id, patch_idx, model, vec and error of native patches: each marker embedded as RGB, then aggregated."""
    images = marker_images(patches, markers)
    # A marker's image is a patch of its own; its number tells patch and marker apart.
    wide = images.withColumn("patch_idx", F.col("patch_idx") * 4096 + F.col("position")).drop("position")
    vectors = embed(wide, models, half, batch).withColumn("position", (F.col("patch_idx") % 4096).cast("int")).withColumn("patch_idx", F.expr("patch_idx div 4096"))
    keys = ["slide_id", "patch_idx", "model"]
    # One pass over the embedded rows: a patch's few marker vectors meet and are joined, or their first error is kept.
    gathered = vectors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "vec"))).alias("m"), F.min("error").alias("error"))
    if how == "concat":
        joined = F.flatten(F.transform("m", lambda s: s["vec"]))
    elif how == "mean":
        width = F.size(F.get("m", F.lit(0))["vec"])
        total = F.transform(F.sequence(F.lit(0), width - 1), lambda d: F.aggregate("m", F.lit(0.0), lambda acc, s: acc + F.get(s["vec"], d).cast("double")))
        joined = F.transform(total, lambda v: (v / F.size("m")).cast("float"))
    else:
        raise ValueError(f"unknown aggregation {how!r}")
    return gathered.select(*keys, F.when(F.col("error").isNull(), joined).alias("vec"), "error")
