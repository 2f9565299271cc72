"""Masks and class rasters as pixel tables: thresholds, fusion and zonal aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.functions.numerics import half_even


def otsu(pixels: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys and threshold: the 8-bit level of greatest variance between the classes; foreground is above it.

    The histogram has 256 levels a group, whatever the number of pixels; the window runs over it alone.
    """
    levels = pixels.groupBy(*keys, F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    below = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    moments = levels.select(*keys, "v", F.sum("n").over(below).alias("w0"), F.sum(F.col("v") * F.col("n")).over(below).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("v") * F.col("n")).over(whole).alias("s"))
    w0, w1 = F.col("w0").cast("double"), (F.col("w") - F.col("w0")).cast("double")
    between = F.when(w1 > 0, w0 * w1 * F.pow(F.col("s0") / w0 - (F.col("s") - F.col("s0")) / w1, 2)).otherwise(0.0)
    best = moments.withColumn("between", F.round(between, 4))
    return best.groupBy(*keys).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def fused(a: DataFrame, b: DataFrame, keys: list[str], mode: str = "or") -> DataFrame:
    """Two masks' pixels joined: v is 1 where either (or) or both (and) have tissue."""
    if mode not in ("or", "and"):
        raise ValueError(f"mode must be 'or' or 'and', not {mode!r}")
    both = a.select(*keys, F.col("v").alias("va")).join(b.select(*keys, F.col("v").alias("vb")), keys, "full" if mode == "or" else "inner")
    hit = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return both.select(*keys, (hit("va") | hit("vb") if mode == "or" else hit("va") & hit("vb")).cast("int").alias("v"))


def class_fractions(patches: DataFrame, class_px: DataFrame, keys: list[str], classes: list[int], side: Column, downsample: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """For each patch, the share of its footprint on the raster that each class has; 0 off the raster.

    class_px: keys, rx, ry, cls, one row a pixel. The footprint is clipped to the raster, not padded.
    """
    n = F.greatest(F.lit(1), half_even(side / downsample))
    rx, ry = half_even((F.col("x") - origin[0]) / downsample), half_even((F.col("y") - origin[1]) / downsample)
    own = [c for c in (*keys, "grid_key") if c in patches.columns]  # patch numbers are a grid's
    rows = patches.select(*own, "patch_idx", rx.alias("rx0"), n.alias("n"), F.explode(F.sequence(ry, ry + n - 1)).alias("ry"))
    spread = rows.select(*own, "patch_idx", "ry", F.explode(F.sequence(F.col("rx0"), F.col("rx0") + F.col("n") - 1)).alias("rx"))
    share = lambda k: (F.count_if(F.col("cls") == k) / F.count("*")).cast("float").alias(f"class_{k}")
    found = spread.join(class_px, [*keys, "rx", "ry"]).groupBy(*own, "patch_idx").agg(*map(share, classes))
    return patches.join(found, [*own, "patch_idx"], "left").fillna(0.0, [f"class_{k}" for k in classes])
