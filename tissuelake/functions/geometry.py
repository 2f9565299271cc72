"""Exact-scale read planning and tiling as column expressions over a slide's pyramid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tissuelake.functions.numerics import half_even

#: Relative difference under which a resample factor counts as one.
EXACT = 1e-6


def level_mpps(mpp0: Column, downsamples: Column) -> Column:
    return F.transform(downsamples, lambda d: mpp0 * d)


def nearest_level(mpp0: Column, downsamples: Column, target: Column) -> Column:
    """The level nearest to the target scale; of equally near ones the finest."""
    ranked = F.transform(level_mpps(mpp0, downsamples), lambda m, i: F.struct(F.abs(m - target).alias("off"), i.alias("level")))
    return F.array_min(ranked)["level"]


def _sides(levels: Column, when) -> Column:
    """The first level (largest of its sides given to when) for which when holds; null if there is none."""
    return F.array_min(F.transform(levels, lambda l, i: F.when(when(F.greatest(l["width"], l["height"])), i)))


def coarsest_level_over(levels: Column, px: Column | int) -> Column:
    """The last level, from the finest on, whose longer side is still px at least; 0 if already the first one's isn't."""
    return F.greatest(F.coalesce(_sides(levels, lambda side: side < px), F.size(levels)) - 1, F.lit(0))


def first_level_under(levels: Column, px: Column | int) -> Column:
    """The finest level whose longer side is px at most; null if there is none."""
    return _sides(levels, lambda side: side <= px)


def read_plan(target: Column, mpp0: Column, downsamples: Column, patch_px: Column, tolerance: float = 0.001, snap: bool = False, upsample: bool = False) -> Column:
    """Level, scales and read size of a patch at exactly the target scale, as a struct; null where it can't be read.

    The coarsest level not coarser than the target (within the tolerance) is read, and resampled unless it lies
    within the tolerance. snap takes the nearest level as it is. upsample allows targets finer than level 0. An
    unknown scale (null) gives null; require_plan() turns that into an error.
    """
    close = max(tolerance, EXACT)
    mpps = level_mpps(mpp0, downsamples)
    last = F.array_max(F.transform(mpps, lambda m, i: F.when(m <= target * (1 + close), i)))
    level = nearest_level(mpp0, downsamples, target) if snap else F.coalesce(last, F.lit(0)) if upsample else last
    level_mpp = F.get(mpps, level)
    resample = target / level_mpp
    native = F.lit(True) if snap else (F.abs(level_mpp - target) <= close * target) | (F.abs(resample - 1) <= EXACT)
    plan = F.struct(
        level.cast("int").alias("level"),
        level_mpp.alias("level_mpp"),
        target.cast("double").alias("target_mpp"),
        F.when(native, level_mpp).otherwise(target).alias("achieved_mpp"),
        resample.alias("resample"),
        F.when(native, patch_px.cast("long")).otherwise(half_even(patch_px * resample)).alias("read_px"),
        (~native).alias("needs_resample"),
    )
    return F.when(level.isNotNull() & (target > 0) & (mpp0 > 0) & (patch_px > 0), plan)


def require_plan(plan: Column, target: Column) -> Column:
    """The plan, or an error where there is none."""
    message = F.concat(F.lit("no readable level for a target of "), F.coalesce(target.cast("string"), F.lit("unknown")), F.lit(" micrometres a pixel; give the source's scale or allow upsampling"))
    return F.when(plan.isNull(), F.raise_error(message)).otherwise(plan)


def level0_px(px: Column, mpp: Column, mpp0: Column) -> Column:
    """A side or step in output pixels at a scale, in level-0 pixels."""
    return half_even(px * mpp / mpp0)


def axis(extent: Column, patch: Column, step: Column) -> Column:
    """Starts of all patches along an axis; a slide smaller than a patch has one."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(extent - patch, F.lit(0)).cast("long"), step.cast("long"))


def mapped(level0: Column, downsample: Column, offset: Column) -> Column:
    """A level-0 coordinate as an index of a level."""
    return half_even(level0 / downsample + offset)


def magnification(mpp: Column) -> Column:
    return F.when(mpp > 0, F.bround(F.lit(10.0) / mpp, 1))


def slide_mpp(scale_x: Column, scale_y: Column) -> Column:
    """One scale from the two axes."""
    return (scale_x + scale_y) / 2


def anisotropic(scale_x: Column, scale_y: Column) -> Column:
    return F.abs(scale_x - scale_y) / F.least(scale_x, scale_y) > 1e-3


def scale_mismatch(target: Column, recommended: Column) -> Column:
    return F.abs(target - recommended) / recommended > 0.1


def to_micrometres(unit: Column) -> Column:
    """Factor of a length unit; 1 for an unknown one, null for a missing one."""
    # Fixed values.
    factors = {"nanometer": 1e-3, "nm": 1e-3, "micrometer": 1.0, "micron": 1.0, "um": 1.0, "µm": 1.0, "millimeter": 1e3, "mm": 1e3, "centimeter": 1e4, "cm": 1e4, "meter": 1e6, "m": 1e6}
    table = F.create_map(*(F.lit(x) for pair in factors.items() for x in pair))
    return F.when(unit.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(unit)), F.lit(1.0)))
