"""Tiling grids: cells, tissue fractions, the tissue filter and row-major numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.functions.geometry import axis, level0_px, read_plan, require_plan
from tissuelake.functions.numerics import at_least, half_even

GRID = ["slide_id", "grid_key"]


def planned_grids(slides: DataFrame, target_mpp: float, patch_px: int, step_px: int | None = None, **plan: object) -> DataFrame:
    """One grid a slide, with a null plan where the scale can't be read. slides: slide_id, mpp_level0, downsamples, width, height."""
    target = F.lit(float(target_mpp))
    planned = slides.withColumn("plan", read_plan(target, F.col("mpp_level0"), F.col("downsamples"), F.lit(patch_px), **plan))
    achieved = F.col("plan.achieved_mpp")
    sized = planned.withColumn("level0_patch", level0_px(F.lit(patch_px), achieved, F.col("mpp_level0"))).withColumn("level0_step", level0_px(F.lit(step_px or patch_px), achieved, F.col("mpp_level0")))
    return sized.withColumn("xs", axis(F.col("width"), F.col("level0_patch"), F.col("level0_step"))).withColumn("ys", axis(F.col("height"), F.col("level0_patch"), F.col("level0_step")))


def grids(slides: DataFrame, target_mpp: float, patch_px: int, step_px: int | None = None, **plan: object) -> DataFrame:
    """Like planned_grids(); an unreadable scale is an error."""
    planned = planned_grids(slides, target_mpp, patch_px, step_px, **plan)
    return planned.withColumn("plan", require_plan(F.col("plan"), F.col("mpp_level0")))


def cells(grid: DataFrame) -> DataFrame:
    """All cells of grids with xs and ys: row, col, x, y."""
    keys = [c for c in grid.columns if c not in ("xs", "ys")]
    rows = grid.select(*keys, "xs", F.posexplode("ys").alias("row", "y"))
    return rows.select(*keys, "row", "y", F.posexplode("xs").alias("col", "x"))


def cell_fractions(cell: DataFrame, mask_px: DataFrame, keys: list[str], downsample: str = "mask_downsample", side: str = "level0_patch") -> DataFrame:
    """cell with tissue_frac: the mean of the mask under the cell, clipped to the mask; 0 where there is none.

    mask_px: keys, mx, my, v. The window of a cell becomes the pixels it covers, an equi-join with the mask and a
    partial sum, so that neither side is gathered.
    """
    ds = F.col(downsample)
    n = F.greatest(F.lit(1), half_even(F.col(side) / ds))
    mx, my = half_even(F.col("x") / ds), half_even(F.col("y") / ds)
    covered = cell.select(*keys, "row", "col", F.explode(F.sequence(my, my + n - 1)).alias("my"), mx.alias("mx0"), n.alias("n")).select(*keys, "row", "col", "my", F.explode(F.sequence(F.col("mx0"), F.col("mx0") + F.col("n") - 1)).alias("mx"))
    mean = covered.join(mask_px, [*keys, "mx", "my"]).groupBy(*keys, "row", "col").agg(F.avg(F.col("v").cast("double")).cast("float").alias("tissue_frac"))
    return cell.join(mean, [*keys, "row", "col"], "left").withColumn("tissue_frac", F.coalesce("tissue_frac", F.lit(0.0).cast("float")))


def keep_tissue(cell: DataFrame, threshold: float = 0.1) -> DataFrame:
    return cell.where(at_least(F.col("tissue_frac"), threshold))


def numbered(cell: DataFrame, keys: list[str]) -> DataFrame:
    """patch_idx of kept cells, row by row from 0: the identity that all 1:1 tables join on."""
    return cell.withColumn("patch_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("row", "col")) - 1)


def kept(cell: DataFrame, keys: list[str], threshold: float = 0.1) -> DataFrame:
    """Numbered patches of the cells with enough tissue: the patcher of runs."""
    return numbered(keep_tissue(cell, threshold), keys)


def tile(grid: DataFrame, mask_px: DataFrame | None, keys: list[str], threshold: float = 0.1) -> DataFrame:
    """Kept patches of grids. Without a mask all cells stay, at fraction 1."""
    every = cells(grid)
    found = every.withColumn("tissue_frac", F.lit(1.0).cast("float")) if mask_px is None else keep_tissue(cell_fractions(every, mask_px, keys), threshold)
    return numbered(found, keys)
