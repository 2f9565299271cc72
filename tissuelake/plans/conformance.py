"""Violations of a store's contract, and differences between stores, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuelake.functions.vectors import within

GRID = ["slide_id", "grid_key"]
OUT = [*GRID, "violation"]


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).alias("violation")


def violations(grids: DataFrame, patches: DataFrame, features: DataFrame, outputs: DataFrame, cells: DataFrame | None = None, slide_vectors: DataFrame | None = None, qc: DataFrame | None = None) -> DataFrame:
    """slide_id, grid_key and violation; no rows for a conforming store.

    Checked: known version, header counts, unique and contiguous patch numbers from 0, one vector a patch and model,
    the declared width, declared models present and present models declared, digests on both sides alike, row and
    column within the grid, one slide vector an output, and quality scores 1:1 with patches.
    """
    n = patches.groupBy(*GRID).agg(F.count("*").alias("n"), F.min("patch_idx").alias("low"), F.max("patch_idx").alias("high"), F.count_distinct("patch_idx").alias("different"))
    counted = grids.join(n, GRID, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sized = features.groupBy(*GRID, "model").agg(F.count("*").alias("rows"), F.count_distinct("patch_idx").alias("different"), F.min(F.size("vec")).alias("narrow"), F.max(F.size("vec")).alias("wide"), F.max("digest").alias("own"))
    with_n = sized.join(counted.select(*GRID, "n"), GRID)
    declared = outputs.select(*GRID, "model", "embedding_dim", F.col("digest").alias("told"))
    found = [
        counted.where("schema_version is null or schema_version <> '0.1'").select(*GRID, _say("unknown schema_version ", F.col("schema_version"))),
        counted.where("n_patches is not null and n_patches <> n").select(*GRID, _say("header n_patches ", F.col("n_patches"), " but ", F.col("n"), " patches")),
        counted.where("n > 0 and (low <> 0 or high <> n - 1 or different <> n)").select(*GRID, _say("patch_idx must number the patches from 0")),
        patches.join(grids.select(*GRID, "n_rows", "n_cols"), GRID).where("row < 0 or col < 0 or row >= n_rows or col >= n_cols").groupBy(*GRID).agg(F.count("*").alias("k")).select(*GRID, _say(F.col("k"), " patches lie off the grid")),
        with_n.where("rows <> n or different <> rows").select(*GRID, _say("features/", F.col("model"), " has ", F.col("rows"), " rows for ", F.col("n"), " patches")),
        with_n.where("narrow <> wide").select(*GRID, _say("features/", F.col("model"), " has vectors of different widths")),
        with_n.join(declared, [*GRID, "model"]).where("narrow = wide and wide <> embedding_dim").select(*GRID, _say("features/", F.col("model"), " width ", F.col("wide"), " but declared ", F.col("embedding_dim"))),
        sized.join(declared, [*GRID, "model"]).where("not (own <=> told)").select(*GRID, _say("features/", F.col("model"), " digest differs from the declared one")),
        declared.join(sized, [*GRID, "model"], "left_anti").join(counted.where("n > 0"), GRID, "left_semi").select(*GRID, _say("declared model ", F.col("model"), " has no features")),
        sized.join(declared, [*GRID, "model"], "left_anti").select(*GRID, _say("features/", F.col("model"), " is not declared")),
        patches.join(grids, GRID, "left_anti").groupBy(*GRID).count().select(*GRID, _say("patches without a grid header")),
    ]
    if cells is not None:
        found.append(cells.where("mask_u8 < 0 or mask_u8 > 255").groupBy(*GRID).count().select(*GRID, _say("mask values beyond 0..255")))
    if slide_vectors is not None:
        found.append(slide_vectors.groupBy(*GRID, "output_key").count().where("count > 1").select(*GRID, _say("slide/", F.col("output_key"), " has ", F.col("count"), " rows")))
    if qc is not None:
        scored = qc.groupBy(*GRID, "tool").agg(F.count("*").alias("k"), F.count_distinct("patch_idx").alias("different"))
        found.append(scored.join(counted.select(*GRID, "n"), GRID).where("k <> n or different <> n").select(*GRID, _say("qc/", F.col("tool"), " has ", F.col("k"), " rows for ", F.col("n"), " patches")))
    return reduce(DataFrame.unionByName, found)


def compared(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-3, atol: float = 1e-3) -> DataFrame:
    """By model: rows on one side only, the largest difference and whether all vectors are near (within atol + rtol|b|)."""
    joined = a.select(*keys, "model", F.col("vec").alias("va")).join(b.select(*keys, "model", F.col("vec").alias("vb")), [*keys, "model"], "full")
    same_size, near = within(F.col("va"), F.col("vb"), rtol, atol)
    diff = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return joined.groupBy("model").agg(F.count_if(F.col("vb").isNull()).alias("only_a"), F.count_if(F.col("va").isNull()).alias("only_b"), F.max(F.when(both, diff)).alias("max_abs_diff"), F.bool_and(F.coalesce(both & same_size & near, F.lit(False))).alias("ok"))
