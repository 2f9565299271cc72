"""The feature store: partitioned Parquet tables whose rows show only once their commit row exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The store's tables and what each is partitioned by.
TABLES = {
    "grids": ("slide_id string, grid_hash string, schema_version string, segmenter string, target_mpp double, achieved_mpp double, mpp_level0 double, scale_x double, scale_y double, origin_x double, origin_y double, patch_px int, step_px int, level0_patch long, level0_step long, read_level int, read_px long, n_patches long, n_rows long, n_cols long, source_uri string, channel_names array<string>, batch string, written_utc timestamp, grid_key string", ["grid_key"]),
    "patches": ("slide_id string, patch_idx long, x long, y long, row long, col long, tissue_frac float, batch string, grid_key string", ["grid_key"]),
    "cells": ("slide_id string, row long, col long, tissue_frac float, mask_u8 short, batch string, grid_key string", ["grid_key"]),
    "features": ("slide_id string, patch_idx long, vec array<float>, digest string, error string, batch string, grid_key string, model string", ["grid_key", "model"]),
    "outputs": ("slide_id string, model string, embedding_dim int, digest string, batch string, grid_batch string, written_utc timestamp, grid_key string", ["grid_key"]),
    "slide_vectors": ("slide_id string, output_key string, patch_model string, patch_digest string, patch_batch string, dim int, vec array<float>, written_utc timestamp, grid_key string", ["grid_key"]),
    "qc": ("slide_id string, patch_idx long, scores map<string,float>, label short, usable boolean, batch string, grid_key string, tool string", ["grid_key", "tool"]),
    "qc_status": ("slide_id string, tool string, complete boolean, batch string, grid_batch string, written_utc timestamp, grid_key string", ["grid_key"]),
    "receipts": ("slide_id string, status string, source_uri string, output_uri string, reader string, models array<string>, config_hash string, n_patches long, model_dims map<string,int>, started_utc timestamp, finished_utc timestamp, elapsed_s double, schema_version string, error string", []),
}
GRID = ["slide_id", "grid_key"]


class Store:
    """Tables under one folder of any file system that Spark writes.

    Writers only ever append. Rows carry the batch that wrote them; a batch's rows count once its commit row is there
    (a grid's header, an output, a quality layer's status, each written last) and as long as no later commit of the
    same identity replaces it. A new grid takes its old outputs with it, and a replaced output its slide vectors. So
    forced runs replace, runs that stopped leave nothing that shows, and no run rewrites another's files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        """All rows ever written, replaced and uncommitted ones too."""
        schema, _ = TABLES[table]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def table(self, table: str, grid_key: str | None = None, model: str | None = None) -> DataFrame:
        """The rows that count; grid_key and model prune partitions."""
        rows = self.raw(table)
        if grid_key is not None and "grid_key" in rows.columns:
            rows = rows.where(F.col("grid_key") == grid_key)
        if table == "grids":
            return _last(rows, GRID)
        if table in ("patches", "cells"):
            return rows.join(self.table("grids", grid_key).select(*GRID, "batch"), [*GRID, "batch"], "left_semi")
        if table in ("outputs", "qc_status"):
            grids = self.table("grids", grid_key).select(*GRID, F.col("batch").alias("grid_batch"))
            return _last(rows, [*GRID, "model" if table == "outputs" else "tool"]).join(grids, [*GRID, "grid_batch"], "left_semi")
        if table == "features":
            rows = rows.where(F.col("model") == model) if model else rows
            return rows.where("error is null").join(self.table("outputs", grid_key).select(*GRID, "model", "batch"), [*GRID, "model", "batch"], "left_semi")
        if table == "qc":
            return rows.join(self.table("qc_status", grid_key).where("complete").select(*GRID, "tool", "batch"), [*GRID, "tool", "batch"], "left_semi")
        if table == "slide_vectors":
            made = self.table("outputs", grid_key).select(*GRID, F.col("model").alias("patch_model"), F.col("batch").alias("patch_batch"))
            return _last(rows, [*GRID, "output_key"]).join(made, [*GRID, "patch_model", "patch_batch"], "left_semi")
        return rows

    def append(self, table: str, rows: DataFrame) -> None:
        schema, parts = TABLES[table]
        names = [c.split()[0] for c in _columns(schema)]
        writer = rows.select(*names).write.mode("append")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{self.path}/{table}")

    def features(self, grid_key: str | None = None, model: str | None = None) -> DataFrame:
        return self.table("features", grid_key, model)

    def grid(self, grid_key: str | None = None) -> str:
        """The key of the only grid, or the one asked for; an error if there is none or several."""
        keys = sorted(r[0] for r in self.raw("grids").select("grid_key").distinct().limit(1000).collect())
        if grid_key in keys or (grid_key is None and len(keys) == 1):
            return grid_key or keys[0]
        raise KeyError(f"grid {grid_key!r} is not one of {keys}" if grid_key else f"name one of the grids {keys}")

    def grid_of(self, model: str) -> str:
        keys = [r[0] for r in self.table("outputs").where(F.col("model") == model).select("grid_key").distinct().limit(2).collect()]
        if len(keys) != 1:
            raise KeyError(f"{len(keys)} grids have {model}")
        return keys[0]

    def label(self, base: str, grid_hash: str) -> str:
        """The key that a grid has, or an unused one: the base, or with as much of the hash as tells it from others."""
        used = {(r["grid_key"], r["grid_hash"]) for r in self.table("grids").select("grid_key", "grid_hash").distinct().collect()}
        own = sorted(k for k, h in used if h == grid_hash and (k == base or k.startswith(f"{base}_")))
        if own:
            return own[0]
        names = [base, *(f"{base}_{grid_hash[:n]}" for n in (*range(8, len(grid_hash), 4), len(grid_hash)))]
        return next(n for n in names if n not in {k for k, _ in used})

    def primary(self) -> DataFrame:
        """slide_id and grid_key of the grid that each slide had first; its sidecar files have no suffix."""
        return self.raw("grids").groupBy("slide_id").agg(F.min_by("grid_key", F.struct("written_utc", "grid_key")).alias("grid_key"))

    def unsound_grids(self, grid_key: str, grid_hash: str) -> DataFrame:
        """slide_ids whose grid of this key can't be added to, so that it is built anew: a hash without its patches."""
        grids = self.table("grids", grid_key)
        n = self.table("patches", grid_key).groupBy(*GRID).agg(F.count("*").alias("n"), F.count_distinct("patch_idx").alias("different"), F.min("patch_idx").alias("low"), F.max("patch_idx").alias("high"))
        counted = grids.join(n, GRID, "left").fillna(0, ["n", "different"])
        sound = (F.col("n") == F.col("n_patches")) & ((F.col("n") == 0) | ((F.col("different") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))) & F.col("level0_patch").isNotNull() & F.col("read_px").isNotNull()
        # A grid without a hash is the only one of its key, and is taken for the one asked for.
        return counted.where((F.coalesce("grid_hash", F.lit(grid_hash)) == grid_hash) & ~F.coalesce(sound, F.lit(False))).select("slide_id")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of one identity the one written last. Commit rows are few beside what they commit."""
    order = Window.partitionBy(*keys).orderBy(F.desc("written_utc"), F.desc("batch" if "batch" in rows.columns else "patch_batch"))
    return rows.withColumn("nth_", F.row_number().over(order)).where("nth_ = 1").drop("nth_")


def _columns(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += c in "<(" and 1 or c in ">)" and -1 or 0
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def merged_names(old: list[str] | None, new: list[str] | None) -> list[str] | None:
    """Channel names with blanks filled; another name for a named channel is an error."""
    if not old or not new:
        return old or new
    if len(old) != len(new) or any(a and b and a != b for a, b in zip(old, new, strict=True)):
        raise ValueError("the source's channels were named otherwise")
    return [a or b for a, b in zip(old, new, strict=True)]


def names_clash(old: str, new: str) -> Column:
    """Whether two positional lists of channel names (array columns) can't be of one source."""
    apart = F.exists(F.arrays_zip(F.col(old).alias("a"), F.col(new).alias("b")), lambda p: (F.coalesce(p["a"], F.lit("")) != "") & (F.coalesce(p["b"], F.lit("")) != "") & (p["a"] != p["b"]))
    return (F.size(old) > 0) & (F.size(new) > 0) & ((F.size(old) != F.size(new)) | apart)
