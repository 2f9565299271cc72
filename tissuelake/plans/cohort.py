"""Cohorts: identities, calibration, shards and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.functions.identity import slide_id, source_uri


def identified(manifest: DataFrame) -> DataFrame:
    """manifest (path, source_mpp) with slide_id and source_uri; remote URIs keep no credentials."""
    return manifest.withColumn("slide_id", slide_id("path")).withColumn("source_uri", source_uri("path"))


def duplicate_ids(slides: DataFrame, key: str = "slide_id", uri: str = "source_uri") -> DataFrame:
    """slide_ids that several sources share, with those sources."""
    return slides.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(uri)).alias("sources")).where("n > 1")


def require_unique(slides: DataFrame) -> None:
    """An error if two sources of the whole cohort would write one output."""
    if bad := duplicate_ids(slides).limit(20).collect():
        raise ValueError("several inputs share an output id: " + "; ".join(f"{r['slide_id']}: {', '.join(r['sources'])}" for r in bad))


def calibrated(slides: DataFrame, manifest: DataFrame) -> DataFrame:
    """slides with a missing scale taken from the manifest; a known scale stays."""
    given = manifest.select("path", F.col("source_mpp").alias("given_"))
    return slides.join(given, "path", "left").withColumn("mpp_level0", F.coalesce("mpp_level0", "given_")).drop("given_")


def strided(slides: DataFrame, index: int, count: int, order: str = "source_uri") -> DataFrame:
    """Every count-th slide in order, from the index-th on. Ranks a manifest, not its pixels."""
    return slides.withColumn("n_", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("n_") % count == index).drop("n_")


def contiguous(slides: DataFrame, count: int, order: str) -> DataFrame:
    """slides with shard: count runs of consecutive slides, the first ones longer by one at most."""
    return slides.withColumn("shard", F.ntile(count).over(Window.orderBy(order)) - 1)
