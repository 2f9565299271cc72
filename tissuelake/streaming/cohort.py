"""New manifest rows as a stream, each slide once, and windowed metrics of receipts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "path string, source_mpp double"


def watch_manifests(spark: SparkSession, folder: str, run: Callable[[DataFrame], None], checkpoint: str, seen: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Run what has come into a folder of manifests (CSV with header) since the last time, then end.

    The checkpoint remembers files; seen() gives the paths that are complete, which are left out, so that a batch
    that is tried again does nothing twice.
    """
    rows = spark.readStream.schema(MANIFEST).option("header", True).option("comment", "#").csv(folder)

    def batch(new: DataFrame, _: int) -> None:
        new = new.where("path is not null").dropDuplicates(["path"])
        run(new if seen is None else new.join(seen(), "path", "left_anti"))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def receipt_metrics(receipts: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Receipts by status in windows of event time; rows later than the watermark don't count in a stream."""
    kept = receipts.withWatermark(time, late) if receipts.isStreaming else receipts
    return kept.groupBy(F.window(time, window), "status").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "status", "n", "total")
