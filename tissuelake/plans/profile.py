"""Stage timings of runs and their summary."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "run string, stage string, seconds double, calls long, bytes long"


class Profile:
    """Collects the driver's stage timings; table() is what summary() takes."""

    def __init__(self, run: str):
        self.run, self.rows, self.began = run, [], time.perf_counter()

    @contextlib.contextmanager
    def stage(self, name: str, size: int = 0) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((self.run, name, time.perf_counter() - start, 1, size))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, METRICS)


def summary(metrics: DataFrame, walls: DataFrame) -> DataFrame:
    """By run and stage: seconds, calls, share of the wall time and MB a second. walls: run, wall_s, n_patches."""
    stages = metrics.groupBy("run", "stage").agg(F.sum("seconds").alias("seconds"), F.sum("calls").alias("calls"), F.sum("bytes").alias("bytes"))
    return stages.join(walls, "run").select("run", "stage", F.round("seconds", 4).alias("seconds"), "calls", F.round(100 * F.try_divide("seconds", "wall_s"), 1).alias("pct_wall"), F.round(F.try_divide(F.col("bytes") / 1e6, F.col("seconds")), 1).alias("mb_per_s"), F.round(F.try_divide("n_patches", "wall_s"), 1).alias("patches_per_s"))


def slowest_first(summaries: DataFrame) -> DataFrame:
    """A summary in the order of its report: of each run the stages by seconds."""
    return summaries.orderBy("run", F.desc("seconds"), "stage")


def medians(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("stage").agg(F.median("seconds").alias("seconds"))
