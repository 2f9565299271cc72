"""Sessions: the settings that the engine expects, and Python workers that can import it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Bytes of one Arrow batch to a Python worker at most, however long its rows' texts are.
BATCH_BYTES = str(16 << 20)

#: Settings of local runs; a cluster's own settings take precedence.
LOCAL = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tissuelake").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (LOCAL | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return with_package(spark)


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this folder import the package from it, wherever the driver was started.

    Also bounds the bytes of the batches that they get.

    Elsewhere (executors without this folder) the package comes by --py-files or is installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    environment = spark.sparkContext.environment
    paths = [p for p in (environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
