"""Scratch tables in the shared folder: plans end at a written table, which survives the loss of any executor."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_tables: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Unset, a folder of this machine serves a local session; else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return os.path.join(tempfile.gettempdir(), "tissuelake-scratch")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again, which cuts its lineage.

    Any executor may be lost afterwards. The table goes when this process ends, or by drop_scratch().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """df written as a Parquet table of the warehouse in n buckets by a column; binary columns come compressed."""
    spark = df.sparkSession
    df.write.format("parquet").option("compression", "uncompressed").bucketBy(n, column).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):
        if spark := SparkSession.getActiveSession():
            drop_scratch(spark)
