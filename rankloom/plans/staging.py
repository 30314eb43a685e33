"""Written intermediates.

A result that several later jobs read is written once as Parquet in the shared checkpoint folder and
read back. The written table cuts the lineage and survives the loss of executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCAN_BYTES = 32 * 1024 * 1024


def workspace(spark: SparkSession) -> str:
    """Shared folder for intermediates: `spark.checkpoint.dir`, or a part of the warehouse where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rankloom-work"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the workspace and return the table that reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_tasks(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Jobs in the block shuffle to `partitions` partitions at least and scan SCAN_BYTES of files a task, so that
    a task's share does not grow with the table."""
    shuffle = "spark.sql.shuffle.partitions"
    wanted = max(int(spark.conf.get(shuffle)), partitions)
    with _settings(spark, {shuffle: str(wanted), "spark.sql.files.maxPartitionBytes": str(SCAN_BYTES)}):
        yield


@contextmanager
def open_writers(spark: SparkSession, files: int) -> Iterator[None]:
    """Writes in the block keep up to `files` files of a task open, so that rows need no sort by folder and bucket."""
    with _settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(files)}):
        yield


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
