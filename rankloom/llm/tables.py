"""Written intermediates of these operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankloom.plans.staging import fresh_path


def stage(df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
    """Writes `df` to the shared folder and reads it back.

    Most intermediates are hashes and counts that hardly compress; without a codec, a task that writes a
    small file holds no compression buffers outside the heap. Tables with text name a codec.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
