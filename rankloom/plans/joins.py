"""Joins against a side that is usually, but not provably, small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32
SCAN_KEYS = 500


def _cell_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.StringType):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        size = F.octet_length(F.array_join(column, " ")) + F.size(column) * 8
    elif isinstance(kind, T.ArrayType):
        size = F.size(column) * 8
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """In-memory size estimate of `df`, counted by one aggregation (a single number reaches the driver)."""
    row = F.lit(ROW_OVERHEAD)
    for field in df.schema.fields:
        row = row + _cell_bytes(field)
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("size")).first()["size"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the counted size is within `limit`; otherwise `df` unchanged (shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def matching(table: DataFrame, ids: DataFrame, key: str = "doc_id", fits: bool | None = None) -> DataFrame:
    """Rows of `table` whose key is in `ids` (which may repeat keys).

    A few keys become a filter that the scan of a table sorted by key can skip row groups with. More are
    broadcast if they are counted to fit, and else joined by key.
    """
    wanted = ids.select(key)
    some = wanted.distinct().limit(SCAN_KEYS + 1).collect()
    if len(some) <= SCAN_KEYS:
        return table.filter(F.col(key).isin([row[key] for row in some]))
    small = fits_broadcast(wanted) if fits is None else fits
    return table.join(F.broadcast(wanted) if small else wanted.distinct(), key, "left_semi")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a plain scan placed by `key` when the scan has fewer splits than there are cores.

    A large input has splits enough and is left alone.
    """
    if scan.rdd.getNumPartitions() >= scan.sparkSession.sparkContext.defaultParallelism:
        return scan
    return scan.repartition(key)


def join_on_term(
    big: DataFrame, small: DataFrame, key: str, spread: str, fits: bool | None = None, salts: int = 16
) -> DataFrame:
    """Inner join of a large table with a term table.

    `fits` says whether `small` may be broadcast (counted here when not given). If so `big` keeps its
    partitioning. If not: shuffle join with every key of `big` split over `salts` buckets of its
    `spread` column, so that no term sits in one task.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), key)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted_small = small.withColumn("_salt", copies)
    return salted_big.join(salted_small, [key, "_salt"]).drop("_salt")
