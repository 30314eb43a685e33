"""Global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.plans.joins import broadcast_if_small
from rankloom.plans.staging import stage

HASH_DIGITS_PER_STEP = 3
SMALL_BUCKET = 4096
SMALL_ROWS = 1_000_000


def seeded_hash(id_column: str, seed: int, purpose: str) -> Column:
    """Order key that is the same on every run, partitioning and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), F.col(id_column).cast("string")))


def nth_hash(df: DataFrame, id_column: str, n: int, seed: int, purpose: str) -> str | None:
    """n-th smallest seeded hash of the ids, or None when there are no more than n ids.

    Narrows the hash prefix by counting: every step returns at most 4096 counts to the driver, so
    picking n of any number of rows needs no sort of those rows.
    """
    hashes = df.select(seeded_hash(id_column, seed, purpose).alias("h"))
    if n <= 0:
        return ""
    prefix, left = "", n
    while True:
        width = len(prefix) + HASH_DIGITS_PER_STEP
        counts = (
            hashes.filter(F.col("h").startswith(prefix))
            .groupBy(F.substring("h", 1, width).alias("bucket")).count()
            .orderBy("bucket").collect()
        )
        if not prefix and sum(row["count"] for row in counts) <= n:
            return None
        for row in counts:
            if left <= row["count"]:
                prefix, size = row["bucket"], row["count"]
                break
            left -= row["count"]
        if len(prefix) >= 32:
            return prefix
        if size <= SMALL_BUCKET:
            rows = hashes.filter(F.col("h").startswith(prefix)).orderBy("h").collect()
            return rows[left - 1]["h"]


def first_by_hash(df: DataFrame, id_column: str, n: int, seed: int, purpose: str) -> DataFrame:
    """Exactly n rows of `df` (unique ids) in seeded hash order; a plain filter, no shuffle of `df`."""
    threshold = nth_hash(df, id_column, n, seed, purpose)
    if threshold is None:
        return df
    return df.filter(seeded_hash(id_column, seed, purpose) <= F.lit(threshold))


def running_total(
    df: DataFrame, group: list[str], order: list[str], value: str, name: str,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Adds `before`: the sum of `value` over earlier rows of the same group.

    Up to `small_rows` rows (counted) one window does it. Beyond that, rows are range-partitioned on
    (group, order), written, totalled per slice, and each slice starts from the total of the slices
    before it, so no task sees more than one slice of a group.
    """
    written = stage(df, name)
    if written.count() <= small_rows:
        whole = Window.partitionBy(*group).orderBy(*order)
        so_far = whole.rowsBetween(Window.unboundedPreceding, -1)
        return written.withColumn("before", F.coalesce(F.sum(value).over(so_far), F.lit(0)))
    sliced = stage(
        written.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()),
        f"{name}_sliced",
    )
    totals = sliced.groupBy("_slice", *group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_slice", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy("_slice", *group).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.join(broadcast_if_small(starts), ["_slice", *group])
        .withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_slice", "_start")
    )


def number_rows(
    df: DataFrame, order: list[str], column: str, name: str, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Adds a 1-based position in the global order (`order` must identify a row)."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    counted = running_total(ones, [], order, "_one", name, small_rows)
    return counted.withColumn(column, F.col("before") + 1).drop("before", "_one")
