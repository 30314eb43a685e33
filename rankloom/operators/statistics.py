"""Per-feature statistics from value counts.

Rows are first counted per distinct value, so repeated values (a constant feature, for example)
shrink before any shuffle. Exact medians and ranks come from running totals over those counts, never
from collecting a feature's values in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.ordering import running_total


def sanitize(frame: DataFrame, features: list[str]) -> DataFrame:
    """NaN and infinities in feature columns become NULL."""
    def clean(name: str):
        value = F.col(name)
        broken = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(~broken, value).alias(name)

    return frame.select(*[clean(c) if c in features else F.col(c) for c in frame.columns])


def long_values(frame: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep..., feature, value: one row per cell of the feature columns."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"))
        for name in features
    ])
    return frame.select(*keep, F.explode(cells).alias("cell")).select(
        *keep, "cell.feature", "cell.value"
    )


def medians(counts: DataFrame, group: list[str]) -> DataFrame:
    """group..., median of the non-missing values in (group..., value, n)."""
    present = counts.filter("value is not null").withColumn("n", F.col("n").cast("long"))
    placed = running_total(present, group, ["value"], "n", "value_order")
    totals = present.groupBy(*group).agg(F.sum("n").alias("total"))
    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor((F.col("total") + 2) / 2)
    end = F.col("before") + F.col("n")
    holds_low = (F.col("before") < low) & (end >= low)
    holds_high = (F.col("before") < high) & (end >= high)
    return (
        placed.join(F.broadcast(totals), group)
        .filter(holds_low | holds_high)
        .groupBy(*group)
        .agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    )


def scaling_from_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """group..., median, mean, std: statistics of the median-imputed values in (group..., value, n).

    `std` is the population deviation, 1 where it is 0. A feature with no value at all is imputed as 0.
    """
    middle = medians(counts, group)
    everything = counts.groupBy(*group).agg(F.lit(1).alias("_seen")).drop("_seen")
    middle = everything.join(middle, group, "left").withColumn(
        "median", F.coalesce("median", F.lit(0.0))
    )
    filled = counts.join(F.broadcast(middle), group).withColumn(
        "value", F.coalesce("value", "median")
    )
    means = filled.groupBy(*group).agg(
        F.first("median").alias("median"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    spread = (
        filled.drop("median").join(F.broadcast(means), group)
        .withColumn("square", (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")) * F.col("n"))
        .groupBy(*group).agg(F.sqrt(F.sum("square") / F.sum("n")).alias("std"))
    )
    # A deviation of rounding size counts as zero.
    flat = F.col("std") <= F.lit(1e-12) * F.greatest(F.abs("mean"), F.lit(1.0))
    return means.join(spread, group).withColumn(
        "std", F.when(flat, F.lit(1.0)).otherwise(F.col("std"))
    )


def feature_scaling(frame: DataFrame, features: list[str]) -> DataFrame:
    """feature, median, mean, std over a sanitised frame."""
    counts = (
        long_values(frame, features, []).groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return scaling_from_counts(counts, ["feature"])


def impute_and_scale(frame: DataFrame, scaling: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns imputed with the median and standardised; `scaling` has one row per feature."""
    table = {row["feature"]: row for row in scaling.collect()}
    scaled = {
        name: (
            (F.coalesce(F.col(name), F.lit(table[name]["median"])) - F.lit(table[name]["mean"]))
            / F.lit(table[name]["std"])
        ).alias(name)
        for name in features
    }
    return frame.select(*[scaled.get(c, F.col(c)) for c in frame.columns])


def class_weights(frame: DataFrame) -> DataFrame:
    """label, n, weight: rows of each class weigh n_all / (2 * n_class)."""
    counts = frame.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = frame.agg(F.count(F.lit(1)).alias("total")).select("total").scalar()
    return counts.select("label", "n", (total / (F.lit(2.0) * F.col("n"))).alias("weight"))
