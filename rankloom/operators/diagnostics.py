"""Feature diagnostics of the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.statistics import long_values, sanitize
from rankloom.plans.ordering import running_total


def feature_summary(train: DataFrame, features: list[str]) -> DataFrame:
    """feature, missing_count, missing_ratio, inf_count, variance, mean, std of the raw rows.

    Missing is counted after infinities became missing; variance and std divide by n - 1.
    """
    value = F.col("value")
    is_inf = F.abs(value) == float("inf")
    clean = F.when(~(F.isnan(value) | is_inf), value)
    return (
        long_values(train, features, []).withColumn("clean", clean)
        .groupBy("feature")
        .agg(
            F.count_if(F.col("clean").isNull()).alias("missing_count"),
            F.avg(F.when(F.col("clean").isNull(), 1.0).otherwise(0.0)).alias("missing_ratio"),
            F.count_if(is_inf).alias("inf_count"),
            F.when(F.count("clean") == 0, 0.0).otherwise(F.var_samp("clean")).alias("variance"),
            F.coalesce(F.avg("clean"), F.lit(0.0)).alias("mean"),
            F.when(F.count("clean") == 0, 0.0).otherwise(F.stddev_samp("clean")).alias("std"),
        )
    )


def spearman_matrix(train: DataFrame, features: list[str]) -> DataFrame:
    """feature_a, feature_b, correlation (rounded to 6, undefined = 0) over pairwise complete rows.

    Rows collapse to counts per value pair; ranks are running totals over those counts; the
    correlation is the weighted Pearson coefficient of the centred ranks.
    """
    clean = sanitize(train.select(*features), features)
    names = list(enumerate(features))
    couples = F.array(*[
        F.struct(
            F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
            F.col(a).cast("double").alias("va"), F.col(b).cast("double").alias("vb"),
        )
        for i, a in names for j, b in names if i <= j
    ])
    pair = ["feature_a", "feature_b"]
    joint = (
        clean.select(F.explode(couples).alias("c")).select("c.*")
        .filter("va is not null and vb is not null")
        .groupBy(*pair, "va", "vb").agg(F.count(F.lit(1)).alias("n"))
    )
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col("va").alias("value")),
        F.struct(F.lit("b").alias("side"), F.col("vb").alias("value")),
    )
    marginal = (
        joint.select(*pair, "n", F.explode(sides).alias("s"))
        .groupBy(*pair, F.col("s.side").alias("side"), F.col("s.value").alias("value"))
        .agg(F.sum("n").alias("n"))
    )
    placed = running_total(marginal, [*pair, "side"], ["value"], "n", "rank_order")
    ranks = placed.select(
        *pair, "side", "value", (F.col("before") + (F.col("n") + 1) / 2).alias("position")
    )
    sizes = joint.groupBy(*pair).agg(F.sum("n").alias("total"))

    def side(name: str, value: str, position: str) -> DataFrame:
        return ranks.filter(F.col("side") == name).select(
            *pair, F.col("value").alias(value), F.col("position").alias(position)
        )

    centre = (F.col("total") + 1) / 2
    a, b = F.col("pa") - centre, F.col("pb") - centre
    sums = (
        joint.join(side("a", "va", "pa"), [*pair, "va"])
        .join(side("b", "vb", "pb"), [*pair, "vb"])
        .join(F.broadcast(sizes), pair)
        .groupBy(*pair)
        .agg(
            F.sum(F.col("n") * a * b).alias("sab"),
            F.sum(F.col("n") * a * a).alias("saa"),
            F.sum(F.col("n") * b * b).alias("sbb"),
        )
    )
    defined = (F.col("saa") > 0) & (F.col("sbb") > 0)
    upper = sums.select(
        *pair,
        F.when(defined, F.round(F.col("sab") / F.sqrt(F.col("saa")) / F.sqrt(F.col("sbb")), 6))
        .otherwise(0.0).alias("correlation"),
    )
    # Pairs without any complete row do not show up above; they count as undefined.
    every = train.sparkSession.createDataFrame(
        [(a, b) for i, a in names for j, b in names if i <= j], "feature_a string, feature_b string"
    )
    full = every.join(F.broadcast(upper), pair, "left").withColumn(
        "correlation", F.coalesce("correlation", F.lit(0.0))
    )
    mirrored = full.filter("feature_a <> feature_b").select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation"
    )
    return full.unionByName(mirrored)
