"""Blending of lexical and learned scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.evaluation import RANK_DIGITS, per_query_metrics, rank_rows, reranked_run
from rankloom.plans.joins import broadcast_if_small

# Blend weights that are tried, in order.
ALPHA_GRID = [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0]


def normalized(column: str, key: str = "query_id") -> Column:
    """Min-max scaling inside each query; a constant group becomes 0."""
    group = Window.partitionBy(key)
    low, high = F.min(column).over(group), F.max(column).over(group)
    return F.when(high <= low, F.lit(0.0)).otherwise((F.col(column) - low) / (high - low))


def blend(
    scored: DataFrame, alpha: float, bm25_column: str = "bm25", ltr_column: str = "score"
) -> DataFrame:
    """Adds hybrid_score = alpha * normalized(bm25) + (1 - alpha) * normalized(ltr)."""
    return scored.withColumn(
        "hybrid_score",
        F.lit(float(alpha)) * normalized(bm25_column) + F.lit(1.0 - alpha) * normalized(ltr_column),
    )


def alpha_results(scored: DataFrame, qrels: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """alpha, ndcg_at_10, map of the blended run of the queries in `ids`, all weights in one job.

    Scores are normalised once; the nine copies of a row exist after the per-query shuffle, and the
    ranking window reuses that placement.
    """
    wanted = broadcast_if_small(ids.select("qid").distinct())
    scaled = scored.select(
        F.col("query_id").alias("qid"), "doc_id",
        normalized("bm25").alias("lexical"), normalized("score").alias("learned"),
    ).join(wanted, "qid", "left_semi")
    weights = F.explode(F.array(*[F.lit(a) for a in ALPHA_GRID]))
    blended = scaled.withColumn("alpha", weights).select(
        "alpha", "qid", "doc_id",
        F.round(
            F.col("alpha") * F.col("lexical") + (F.lit(1.0) - F.col("alpha")) * F.col("learned"),
            RANK_DIGITS,
        ).alias("score"),
    )
    run = rank_rows(blended, ["alpha", "qid"], k)
    judged = qrels.join(wanted, "qid", "left_semi").withColumn("alpha", weights)
    return (
        per_query_metrics(run, judged, ["alpha", "qid"])
        .groupBy("alpha")
        .agg(F.round(F.avg("ndcg"), 9).alias("ndcg_at_10"), F.round(F.avg("ap"), 9).alias("map"))
    )


def best_alpha(results: DataFrame) -> DataFrame:
    """The row with the highest nDCG; the earlier weight wins ties."""
    return results.orderBy(F.desc_nulls_last("ndcg_at_10"), F.asc("alpha")).limit(1)


def hybrid_run(scored: DataFrame, ids: DataFrame, k: int, alpha: float) -> DataFrame:
    return reranked_run(blend(scored, alpha), "hybrid_score", ids, k)
