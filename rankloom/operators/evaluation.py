"""Runs and ranking metrics. A run is (qid, doc_id, score, rank); qrels are (qid, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.plans.joins import broadcast_if_small

RANK_DIGITS = 9


def reranked_run(scored: DataFrame, score_column: str, ids: DataFrame | None, k: int) -> DataFrame:
    """Top k rows per query of a scored frame, for the queries in `ids` (qid); ties go to the smaller id."""
    rows = scored.select(
        F.col("query_id").alias("qid"), "doc_id",
        F.round(score_column, RANK_DIGITS).alias("score"),
    )
    if ids is not None:
        rows = rows.join(broadcast_if_small(ids.select("qid").distinct()), "qid", "left_semi")
    return rank_rows(rows, ["qid"], k)


def rank_rows(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def _discount(rank: Column) -> Column:
    return F.log2(rank + F.lit(1.0))


def ideal_gains(qrels: DataFrame, keys: list[str], depth: int = 10) -> DataFrame:
    """keys, ideal (DCG of the best order at `depth`), n_relevant, per query with judgements."""
    order = Window.partitionBy(*keys).orderBy(F.desc("grade"), F.asc("doc_id"))
    best = (
        qrels.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= depth)
        .groupBy(*keys)
        .agg(F.sum(F.col("grade") / _discount(F.col("place"))).alias("ideal"))
    )
    relevant = qrels.groupBy(*keys).agg(F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("n_relevant"))
    return best.join(relevant, keys)


def per_query_metrics(
    run: DataFrame, qrels: DataFrame, keys: list[str] | None = None, depth: int = 10
) -> DataFrame:
    """keys, ndcg, ap for every judged query; a query that is missing from the run scores 0.

    nDCG has linear gain, log2 discount and an ideal over all judgements of the query. AP is over the
    whole run as given. With extra key columns in run and qrels, many runs are scored in one job.
    """
    keys = keys or ["qid"]
    hits = run.select(*keys, "doc_id", "rank").join(
        qrels.select(*keys, "doc_id", "grade"), [*keys, "doc_id"]
    )
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    is_relevant = F.when(F.col("grade") > 0, 1.0).otherwise(0.0)
    gained = (
        hits.withColumn("precision", F.sum(is_relevant).over(so_far) / F.col("rank"))
        .groupBy(*keys)
        .agg(
            F.sum(
                F.when(F.col("rank") <= depth, F.col("grade") / _discount(F.col("rank")))
            ).alias("dcg"),
            F.sum(F.col("precision") * is_relevant).alias("precisions"),
        )
    )
    zero = F.lit(0.0)
    return ideal_gains(qrels, keys, depth).join(gained, keys, "left").select(
        *keys,
        F.when(F.col("ideal") > 0, F.coalesce("dcg", zero) / F.col("ideal")).otherwise(zero).alias("ndcg"),
        F.when(F.col("n_relevant") > 0, F.coalesce("precisions", zero) / F.col("n_relevant"))
        .otherwise(zero).alias("ap"),
    )


def evaluate_run(run: DataFrame, qrels: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (ndcg_at_10, map): means over the judged queries among `ids`."""
    wanted = broadcast_if_small(ids.select("qid").distinct())
    metrics = per_query_metrics(run, qrels.join(wanted, "qid", "left_semi"))
    return metrics.agg(
        F.round(F.avg("ndcg"), 9).alias("ndcg_at_10"), F.round(F.avg("ap"), 9).alias("map")
    )


def compare_models(runs: dict[str, DataFrame], qrels: DataFrame, ids: DataFrame) -> DataFrame:
    """model, ndcg_at_10, map: all runs evaluated in one job."""
    wanted = broadcast_if_small(ids.select("qid").distinct())
    judged = qrels.join(wanted, "qid", "left_semi")
    names = F.explode(F.array(*[F.lit(name) for name in runs]))
    every_judgement = judged.select(names.alias("model"), "qid", "doc_id", "grade")
    rows = None
    for name, run in runs.items():
        one = run.select(F.lit(name).alias("model"), "qid", "doc_id", "rank")
        rows = one if rows is None else rows.unionByName(one)
    return (
        per_query_metrics(rows, every_judgement, ["model", "qid"])
        .groupBy("model")
        .agg(F.round(F.avg("ndcg"), 9).alias("ndcg_at_10"), F.round(F.avg("ap"), 9).alias("map"))
    )
