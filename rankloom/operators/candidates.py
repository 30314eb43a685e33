"""Candidate lists and the choice of training and test pairs.

`top` is a retrieval result (qid, doc_id, score, rank); `split` is (qid, split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.plans.joins import broadcast_if_small


def _queries_of(split: DataFrame, name: str) -> DataFrame:
    return broadcast_if_small(split.filter(F.col("split") == name).select("qid"))


def positives(qrels: DataFrame, top: DataFrame, split: DataFrame, per_query: int) -> DataFrame:
    """qid, doc_id, pick: training positives, highest grade first, then lowest retrieval score.

    Documents that were not retrieved come before all retrieved ones of the same grade.
    """
    judged = qrels.join(_queries_of(split, "train"), "qid", "left_semi")
    scored = judged.join(top.select("qid", "doc_id", "score"), ["qid", "doc_id"], "left")
    order = Window.partitionBy("qid").orderBy(
        F.desc("grade"), F.asc_nulls_first("score"), F.asc("doc_id")
    )
    return (
        scored.withColumn("pick", F.row_number().over(order))
        .filter(F.col("pick") <= per_query)
        .select("qid", "doc_id", F.col("pick").cast("long").alias("pick"))
    )


def negatives(top: DataFrame, qrels: DataFrame, split: DataFrame, per_query: int) -> DataFrame:
    """qid, doc_id, pick: the best-ranked training candidates without any judgement for the query."""
    train = top.join(_queries_of(split, "train"), "qid", "left_semi")
    unjudged = train.join(qrels.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("rank")
    return (
        unjudged.withColumn("pick", F.row_number().over(order))
        .filter(F.col("pick") <= per_query)
        .select("qid", "doc_id", F.col("pick").cast("long").alias("pick"))
    )


def candidate_lists(
    top: DataFrame, qrels: DataFrame, split: DataFrame, positives_per_query: int
) -> DataFrame:
    """qid, split, doc_id, pos, score, top_rank, n_candidates for every sampled query.

    Retrieved documents keep their order; training positives that were not retrieved are appended.
    """
    chosen = positives(qrels, top, split, positives_per_query)
    missing = chosen.join(top.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    listed = top.join(broadcast_if_small(split.select("qid")), "qid", "left_semi").select(
        "qid", "doc_id", "rank", F.col("score"), F.col("rank").alias("top_rank")
    )
    # Appended rows sort after every retrieved row.
    appended = missing.select(
        "qid", "doc_id", (F.col("pick") + F.lit(1 << 40)).alias("rank"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("top_rank"),
    )
    both = listed.unionByName(appended).join(broadcast_if_small(split), "qid")
    per_query = Window.partitionBy("qid")
    return both.select(
        "qid", "split", "doc_id",
        F.row_number().over(per_query.orderBy("rank")).cast("long").alias("pos"),
        "score", "top_rank",
        F.count(F.lit(1)).over(per_query).alias("n_candidates"),
    )


def candidate_documents(lists: DataFrame) -> DataFrame:
    """doc_id, in_train: each distinct candidate once, with a mark for training queries' candidates."""
    return lists.groupBy("doc_id").agg(F.bool_or(F.col("split") == "train").alias("in_train"))


def feature_pairs(
    lists: DataFrame, qrels: DataFrame, top: DataFrame, split: DataFrame,
    positives_per_query: int, negatives_per_query: int,
) -> DataFrame:
    """qid, doc_id, split, bm25, rank: train = positives and negatives, test = all candidates."""
    chosen = positives(qrels, top, split, positives_per_query).select("qid", "doc_id")
    refused = negatives(top, qrels, split, negatives_per_query).select("qid", "doc_id")
    train = lists.join(chosen.unionByName(refused), ["qid", "doc_id"], "left_semi")
    selected = train.unionByName(lists.filter(F.col("split") == "test"))
    return selected.select(
        "qid", "doc_id", "split",
        F.coalesce("score", F.lit(0.0)).alias("bm25"),
        F.coalesce("top_rank", F.col("n_candidates") + 1).alias("rank"),
    )


def inference_pairs(candidates: DataFrame, true_scores: DataFrame, split: str = "inference") -> DataFrame:
    """Same columns for given candidates (qid, doc_id, pos): true scores, fresh ranks."""
    scored = candidates.select("qid", "doc_id", "pos").join(
        true_scores.select("qid", "doc_id", "score"), ["qid", "doc_id"], "left"
    )
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), F.asc("pos"))
    return scored.select(
        "qid", "doc_id", F.lit(split).alias("split"),
        F.coalesce("score", F.lit(0.0)).alias("bm25"),
        F.row_number().over(order).cast("long").alias("rank"),
    )
