"""Corpus slicing, query sampling and the train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.joins import broadcast_if_small
from rankloom.plans.ordering import first_by_hash, nth_hash, number_rows, seeded_hash


def limit_corpus(
    corpus: DataFrame, qrels: DataFrame, max_docs: int | None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Corpus of at most `max_docs` documents, judged ones first, and the judgements that survive.

    Judged documents are taken in id order; unjudged ones fill the rest in seeded hash order.
    """
    kept = _kept_documents(corpus, qrels, max_docs, seed)
    return kept, restrict_qrels(qrels, kept)


def _kept_documents(
    corpus: DataFrame, qrels: DataFrame, max_docs: int | None, seed: int
) -> DataFrame:
    if max_docs is None or max_docs <= 0 or corpus.count() <= max_docs:
        return corpus
    judged_ids = broadcast_if_small(qrels.select("doc_id").distinct())
    judged = corpus.join(judged_ids, "doc_id", "left_semi")
    judged_count = judged.count()
    if judged_count >= max_docs:
        ranked = number_rows(judged.select("doc_id"), ["doc_id"], "position", "judged_docs")
        chosen = broadcast_if_small(ranked.filter(F.col("position") <= max_docs).select("doc_id"))
        return corpus.join(chosen, "doc_id", "left_semi")
    unjudged = corpus.join(judged_ids, "doc_id", "left_anti")
    filler = first_by_hash(unjudged, "doc_id", max_docs - judged_count, seed, "corpus")
    return judged.unionByName(filler)


def restrict_qrels(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements whose document is in the corpus; queries left with none vanish.

    The corpus ids are first cut to the judged ones, so a large corpus is scanned but not shuffled.
    """
    judged_ids = broadcast_if_small(qrels.select("doc_id").distinct())
    present = corpus.select("doc_id").join(judged_ids, "doc_id", "left_semi")
    return qrels.join(present, "doc_id", "left_semi").select("qid", "doc_id", "grade")


def eligible_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one judgement."""
    judged = broadcast_if_small(qrels.select("qid").distinct())
    return queries.join(judged, "qid", "left_semi")


def sample_queries(
    queries: DataFrame, qrels: DataFrame, sample_size: int | None, seed: int = 42
) -> DataFrame:
    """Exactly `sample_size` eligible queries, or all of them when there are fewer or it is None."""
    if sample_size is None:
        return eligible_queries(queries, qrels)
    return first_by_hash(eligible_queries(queries, qrels), "qid", sample_size, seed, "sample")


def split_queries(sampled: DataFrame, test_size: float, seed: int = 42) -> DataFrame:
    """(qid, split): at least one and at most n-1 queries are held out as 'test'."""
    n = sampled.count()
    if n < 2:
        raise ValueError("a train/test split needs at least 2 sampled queries")
    held_out = min(max(1, int(n * test_size)), n - 1)
    threshold = nth_hash(sampled, "qid", held_out, seed, "split")
    is_test = seeded_hash("qid", seed, "split") <= F.lit(threshold)
    return sampled.select("qid", F.when(is_test, "test").otherwise("train").alias("split"))


def subset_qrels(qrels: DataFrame, ids: DataFrame) -> DataFrame:
    """Judgements of the given queries."""
    return qrels.join(broadcast_if_small(ids.select("qid").distinct()), "qid", "left_semi")
