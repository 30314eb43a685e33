"""Readers that bring a judged collection into the three tables corpus, queries and qrels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.config import RankingConfig
from rankloom.functions.text import tokens
from rankloom.operators.passages import shared_runs
from rankloom.operators.sampling import limit_corpus
from rankloom.plans.joins import broadcast_if_small
from rankloom.plans.ordering import first_by_hash
from rankloom.plans.staging import stage


@dataclass(frozen=True)
class Collection:
    corpus: DataFrame   # doc_id, title, text
    queries: DataFrame  # qid, text
    qrels: DataFrame    # qid, doc_id, grade


def read_jsonl_collection(spark: SparkSession, folder: str, split: str) -> Collection:
    """corpus.jsonl and queries.jsonl (_id, title, text) with tab-separated qrels/<split>.tsv."""
    record = T.StructType([
        T.StructField("_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
    ])
    judgement = T.StructType([
        T.StructField("query-id", T.StringType()),
        T.StructField("corpus-id", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ])
    corpus = spark.read.schema(record).json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema(record).json(f"{folder}/queries.jsonl")
    qrels = (
        spark.read.schema(judgement).option("sep", "\t").option("header", True)
        .csv(f"{folder}/qrels/{split}.tsv")
    )
    return Collection(
        corpus.select(F.col("_id").alias("doc_id"), "title", "text"),
        queries.select(F.col("_id").alias("qid"), "text"),
        qrels.select(
            F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id"),
            F.col("score").alias("grade"),
        ),
    )


def write_jsonl_collection(collection: Collection, folder: str, split: str) -> None:
    """The layout `read_jsonl_collection` reads; each file name is a folder of part files."""
    (
        collection.corpus.select(F.col("doc_id").cast("string").alias("_id"), "title", "text")
        .write.json(f"{folder}/corpus.jsonl")
    )
    (
        collection.queries.select(F.col("qid").cast("string").alias("_id"), "text")
        .write.json(f"{folder}/queries.jsonl")
    )
    (
        collection.qrels.select(
            F.col("qid").cast("string").alias("query-id"),
            F.col("doc_id").cast("string").alias("corpus-id"),
            F.col("grade").alias("score"),
        )
        .write.option("sep", "\t").option("header", True).csv(f"{folder}/qrels/{split}.tsv")
    )


def read_parquet_collection(
    spark: SparkSession, corpus_path: str, queries_path: str, qrels_path: str
) -> Collection:
    return Collection(
        spark.read.parquet(corpus_path).select("doc_id", "title", "text"),
        spark.read.parquet(queries_path).select("qid", "text"),
        spark.read.parquet(qrels_path).select("qid", "doc_id", "grade"),
    )


def load_dataset(
    spark: SparkSession, folder: str, split: str, config: RankingConfig
) -> Collection:
    """Read a collection, check it, and cut it to the configured corpus size."""
    parsed = read_jsonl_collection(spark, folder, split)
    collection = Collection(stage(parsed.corpus, "corpus"), parsed.queries, stage(parsed.qrels, "qrels"))
    require_valid(collection)
    corpus, qrels = limit_corpus(
        collection.corpus, collection.qrels, config.max_docs, config.random_state
    )
    return Collection(corpus, collection.queries, qrels)


def _key_checks(table: DataFrame, keys: list[str], repeated: str, **rows: Column) -> DataFrame:
    """check_name, violations: rows that meet each named condition, and (`repeated`) keys with several rows."""
    by_key = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(flag.cast("long")).alias(name) for name, flag in rows.items()]
    )
    totals = by_key.agg(F.sum((F.col("_n") > 1).cast("long")).alias(repeated), *[F.sum(name).alias(name) for name in rows])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.coalesce(name, F.lit(0)).cast("long").alias("violations"))
        for name in (repeated, *rows)
    ])
    return totals.select(F.explode(pairs).alias("c")).select("c.*")


def input_contract(collection: Collection) -> DataFrame:
    """One row per check: (check_name, violations). Valid input has zero everywhere but `dangling_*`.

    Each table is aggregated once by its key; a second, key-only scan serves the dangling judgements.
    """
    corpus, queries = collection.corpus, collection.queries
    qrels = stage(collection.qrels, "contract_qrels")
    no_text = F.length(F.coalesce(F.col("text"), F.lit(""))) == 0
    no_pair = F.expr("qid is null or doc_id is null or grade is null")
    checks = [
        _key_checks(
            corpus, ["doc_id"], "corpus_duplicate_id", corpus_null_id=F.col("doc_id").isNull(), corpus_empty_text=no_text
        ),
        _key_checks(
            queries, ["qid"], "queries_duplicate_id", queries_null_id=F.col("qid").isNull(), queries_empty_text=no_text
        ),
        _key_checks(qrels, ["qid", "doc_id"], "qrels_duplicate_pair", qrels_null=no_pair),
    ]
    for table, key in ((corpus, "doc_id"), (queries, "qid")):
        judged = qrels.filter(F.col(key).isNotNull()).select(key).distinct()
        # The table's keys are cut to the judged ones before they meet a shuffle.
        present = table.select(key).join(broadcast_if_small(judged), key, "left_semi")
        missing = judged.join(present, key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        checks.append(missing.select(F.lit(f"dangling_{key}").alias("check_name"), "violations"))
    return reduce(DataFrame.unionByName, checks)


def require_valid(collection: Collection) -> None:
    """Raise unless all three inputs are present and keys are sound (dangling judgements are allowed)."""
    broken = [
        f"{row.check_name}={row.violations}"
        for row in input_contract(collection).collect()
        if row.violations and not row.check_name.startswith(("dangling", "corpus_empty", "queries_empty"))
    ]
    empty = [
        name for name in ("corpus", "queries", "qrels") if getattr(collection, name).isEmpty()
    ]
    if broken or empty:
        raise ValueError(f"dataset is incomplete: violations {broken}, empty tables {empty}")


# Judged collections derived from plain document tables -------------------------------------------


def document_corpus(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.lit(None).cast("string").alias("title"), "text")


def passage_queries(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("qid"), "text")


def passage_qrels(corpus: DataFrame, queries: DataFrame, width: int = 8) -> DataFrame:
    """A document is relevant (grade 1) when it shares a run of `width` tokens with the query text."""
    return shared_runs(corpus, queries, width).select("qid", "doc_id", F.lit(1).alias("grade"))


def graded_qrels(qrels: DataFrame, labels: DataFrame) -> DataFrame:
    """Grade 2 for documents labelled as good quality, 1 for all others."""
    quality = labels.select("doc_id", "quality")
    return qrels.join(quality, "doc_id", "left").select(
        "qid", "doc_id", (F.lit(1) + F.coalesce("quality", F.lit(0))).cast("int").alias("grade")
    )


def known_item_queries(
    corpus: DataFrame, sample_size: int | None, seed: int, first: int = 5, width: int = 8
) -> DataFrame:
    """Long enough documents (a seeded sample, or all if `sample_size` is None), each asked for by its tokens first .. first+width-1."""
    words = tokens(F.col("text"))
    eligible = corpus.select("doc_id", words.alias("words")).filter(
        F.size("words") >= first + width - 1
    )
    asked = eligible.select("doc_id", F.array_join(F.slice("words", first, width), " ").alias("text"))
    if sample_size is not None:  # written first: picking by hash reads the ids several times
        asked = first_by_hash(stage(asked, "known_items"), "doc_id", sample_size, seed, "known_item")
    return asked.select(F.col("doc_id").alias("qid"), "text")
