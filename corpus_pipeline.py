"""From raw documents to packed training rows: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontaminate, jaccard, mixture, packing, quality
from rankloom.llm.tables import stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that the co-trained classifier, fitted on their labels, rejects."""
    return quality.good_documents(docs, _table(spark, folder, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.drop_contaminated(docs, _table(spark, folder, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Takes each document as often as the mix of sources asks for."""
    return mixture.mixed_documents(docs, _table(spark, folder, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packs the token ids of what is left into rows of fixed length."""
    return packing.pack_tokens(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("token output", token_output),
]

#: None: SQL expresses neither the trained classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The packed rows. Every stage but the last is written to the shared folder and read again."""
    docs = _table(spark, folder, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, folder), name.replace(" ", "_"), "snappy")
    return STAGES[-1][1](spark, docs, folder)
