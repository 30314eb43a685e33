"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import codebooks, collocations, decontaminate, embedding_join, jaccard, licences, line_dedup, mixture, packing, quality, repacking, sharding, url_filter
from rankloom.llm.licence_texts import TEXTS

#: The rules of the registered url query, as (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_tokens(table(spark, folder, "documents"))


def op4_quality_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", "quality.*")


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = jaccard.join_documents(table(spark, folder, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "component_id", "kept")


def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    known = spark.createDataFrame(TEXTS, "licence string, text string")
    return licences.scan_licences(table(spark, folder, "documents"), known)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "deduped.n_lines", "deduped.n_gone", "deduped.text")


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixture.word_count().alias("size"))
    mixed = mixture.mix(mixture.quality_weights(docs, table(spark, folder, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op9_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    size, checksum = sharding.row_facts()
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", "lang", size.alias("size"), checksum.alias("text_crc32")
    )
    return sharding.hilbert_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_embedding_join(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, folder, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codebooks.product_codes(table(spark, folder, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = repacking.token_pieces(table(spark, folder, "documents"), repacking.tokenizer_path("word_bpe_49k.json"))
    packed = repacking.pack_pieces(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_token_packing": op3_token_packing,
    "op4_quality_cotraining": op4_quality_cotraining,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_licence_scan": op6_licence_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_hilbert_sharding": op9_hilbert_sharding,
    "op10_embedding_join": op10_embedding_join,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_best_fit_packing": op13_best_fit_packing,
}
