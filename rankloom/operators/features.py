"""The feature frame: one row per query-document pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import compress_score, guarded_ratio, tokens
from rankloom.operators.bm25 import (
    BM25Index, QuerySide, measure_queries, pair_overlap, query_terms, score_candidates, weighted_terms,
)
from rankloom.operators.candidates import inference_pairs
from rankloom.operators.semantic import pair_similarity
from rankloom.operators.tfidf import documents_of, pair_cosine
from rankloom.plans.joins import fits_broadcast, matching
from rankloom.plans.staging import stage
from rankloom.schemas import FRAME_COLUMNS


def query_lengths(queries: DataFrame) -> DataFrame:
    """qid, n_tokens, n_terms (distinct)."""
    words = queries.select("qid", tokens(F.col("text")).alias("words"))
    return words.select(
        "qid",
        F.size("words").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("words")).cast("long").alias("n_terms"),
    )


def with_lengths(
    index: BM25Index, queries: DataFrame, pairs: DataFrame,
    side: QuerySide | None = None, fits_pairs: bool | None = None,
) -> DataFrame:
    """pairs + n_tokens, n_terms of the query and dl of the document; unknown documents are dropped."""
    side = side or measure_queries(queries)
    fits_pairs = fits_broadcast(pairs) if fits_pairs is None else fits_pairs
    lengths = query_lengths(queries)
    lengths_of = matching(index.doc_stats, pairs, fits=fits_pairs)
    return lengths_of.join(F.broadcast(pairs) if fits_pairs else pairs, "doc_id").join(
        F.broadcast(lengths) if side.fits else lengths, "qid"
    )


def overlap_columns() -> list[Column]:
    common = F.coalesce(F.col("common_terms").cast("double"), F.lit(0.0))
    return [
        common.alias("common_terms"),
        guarded_ratio(common, F.col("n_terms")).alias("overlap_ratio"),
        guarded_ratio(common, F.col("n_tokens")).alias("query_coverage"),
        F.coalesce("idf_overlap", F.lit(0.0)).alias("idf_overlap"),
    ]


def length_columns() -> list[Column]:
    n_query, n_doc = F.col("n_tokens").cast("double"), F.col("dl").cast("double")
    return [
        compress_score(n_doc).alias("doc_length_feature"),
        compress_score(n_query).alias("query_length_feature"),
        guarded_ratio(n_query, n_doc).alias("length_ratio"),
    ]


def overlap_features(index: BM25Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """qid, doc_id, common_terms, overlap_ratio, query_coverage, idf_overlap for every given pair."""
    pairs = pairs.select("qid", "doc_id")
    side, fits_pairs = measure_queries(queries), fits_broadcast(pairs)
    shared = pair_overlap(index, queries, pairs, side, fits_pairs)
    return with_lengths(index, queries, pairs, side, fits_pairs).join(
        shared, ["qid", "doc_id"], "left"
    ).select("qid", "doc_id", *overlap_columns())


def length_features(index: BM25Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """qid, doc_id, doc_length_feature, query_length_feature, length_ratio for every given pair."""
    return with_lengths(index, queries, pairs.select("qid", "doc_id")).select(
        "qid", "doc_id", *length_columns()
    )


def retrieval_features(pairs: DataFrame) -> DataFrame:
    """pairs (bm25, rank) + bm25_feature, bm25_rank_feature."""
    return pairs.withColumn("bm25_feature", compress_score(F.col("bm25"))).withColumn(
        "bm25_rank_feature", F.lit(1.0) / F.col("rank")
    )


def labels(pairs: DataFrame, qrels: DataFrame | None) -> DataFrame:
    """pairs + label: 1 for any judgement of the pair whatever its grade; 0 without judgements."""
    if qrels is None:
        return pairs.withColumn("label", F.lit(0))
    judged = qrels.select("qid", "doc_id").withColumn("_judged", F.lit(1))
    return pairs.join(judged, ["qid", "doc_id"], "left").withColumn(
        "label", F.coalesce("_judged", F.lit(0))
    ).drop("_judged")


def text_overlap(
    index: BM25Index, queries: DataFrame, pairs: DataFrame, documents: DataFrame, side: QuerySide
) -> DataFrame:
    """qid, doc_id, common_terms, idf_overlap of pairs that share a term, from the documents' texts."""
    terms = weighted_terms(index, query_terms(queries), side)
    words = documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = pairs.select("qid", "doc_id").join(F.broadcast(terms) if side.fits else terms, "qid")
    return asked.join(words, ["doc_id", "term"]).groupBy("qid", "doc_id").agg(
        F.count(F.lit(1)).alias("common_terms"), F.round(F.sum("idf"), 9).alias("idf_overlap")
    )


def build_frame(
    pairs: DataFrame, corpus: DataFrame, queries: DataFrame, index: BM25Index, vocabulary: DataFrame,
    qrels: DataFrame | None, query_vectors: DataFrame | None = None,
    document_vectors: DataFrame | None = None,
) -> DataFrame:
    """Feature frame of (qid, doc_id, split, bm25, rank) pairs; pairs of unknown documents are dropped.

    `pairs` should be a written table: every feature family starts from it. The texts of the pairs'
    documents are looked up once (hand in the index's `texts` as the corpus); TF-IDF and term overlap
    both come from them, so the postings are not read again.
    """
    key = ["qid", "doc_id"]
    side, fits_pairs = measure_queries(queries), fits_broadcast(pairs)
    documents = stage(documents_of(corpus, pairs, fits_pairs), "frame_texts")
    cosine = pair_cosine(pairs, queries, documents, vocabulary)
    shared = text_overlap(index, queries, pairs, documents, side)
    sized = with_lengths(index, queries, pairs, side, fits_pairs)
    frame = retrieval_features(labels(sized, qrels)).join(shared, key, "left").join(cosine, key, "left")
    frame = pair_similarity(frame, query_vectors, document_vectors)
    computed = {"common_terms", "idf_overlap", "tfidf", "n_tokens", "n_terms", "dl"}
    return frame.select(
        *[c for c in frame.columns if c not in computed],
        F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"), *overlap_columns(), *length_columns(),
    ).withColumnRenamed("qid", "query_id").select(*FRAME_COLUMNS)


def build_inference_frame(
    candidates: DataFrame, corpus: DataFrame, queries: DataFrame, index: BM25Index,
    vocabulary: DataFrame, split: str = "inference", query_vectors: DataFrame | None = None,
    document_vectors: DataFrame | None = None, true_scores: DataFrame | None = None,
) -> DataFrame:
    """Frame of candidates (qid, doc_id, pos) for unjudged queries: true BM25 scores, label 0.

    Candidates that come from retrieval have their true scores already; handing them in as
    `true_scores` (qid, doc_id, score) saves a pass over the postings.
    """
    scores = score_candidates(index, queries, candidates) if true_scores is None else true_scores
    pairs = stage(inference_pairs(candidates, scores, split), "pairs")
    return build_frame(
        pairs, corpus, queries, index, vocabulary, None, query_vectors, document_vectors
    )
