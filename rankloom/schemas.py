"""Table schemas shared by readers, operators and writers."""

from __future__ import annotations

from pyspark.sql import types as T

# The model's feature vector, in order.
FEATURE_COLUMNS = [
    "tfidf",
    "semantic_similarity",
    "bm25_feature",
    "bm25_rank_feature",
    "common_terms",
    "overlap_ratio",
    "query_coverage",
    "idf_overlap",
    "doc_length_feature",
    "query_length_feature",
    "length_ratio",
]

# Column order of the feature frame (raw bm25 is kept for blending).
FRAME_COLUMNS = [
    "query_id",
    "doc_id",
    "split",
    "tfidf",
    "semantic_similarity",
    "bm25",
    "bm25_feature",
    "bm25_rank_feature",
    "common_terms",
    "overlap_ratio",
    "query_coverage",
    "idf_overlap",
    "doc_length_feature",
    "query_length_feature",
    "length_ratio",
    "label",
]


def corpus_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", id_type, False),
        T.StructField("title", T.StringType(), True),
        T.StructField("text", T.StringType(), False),
    ])


def queries_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("qid", id_type, False),
        T.StructField("text", T.StringType(), False),
    ])


def qrels_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("qid", id_type, False),
        T.StructField("doc_id", id_type, False),
        T.StructField("grade", T.IntegerType(), False),
    ])


def frame_schema(qid_type: T.DataType, doc_id_type: T.DataType) -> T.StructType:
    kinds = {
        "query_id": qid_type, "doc_id": doc_id_type,
        "split": T.StringType(), "label": T.IntegerType(),
    }
    return T.StructType([
        T.StructField(name, kinds.get(name, T.DoubleType()), True) for name in FRAME_COLUMNS
    ])
