"""Embedding similarity. The sentence encoder is a plug-in; vectors live in tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.vectors import dot

Encoder = Callable[[list[str]], np.ndarray]


def encode_texts(
    texts: DataFrame, id_column: str, load_encoder: Callable[[], Encoder], batch_size: int = 64
) -> DataFrame:
    """id, vector (unit length). `load_encoder` runs once per task; texts go through in small batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_encoder()
        for batch in batches:
            out: list[np.ndarray] = []
            for start in range(0, len(batch), batch_size):
                block = np.asarray(encode(batch.iloc[start:start + batch_size].tolist()), dtype=np.float64)
                lengths = np.linalg.norm(block, axis=1, keepdims=True)
                out.extend((block / np.where(lengths > 0, lengths, 1.0)).astype(np.float32))
            yield pd.Series(out, index=batch.index)

    return texts.select(id_column, vectors(F.coalesce("text", F.lit(""))).alias("vector"))


def pair_similarity(
    pairs: DataFrame, query_vectors: DataFrame | None, document_vectors: DataFrame | None
) -> DataFrame:
    """pairs + semantic_similarity: inner product of unit vectors, 0 where either is missing."""
    if query_vectors is None or document_vectors is None:
        return pairs.withColumn("semantic_similarity", F.lit(0.0))
    joined = pairs.join(
        query_vectors.select("qid", F.col("vector").alias("_qv")), "qid", "left"
    ).join(document_vectors.select("doc_id", F.col("vector").alias("_dv")), "doc_id", "left")
    similarity = F.coalesce(F.round(dot(F.col("_qv"), F.col("_dv")), 9), F.lit(0.0))
    return joined.withColumn("semantic_similarity", similarity).drop("_qv", "_dv")
