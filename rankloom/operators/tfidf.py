"""TF-IDF vocabulary and cosine similarity over query-document pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import content_words, unigrams_and_bigrams
from rankloom.plans.joins import join_on_term, matching

COSINE_DIGITS = 9


def gram_counts(texts: DataFrame, id_column: str, stop_words: list[str] | None = None) -> DataFrame:
    """id, gram, tf. Texts are placed by id first, so counting needs no shuffle of grams."""
    placed = texts.select(id_column, "text").repartition(id_column)
    grams = unigrams_and_bigrams(content_words(F.col("text"), stop_words))
    return (
        placed.select(id_column, F.explode(grams).alias("gram"))
        .groupBy(id_column, "gram").agg(F.count(F.lit(1)).alias("tf"))
    )


def fit_vocabulary(
    train_queries: DataFrame, train_documents: DataFrame, stop_words: list[str] | None = None
) -> DataFrame:
    """gram, df, idf over training texts only; idf = ln((1 + n) / (1 + df)) + 1.

    The chosen texts are few next to the corpus, so they are dealt out to all tasks first. Distinct
    grams per text are counted where the text is; only partial counts are shuffled.
    """
    def distinct_grams(texts: DataFrame) -> DataFrame:
        grams = F.array_distinct(unigrams_and_bigrams(content_words(F.col("text"), stop_words)))
        key = texts.columns[0]
        return texts.select(key, "text").repartition(key).select(F.explode(grams).alias("gram"))

    n_texts = train_queries.count() + train_documents.count()
    grams = distinct_grams(train_queries).unionByName(distinct_grams(train_documents))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0 + n_texts) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return counted.select("gram", "df", idf.alias("idf"))


def weighted_grams(
    texts: DataFrame, id_column: str, vocabulary: DataFrame, stop_words: list[str] | None = None
) -> DataFrame:
    """id, gram, w: rows of unit-length TF-IDF vectors; grams outside the vocabulary do not count."""
    counts = gram_counts(texts, id_column, stop_words)
    known = join_on_term(counts, vocabulary.select("gram", "idf"), "gram", id_column).select(
        id_column, "gram", (F.col("tf") * F.col("idf")).alias("raw")
    )
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_column)))
    return known.select(id_column, "gram", (F.col("raw") / length).alias("w"))


def pair_cosine(
    pairs: DataFrame, queries: DataFrame, documents: DataFrame, vocabulary: DataFrame,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """qid, doc_id, tfidf for pairs that share a known gram; absent pairs have similarity 0."""
    query_rows = weighted_grams(queries, "qid", vocabulary, stop_words)
    document_rows = weighted_grams(documents, "doc_id", vocabulary, stop_words)
    asked = pairs.select("qid", "doc_id").join(
        query_rows.withColumnRenamed("w", "qw"), "qid"
    )
    return (
        asked.join(document_rows, ["doc_id", "gram"])
        .groupBy("qid", "doc_id")
        .agg(F.round(F.sum(F.col("qw") * F.col("w")), COSINE_DIGITS).alias("tfidf"))
    )


def documents_of(corpus: DataFrame, ids: DataFrame, fits: bool | None = None) -> DataFrame:
    """Texts of the given documents; `ids` may repeat an id."""
    return matching(corpus.select("doc_id", "text"), ids, fits=fits)
