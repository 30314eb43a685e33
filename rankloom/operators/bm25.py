"""BM25 index tables and retrieval for a whole table of queries at once.

The index is split by document: all postings of a document share a bucket. Scoring then needs no
shuffle of postings or of (query, document) sums; each task keeps its own k best rows per query, and
only those travel. Query terms are the broadcast side, after a count of their size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.plans.joins import BROADCAST_BYTES, broadcast_if_small, fits_broadcast, join_on_term, matching
from rankloom.plans.ordering import number_rows
from rankloom.plans.staging import fresh_path, open_writers, small_tasks, stage

# The usual BM25 constants.
K1 = 1.5
B = 0.75
EPSILON = 0.25

SCORE_DIGITS = 6
PAD_CHUNK = 8192
PUSHED_TERMS = 64
#: Postings and block maxima sit in up to this many folders (a power of two) by a hash of the term; queries read
#: only their terms' folders. An index has one folder for each FOLDER_BYTES of text.
TERM_FOLDERS = 16
FOLDER_BYTES = 1 << 30
#: Below this many blocks the probe and the bounds cost more than they save, and all blocks are scored.
PRUNE_BLOCKS = 64
#: Beyond so many terms a query on average, bounds add up the best weights of too many documents to leave a block out.
PRUNE_TERMS = 16
SCAN_BLOCKS = 256
FIRST_IDS = 4096
#: Counting and sorting a bucket's postings takes about 50 times its text in one task's memory.
BUCKET_BYTES = 16 * 1024 * 1024
#: Documents are dealt by a hash of their id into blocks of about this many; each block keeps the best weight of each term.
BLOCK_DOCS = 512
BLOCK_STEPS = 1 << 20
#: The blocks with the highest bounds that each query scores first, for its threshold.
PROBE_BLOCKS = 2
#: Scores are rounded to SCORE_DIGITS: a block whose bound is this far below a threshold cannot reach it once rounded.
BOUND_SLACK = 2 * 10.0 ** -SCORE_DIGITS
#: (posting, query) matches that a task adds up at once.
SLAB_MATCHES = 1 << 21


@dataclass(frozen=True)
class BM25Index:
    postings: DataFrame  # doc_id, dl, term, tf; bucketed by doc_id, sorted by term
    doc_stats: DataFrame  # doc_id, dl
    texts: DataFrame  # doc_id, title, text; bucketed and sorted by doc_id
    first_ids: DataFrame  # the smallest FIRST_IDS ids
    term_df: DataFrame  # term, df
    n_docs: int
    avgdl: float
    mean_idf: float
    k1: float = K1
    b: float = B
    epsilon: float = EPSILON
    block_max: DataFrame | None = None  # term, block, max_weight; None for indexes written without blocks
    n_blocks: int = 0
    n_folders: int = 1

    @property
    def term_stats(self) -> DataFrame:
        """term, df, idf; negative idf values become epsilon * mean idf."""
        raw = raw_idf(self.n_docs, F.col("df"))
        floor = F.lit(self.epsilon * self.mean_idf)
        return self.term_df.select("term", "df", F.when(raw < 0, floor).otherwise(raw).alias("idf"))

    @property
    def corpus_stats(self) -> DataFrame:
        return self.term_df.sparkSession.createDataFrame(
            [(self.n_docs, self.avgdl, self.mean_idf)], "n_docs long, avgdl double, mean_idf double"
        )

    def term_weight(self) -> Column:
        """The part of a term's score that does not depend on the query or on idf."""
        return weight_of(self.k1, self.b, self.avgdl)


def weight_of(k1: float, b: float, avgdl: float) -> Column:
    length = F.lit(1.0 - b) + F.lit(b / avgdl) * F.col("dl")
    return F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.lit(k1) * length)


def folder_of(term: Column, folders: int = TERM_FOLDERS) -> Column:
    """The term's folder among `folders` (a power of two dividing TERM_FOLDERS): equal to that among
    TERM_FOLDERS, modulo `folders`."""
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def block_of(doc_id: Column, n_blocks: int, buckets: int) -> Column:
    """Equal shares of the documents in the order of bucket, then hash: a block lies in two buckets at most when
    there are no fewer blocks than buckets, so that its best weights come together inside tasks."""
    bucket = F.pmod(F.hash(doc_id), F.lit(buckets)).cast("long")
    place = bucket * F.lit(BLOCK_STEPS) + F.pmod(F.xxhash64(doc_id), F.lit(BLOCK_STEPS))
    return F.floor(place * F.lit(n_blocks) / F.lit(float(buckets * BLOCK_STEPS))).cast("int")


def raw_idf(n_docs: int, df: Column) -> Column:
    return F.log(F.lit(float(n_docs)) - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def build_index(
    corpus: DataFrame, path: str | None = None, buckets: int | None = None,
    k1: float = K1, b: float = B, epsilon: float = EPSILON, folders: int | None = None,
) -> BM25Index:
    """Tokenise every document's text once and write the index tables under `path`.

    One shuffle moves the raw text by document id, which is smaller than moving the postings it
    expands to; counting terms and writing buckets then happen where the text landed. The texts
    themselves are kept too, sorted by id: features and previews look candidates up there. Buckets hold
    about BUCKET_BYTES of text each unless their number is given.
    """
    spark = corpus.sparkSession
    path = path or fresh_path(spark, "bm25")
    if buckets is None or folders is None:
        volume = corpus.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
        if buckets is None:
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // BUCKET_BYTES))
        if folders is None:
            folders = 1 << min(TERM_FOLDERS.bit_length() - 1, max(0, (volume // FOLDER_BYTES).bit_length() - 1))
    kept = corpus.select("doc_id", F.col("title") if "title" in corpus.columns else F.lit(None).cast("string").alias("title"), "text")
    (
        kept.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("doc_id")
        .option("path", f"{path}/texts").saveAsTable(_table_name("texts"))
    )
    texts = _bucketed(spark, f"{path}/texts", kept, buckets, "doc_id")
    n_blocks = max(1, -(-texts.count() // BLOCK_DOCS))
    # Read bucket by bucket: no second shuffle.
    words = texts.select("doc_id", tokens(F.col("text")).alias("words"))
    # A document without tokens keeps one row with a NULL term, so its length 0 is on record.
    occurrences = words.select(
        "doc_id", F.size("words").cast("long").alias("dl"), F.explode_outer("words").alias("term")
    )
    postings = (
        occurrences.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        .withColumn("block", block_of(F.col("doc_id"), n_blocks, buckets))
        .withColumn("folder", folder_of(F.col("term"), folders))
    )
    # A folder per term hash, inside it the document buckets; within a term, rows follow their block, so a
    # block filter skips row groups of frequent terms. Rows are sorted before the writer, which else compares
    # folder and bucket of each pair of rows first, and each folder's file of the task's bucket is open at once.
    with open_writers(spark, 2 * folders):
        (
            postings.sortWithinPartitions("term", "block").write.partitionBy("folder").bucketBy(buckets, "doc_id")
            .option("path", f"{path}/postings").saveAsTable(_table_name("postings"))
        )
    written = _bucketed(spark, f"{path}/postings", postings, buckets, "term")
    (
        written.groupBy("doc_id").agg(F.first("dl").alias("dl"))
        .write.parquet(f"{path}/doc_stats")
    )
    with small_tasks(spark, buckets):
        (
            written.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .sortWithinPartitions("term").write.parquet(f"{path}/term_df")
        )
    (
        spark.read.parquet(f"{path}/doc_stats").select("doc_id").orderBy("doc_id").limit(FIRST_IDS)
        .coalesce(1).write.parquet(f"{path}/first_ids")
    )
    totals = spark.read.parquet(f"{path}/doc_stats").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")
    ).first()
    terms = spark.read.parquet(f"{path}/term_df")
    mean_idf = terms.agg(F.avg(raw_idf(totals["n"], F.col("df")))).first()[0]
    with small_tasks(spark, buckets):
        (
            written.filter("term is not null").groupBy("folder", "term", "block")
            .agg(F.max(weight_of(k1, b, totals["avgdl"] or 1.0)).alias("max_weight"))
            .sortWithinPartitions("term").write.partitionBy("folder").parquet(f"{path}/block_max")
        )
    spark.createDataFrame(
        [(totals["n"], totals["avgdl"] or 1.0, mean_idf or 0.0, buckets, k1, b, epsilon, n_blocks, folders)],
        "n_docs long, avgdl double, mean_idf double, buckets int, k1 double, b double, epsilon double, n_blocks int,"
        " n_folders int",
    ).coalesce(1).write.json(f"{path}/manifest")
    return BM25Index(
        written, spark.read.parquet(f"{path}/doc_stats"), texts, spark.read.parquet(f"{path}/first_ids"), terms,
        totals["n"], totals["avgdl"] or 1.0, mean_idf or 0.0, k1, b, epsilon,
        spark.read.parquet(f"{path}/block_max"), n_blocks, folders,
    )


def load_index(spark: SparkSession, path: str) -> BM25Index:
    """Open index tables written earlier; nothing is recomputed."""
    facts = spark.read.json(f"{path}/manifest").first().asDict()
    doc_stats = spark.read.parquet(f"{path}/doc_stats")
    term_df = spark.read.parquet(f"{path}/term_df")
    layout = spark.read.parquet(f"{path}/postings")
    return BM25Index(
        postings=_bucketed(spark, f"{path}/postings", layout, facts["buckets"], "term"),
        doc_stats=doc_stats, term_df=term_df,
        texts=_bucketed(spark, f"{path}/texts", spark.read.parquet(f"{path}/texts"), facts["buckets"], "doc_id"),
        first_ids=spark.read.parquet(f"{path}/first_ids"),
        n_docs=facts["n_docs"], avgdl=facts["avgdl"], mean_idf=facts["mean_idf"],
        k1=facts["k1"], b=facts["b"], epsilon=facts["epsilon"],
        block_max=spark.read.parquet(f"{path}/block_max") if "n_blocks" in facts else None,
        n_blocks=facts.get("n_blocks") or 0,
        n_folders=facts.get("n_folders") or 1,
    )


def _table_name(kind: str) -> str:
    return f"rankloom_{kind}_{uuid.uuid4().hex[:12]}"


def _bucketed(spark: SparkSession, path: str, like: DataFrame, buckets: int, order: str) -> DataFrame:
    """External table over existing bucket files, so that readers know the files are split by document.

    A `folder` column is the table's partition column: its folders are found on disk and pruned by filters.
    """
    name = _table_name(path.rstrip("/").rsplit("/", 1)[-1])
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema.fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    folders = "PARTITIONED BY (folder) " if "folder" in like.columns else ""
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet {folders}"
        f"CLUSTERED BY (doc_id) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    if folders:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf: repeated query tokens count."""
    return (
        queries.select("qid", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


@dataclass(frozen=True)
class QuerySide:
    """What one count over a query table says about joining it."""

    fits: bool  # every per-query table (terms, lengths) is certain to fit a broadcast
    terms: list[str] | None  # the distinct terms, when there are few enough to filter a scan by
    folders: list[int] | None = None  # the term folders that the queries touch (at most TERM_FOLDERS)


def measure_queries(queries: DataFrame) -> QuerySide:
    n_tokens = F.size(tokens(F.col("text")))
    per_row = F.octet_length(F.coalesce("text", F.lit(""))) + n_tokens * 56 + 64
    total = queries.agg(
        F.coalesce(F.sum(per_row.cast("long")), F.lit(0)).alias("size"),
        F.coalesce(F.sum(n_tokens), F.lit(0)).alias("n_tokens"),
    ).first()
    terms = None
    if total["n_tokens"] <= PUSHED_TERMS:
        terms = sorted(r["term"] for r in query_terms(queries).select("term").distinct().collect())
    touched = query_terms(queries).select(folder_of(F.col("term")).alias("folder")).distinct().collect()
    return QuerySide(total["size"] <= BROADCAST_BYTES, terms, sorted(r["folder"] for r in touched))


def _only(table: DataFrame, side: QuerySide, folders: int = 1) -> DataFrame:
    """Only the folders of the query terms are read; few query terms also become a scan filter: files are
    sorted by term, so all row groups without one of the terms are skipped."""
    if side.folders is not None and "folder" in table.columns and folders > 1:
        table = table.filter(F.col("folder").isin(sorted({f % folders for f in side.folders})))
    if side.terms is None:
        return table
    wanted = F.lit(False)
    for term in side.terms:
        wanted = wanted | (F.col("term") == F.lit(term))
    return table.filter(wanted)


def weighted_postings(index: BM25Index, side: QuerySide) -> DataFrame:
    """doc_id, term, weight of the postings that the queries can touch."""
    return _only(index.postings, side, index.n_folders).select("doc_id", "term", index.term_weight().alias("weight"))


def weighted_terms(index: BM25Index, terms: DataFrame, side: QuerySide) -> DataFrame:
    """qid, term, qtf, idf for query terms the corpus knows; no larger than `terms`."""
    asked = F.broadcast(terms) if side.fits else terms
    return _only(index.term_stats, side).join(asked, "term").select("qid", "term", "qtf", "idf")


def score_all(index: BM25Index, queries: DataFrame) -> DataFrame:
    """qid, doc_id, score for every document that holds a query term."""
    side = measure_queries(queries)
    terms = weighted_terms(index, query_terms(queries), side)
    matched = join_on_term(weighted_postings(index, side), terms, "term", "doc_id", side.fits)
    points = F.sum(F.col("qtf") * F.col("idf") * F.col("weight"))
    return matched.groupBy("qid", "doc_id").agg(F.round(points, SCORE_DIGITS).alias("score"))


def _scores_in_blocks(index: BM25Index, side: QuerySide, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """qid, doc_id, score of the documents in the given (qid, block) pairs, which must be broadcastable.

    When few distinct blocks are asked for, they become a scan filter as well: postings are sorted by block
    within each term, so row groups of other blocks are skipped. The asked (term, block) pairs are joined at
    once when they are counted to fit a broadcast, so that a posting only meets the queries that ask for its block.
    """
    postings = _only(index.postings, side, index.n_folders)
    few = blocks.select("block").distinct().limit(SCAN_BLOCKS + 1).collect()
    if len(few) <= SCAN_BLOCKS:
        postings = postings.filter(F.col("block").isin([r["block"] for r in few]))
    weighted = postings.select("doc_id", "block", "term", index.term_weight().alias("weight"))
    wanted = blocks.join(F.broadcast(terms) if side.fits else terms, "qid")
    if fits_broadcast(wanted):
        near = weighted.join(F.broadcast(wanted), ["term", "block"])
    else:
        matched = join_on_term(weighted, terms, "term", "doc_id", side.fits)
        near = matched.join(F.broadcast(blocks), ["qid", "block"], "left_semi")
    points = F.sum(F.col("qtf") * F.col("idf") * F.col("weight"))
    return near.groupBy("qid", "doc_id").agg(F.round(points, SCORE_DIGITS).alias("score"))


def kept_blocks(index: BM25Index, queries: DataFrame, k: int, side: QuerySide, terms: DataFrame) -> DataFrame:
    """qid, block, bound of the blocks that may hold one of a query's k best documents.

    A block's bound is what a document there would score if it held every query term with the block's best
    weight: no document of the block scores more. Each query first scores its PROBE_BLOCKS best blocks
    exactly; if they hold k documents, the k-th best score is a threshold that the final list reaches, and a
    block whose bound is below it (by more than rounding) is left out. Exact: nothing of the top k is lost.
    """
    asked = terms.select("qid", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    maxima = _only(index.block_max, side, index.n_folders)
    bounds = stage(
        join_on_term(maxima, asked, "term", "block", side.fits)
        .groupBy("qid", "block").agg(F.sum(F.col("qw") * F.col("max_weight")).alias("bound")),
        "block_bounds",
    )
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), F.asc("block"))
    probe = bounds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PROBE_BLOCKS).select("qid", "block")
    first = best_per_query(_scores_in_blocks(index, side, terms, probe), k)
    threshold = first.groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("threshold")).filter(
        F.col("found") >= k
    )
    return bounds.join(F.broadcast(threshold) if side.fits else threshold, "qid", "left").filter(
        F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - F.lit(BOUND_SLACK))
    ).select("qid", "block", "bound")


@dataclass(frozen=True)
class TermPoints:
    """Query terms by number: those of term t are queries[begin[t]:begin[t + 1]] with their weights."""

    qids: pa.Array  # distinct, by query number
    begin: np.ndarray
    queries: np.ndarray
    weights: np.ndarray  # qtf * idf

    def matches(self, numbers: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, query and points of every (posting, query) match of the given postings."""
        counts = self.begin[numbers + 1] - self.begin[numbers]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + counts, counts)
        return np.repeat(rows, counts), self.queries[at], self.weights[at] * np.repeat(weights, counts)


def _numbered_terms(terms: DataFrame) -> tuple[DataFrame, TermPoints]:
    """(term, number) and the queries of each number, for weighted terms that fit a broadcast."""
    table = terms.select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight")).toArrow().combine_chunks()
    qids, words = (
        pc.dictionary_encode(table.column(name), null_encoding="encode").combine_chunks() for name in ("qid", "term")
    )
    number = words.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    begin = np.searchsorted(number[order], np.arange(len(words.dictionary) + 1))
    points = TermPoints(
        qids.dictionary, begin, qids.indices.to_numpy().astype(np.int64)[order], table.column("weight").to_numpy()[order]
    )
    numbers = pa.table({"term": words.dictionary, "number": pa.array(np.arange(len(words.dictionary), dtype=np.int64))})
    return terms.sparkSession.createDataFrame(numbers, "term string, number long"), points


def _sums(rows: np.ndarray, queries: np.ndarray, points: np.ndarray, n_rows: int, n_queries: int) -> tuple[np.ndarray, ...]:
    """Row, query and sum of points of each (row, query) that occurs."""
    keys = rows * n_queries + queries
    if n_rows * n_queries <= 8 * len(keys):
        present = np.flatnonzero(np.bincount(keys, minlength=1))
        sums = np.bincount(keys, points, minlength=1)[present]
    else:
        present, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, points, minlength=len(present))
    return present // n_queries, present % n_queries, sums


def _score_documents(index: BM25Index, side: QuerySide, terms: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score of every document that can be among a query's k best, all queries of a document at once.

    `terms` must fit a broadcast. Postings meet the numbers of the asked terms and come together by document, without a
    shuffle; the points of a document for all queries are added up in arrays. A task hands on what reaches the k-th best
    score that it has seen for the query, beyond rounding.
    """
    spark = terms.sparkSession
    numbers, points = _numbered_terms(terms)
    shared, n_queries = spark.sparkContext.broadcast(points), len(points.qids)
    by_document = (
        weighted_postings(index, side).join(F.broadcast(numbers), "term").groupBy("doc_id")
        .agg(F.collect_list(F.struct("number", "weight")).alias("matched"))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        reached = np.full(n_queries, -np.inf)
        for batch in batches:
            lists = batch.column("matched")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            number, weight = (lists.values.field(i).to_numpy() for i in (0, 1))
            size = asked.begin[number + 1] - asked.begin[number]
            before = np.concatenate([[0], np.cumsum(size)])[offsets]
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(before, before[first] + SLAB_MATCHES, side="right")) - 1)
                held = slice(offsets[first], offsets[last])
                row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
                row, query, sums = _sums(*asked.matches(number[held], weight[held], row), last - first, n_queries)
                near = sums >= reached[query] - BOUND_SLACK
                row, query, sums = row[near], query[near], sums[near]
                order = np.lexsort((-sums, query))
                row, query, sums = row[order], query[order], sums[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                reached[query[rank == k - 1]] = np.maximum(reached[query[rank == k - 1]], sums[rank == k - 1])
                near = sums >= reached[query] - BOUND_SLACK
                yield pa.RecordBatch.from_arrays(
                    [
                        asked.qids.take(pa.array(query[near])), batch.column("doc_id").take(pa.array(row[near] + first)),
                        pa.array(sums[near]),
                    ],
                    names=["qid", "doc_id", "points"],
                )
                first = last

    types = [terms.schema["qid"].dataType.simpleString(), index.postings.schema["doc_id"].dataType.simpleString()]
    scored = by_document.mapInArrow(score, f"qid {types[0]}, doc_id {types[1]}, points double")
    return scored.select("qid", "doc_id", F.round("points", SCORE_DIGITS).alias("score"))


def score_pruned(index: BM25Index, queries: DataFrame, k: int) -> DataFrame:
    """The scores of `score_all` for every document that can be among a query's k best.

    Indexes without blocks or with fewer than PRUNE_BLOCKS score every document. Queries of few terms leave blocks out
    by their bounds (block-max pruning) and score the kept (query, block) pairs. Longer ones, and those that keep most
    pairs or more than a broadcast takes, are scored document by document.
    """
    if index.block_max is None or index.n_blocks < PRUNE_BLOCKS:
        return score_all(index, queries)
    side = measure_queries(queries)
    terms = stage(weighted_terms(index, query_terms(queries), side), "scored_terms")
    asked = terms.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct(F.struct("qid")).alias("queries")).first()
    if side.fits and asked["terms"] > PRUNE_TERMS * asked["queries"]:
        return _score_documents(index, side, terms, k)
    kept = stage(kept_blocks(index, queries, k, side, terms).select("qid", "block"), "kept_blocks")
    if side.fits and 2 * kept.count() > asked["queries"] * index.n_blocks:
        return _score_documents(index, side, terms, k)
    if not fits_broadcast(kept):
        return score_all(index, queries)
    return _scores_in_blocks(index, side, terms, kept)


def best_per_query(scored: DataFrame, k: int) -> DataFrame:
    """Adds `rank` (score descending, then doc_id) and keeps the first k per query."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def top_k(index: BM25Index, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k best of all documents for every query.

    Documents without a query term score 0 and fill up short lists, smallest ids first.
    """
    if k <= 0:
        return score_all(index, queries).withColumn("rank", F.lit(0).cast("long")).limit(0)
    if index.mean_idf < 0:
        return _top_k_with_negative_scores(index, queries, k)
    # No score is below 0 here. A list with fewer than k positive scores leaves at least k zeros
    # among the first 2k ids, and those are the smallest zero-score ids there are.
    best = best_per_query(score_pruned(index, queries, k), k)
    known = index.first_ids if 2 * k <= FIRST_IDS else index.doc_stats.select("doc_id")
    pool = known.orderBy("doc_id").limit(2 * k).collect()
    if not pool:
        return best
    id_type = index.doc_stats.schema["doc_id"].dataType.simpleString()
    ids = F.array(*[F.lit(row["doc_id"]).cast(id_type) for row in pool])
    zeros = queries.select("qid", F.explode(ids).alias("doc_id"), F.lit(0.0).alias("score"))
    either = best.drop("rank").unionByName(zeros).repartition("qid")
    return best_per_query(either.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), k)


def _top_k_with_negative_scores(index: BM25Index, queries: DataFrame, k: int) -> DataFrame:
    """Case of a corpus whose typical term is in most documents: zero-score documents outrank others.

    Per query with m matched documents, the first k + m ids hold k unmatched ones.
    """
    matched = stage(score_all(index, queries).filter("score <> 0"), "matched")
    counts = matched.groupBy("qid").agg(F.count(F.lit(1)).alias("m"))
    reach = F.least(F.lit(index.n_docs), F.lit(k) + F.coalesce("m", F.lit(0))).cast("long")
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("reach") / PAD_CHUNK)))
    spans = (
        queries.select("qid").join(counts, "qid", "left").select("qid", reach.alias("reach"))
        .select("qid", "reach", chunks.alias("chunk")).repartition("qid", "chunk")
    )
    first = F.col("chunk") * PAD_CHUNK + 1
    last = F.least(F.col("reach"), F.col("chunk") * PAD_CHUNK + PAD_CHUNK)
    positions = (
        spans.filter(first <= F.col("reach"))
        .select("qid", F.explode(F.sequence(first, last)).alias("position"))
    )
    numbered = number_rows(index.doc_stats.select("doc_id"), ["doc_id"], "position", "doc_order")
    zeros = (
        positions.join(numbered, "position")
        .join(matched, ["qid", "doc_id"], "left_anti")
        .select("qid", "doc_id", F.lit(0.0).alias("score"))
    )
    return best_per_query(matched.unionByName(zeros), k)


def pair_overlap(
    index: BM25Index, queries: DataFrame, pairs: DataFrame,
    side: QuerySide | None = None, fits_pairs: bool | None = None,
) -> DataFrame:
    """qid, doc_id, common_terms, idf_overlap, score for given pairs that share at least one term.

    Postings are cut to the pairs' documents before any shuffle. `side` and `fits_pairs` say what
    may be broadcast; they are counted here when not given.
    """
    pairs = pairs.select("qid", "doc_id")
    side = side or measure_queries(queries)
    fits_pairs = fits_broadcast(pairs) if fits_pairs is None else fits_pairs
    terms = weighted_terms(index, query_terms(queries), side)
    ids = pairs.select("doc_id")
    near = weighted_postings(index, side).join(
        F.broadcast(ids) if fits_pairs else ids.distinct(), "doc_id", "left_semi"
    )
    pair_terms = pairs.join(F.broadcast(terms) if side.fits else terms, "qid")
    return pair_terms.join(near, ["doc_id", "term"]).groupBy("qid", "doc_id").agg(
        F.count(F.lit(1)).alias("common_terms"),
        F.round(F.sum("idf"), 9).alias("idf_overlap"),
        F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("weight")), SCORE_DIGITS).alias("score"),
    )


def score_candidates(index: BM25Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """True BM25 score of given (qid, doc_id) pairs; ids outside the corpus are dropped."""
    pairs = pairs.select("qid", "doc_id")
    fits_pairs = fits_broadcast(pairs)
    side = F.broadcast(pairs) if fits_pairs else pairs
    present = matching(index.doc_stats.select("doc_id"), pairs, fits=fits_pairs)
    known = present.join(side, "doc_id").select("qid", "doc_id")
    scores = pair_overlap(index, queries, pairs, fits_pairs=fits_pairs)
    return known.join(scores.select("qid", "doc_id", "score"), ["qid", "doc_id"], "left").select(
        "qid", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def baseline_run(index: BM25Index, queries: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """BM25 run of the queries named in `ids` at depth k."""
    wanted = broadcast_if_small(ids.select("qid").distinct())
    return top_k(index, queries.join(wanted, "qid", "left_semi"), k)
