"""Documents that share a run of tokens with a query, for two tables of any size.

The result has a row for each (query, document) pair, so a passage that opens many documents, each asked for by it, makes it
grow with the square of their number. Pairs are therefore made last and move no more. What moves grows with the texts:

- Queries with the same set of runs form a group, known by the SHA-256 of the sorted runs.
- A bit table of the asked runs' hashes (at most TABLE_BYTES) picks the places of each document that may hold one; only
  those runs are cut out as text and joined, hence exactly. A full table lets more through and loses nothing.
- Distinct (group, document) rows then meet the group's queries. Groups are cut into blocks of about BLOCK_ROWS documents by as
  many queries, and blocks are dealt to as many tasks as their pairs ask for. The groups of a query are one, so no pair comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import shingles, tokens
from rankloom.plans.joins import broadcast_if_small, join_on_term, spread
from rankloom.plans.staging import stage

#: Bits of the table for each asked run, and the table's largest size (a power of two).
TABLE_BITS = 256
TABLE_BYTES = 64 * 1024 * 1024
#: Bits of one of Spark's bitmaps.
BITMAP_BITS = 15
#: A block joins about this many documents with as many queries; a task makes about PAIRS_A_TASK pairs.
BLOCK_ROWS = 2048
PAIRS_A_TASK = 16_000_000


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def _run_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` word hashes that follow each other."""
    n = len(hashes) - width + 1
    keys = hashes[:n]
    for step in range(1, width):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[step : step + n]
        keys = keys ^ (keys >> np.uint64(29))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lists without nulls, one after the other, and where each list begins and the last ends."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    numbers = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    return numbers.to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0]


def _bit_table(runs: DataFrame, width: int) -> tuple[Broadcast, int]:
    """A bit table over the leading bits of the hashes of `run`, and its bits' logarithm."""
    spark = runs.sparkSession
    bits = min((TABLE_BYTES * 8).bit_length() - 1, max(BITMAP_BITS, (TABLE_BITS * runs.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _ = _flat(batch.column("hashes"))
            if len(hashes):
                keys = _run_keys(hashes, width)[::width] >> np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64) + 1)], names=["place"])

    maps = (
        runs.select(_word_hashes(F.split("run", " ", -1)).alias("hashes")).mapInArrow(places, "place long")
        .groupBy(F.bitmap_bucket_number("place").alias("number"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    table = np.zeros((1 << (bits - BITMAP_BITS), 1 << (BITMAP_BITS - 3)), np.uint8)
    for row in maps.toLocalIterator():
        table[row["number"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(table.reshape(-1)), bits


def runs_in_table(corpus: DataFrame, table: Broadcast, bits: int, width: int) -> DataFrame:
    """doc_id, run: the distinct runs of each row of the corpus whose bit is set."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = _flat(batch.column("hashes"))
            if len(hashes) < width:
                continue
            place = _run_keys(hashes, width) >> np.uint64(64 - bits)
            set_ = table.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            first = np.flatnonzero(set_)
            row = np.searchsorted(offsets, first, side="right") - 1
            inside = first + width <= offsets[row + 1]
            first, row = first[inside], row[inside]
            if not len(first):
                continue
            rows, counts = np.unique(row, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            starts = pa.ListArray.from_arrays(pa.array(ends), pa.array((first - offsets[row] + 1).astype(np.int32)))
            kept = [batch.column(name).take(pa.array(rows)) for name in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([*kept, starts], names=["doc_id", "text", "starts"])

    texts = corpus.select("doc_id", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    hashed = texts.withColumn("hashes", _word_hashes(tokens(F.col("text"))))
    found = hashed.mapInArrow(look, f"doc_id {id_type}, text string, starts array<int>")
    words = found.select("doc_id", "starts", tokens(F.col("text")).alias("words"))
    runs = F.transform("starts", lambda i: F.array_join(F.slice("words", i, F.lit(width)), " "))
    return words.select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))


def _pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    """qid, doc_id of the distinct rows found(group, doc_id) and members(group, qid) of the same group.

    No row of the result moves: found documents and queries are dealt out in blocks, by the count of their pairs.
    """
    spark = found.sparkSession
    groups = stage(
        found.groupBy("group").agg(F.count(F.lit(1)).alias("n_docs"))
        .join(members.groupBy("group").agg(F.count(F.lit(1)).alias("n_queries")), "group"),
        "groups",
    )
    n_pairs = int(groups.agg(F.coalesce(F.sum(F.col("n_docs").cast("decimal(20,0)") * F.col("n_queries")), F.lit(0)).alias("n")).first()["n"])
    if n_pairs <= PAIRS_A_TASK:
        return found.join(broadcast_if_small(members), "group").select("qid", "doc_id")
    # Few rows: each stands for more than BLOCK_ROWS rows of found or of members.
    large = groups.filter((F.col("n_docs") > BLOCK_ROWS) | (F.col("n_queries") > BLOCK_ROWS)).select(
        "group", F.ceil(F.col("n_docs") / BLOCK_ROWS).alias("d_blocks"), F.ceil(F.col("n_queries") / BLOCK_ROWS).alias("q_blocks")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_pairs // PAIRS_A_TASK))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Rows of a block in their own dimension, once for each block of the other dimension."""
        own_blocks, other_blocks = (F.coalesce(f"{x}_blocks", F.lit(1)) for x in (own, other))
        return rows.join(F.broadcast(large), "group", "left").select(
            "group", key, F.pmod(F.xxhash64(key), own_blocks).alias(f"_{own}"),
            F.explode(F.sequence(F.lit(0).cast("long"), other_blocks - 1)).alias(f"_{other}"),
        ).repartition(tasks, "group", "_d", "_q")

    return dealt(members, "qid", "q", "d").join(dealt(found, "doc_id", "d", "q"), ["group", "_d", "_q"]).select("qid", "doc_id")


def shared_runs(corpus: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """qid, doc_id once for every query and document that share a run of `width` tokens."""
    wanted = queries.select("qid", F.explode(shingles(tokens(F.col("text")), width)).alias("run"))
    # Tokens hold no line break, so the joined runs tell sets apart.
    asked = stage(
        wanted.groupBy("qid").agg(F.sort_array(F.collect_set("run")).alias("runs"))
        .withColumn("group", F.unhex(F.sha2(F.array_join("runs", "\n"), 256))),
        "asked_runs",
    )
    run_groups = stage(
        asked.groupBy("group").agg(F.first("runs").alias("runs")).select("group", F.explode("runs").alias("run")), "run_groups"
    )
    table, bits = _bit_table(run_groups.select("run"), width)
    runs = runs_in_table(spread(corpus.select("doc_id", "text"), "doc_id"), table, bits, width)
    found = stage(join_on_term(runs, run_groups, "run", "doc_id").select("group", "doc_id").distinct(), "found_runs")
    return _pairs(found, asked.select("group", "qid"))
