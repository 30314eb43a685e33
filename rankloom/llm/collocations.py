"""Phrase collocations per language, counted by prefix-free parsing.

Texts are lower-cased (A-Z only) and split at sentence marks and line breaks into pieces, pieces into words
(runs without space or tab). Counting every 1-, 2- and 3-word window of every text shuffles three rows a word.
Instead each piece is parsed into content-triggered chunks: a word whose hash falls in one of `TRIGGER`
buckets starts a new chunk, and every chunk runs on for `MAX_WORDS - 1` words into the next one, so that each
window lies whole inside the chunk where it starts. Equal chunks, which repeated lines, shared passages and
copies produce in numbers, are one dictionary entry with a parse frequency. Windows are counted once inside
each distinct chunk, for the starts that the chunk owns (those before the next trigger), and weighted by that
frequency: the overlap is counted by exactly one chunk. The dictionary is a map-side combined aggregation,
written once to the shared folder; both counting passes read it and work on Arrow columns inside the tasks.

Most windows are rare, and their texts would be nearly all of a shuffle. So the first pass counts windows by a
`KEY_BITS`-bit hash: each task sorts and sums its hashes and sends them as differences in byte planes, a few
bytes each, to the task of their hash range. Sums stop at `min_count`, which is all that is asked of them.
Equal hashes only ever add to a sum, so the hash of every window seen `min_count` times is found. Those hashes
make a bit table (`FILTER_BITS` bits each, `FILTER_BYTES` at most), and the second pass counts by text, hence
exactly, only windows whose bit is set. What else the table lets through goes by its exact count; a table
that is full lets more through and loses nothing.

Phrases of 2 to 3 words seen at least `min_count` times are candidates. Each cut of a candidate into a first
part and a rest gives floor(1e6 * a^2 / (l * r)) in exact decimal arithmetic; the lowest cut counts, ties to
the shorter first part. A 2-word candidate goes when a 3-word candidate holds it and is seen at least half as
often. The best `top` of each language by score, count and phrase (UTF-8 byte order) are returned.

Defined cases: a null text has no words; a null language is `und`; empty and blank texts add nothing; a very
long text is one row whose chunks are cut in the JVM; repeated rows count as often as they occur; an empty
table gives no rows; only the text and language columns are read, so other columns never clash. Ties in the
order are broken by phrase, so the ranks are unique and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.tables import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Where pieces end, and what parts words.
PIECE_BREAK = r"[.,;:!?\x0A-\x0D]"
WORD_BREAK = r"[\x20\x09]+"
MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
#: A longer candidate seen at least this share (percent) as often removes the shorter one inside it.
SUBSUMED_PERCENT = 50
#: One word in this many starts a chunk; chunks then hold about this many words.
TRIGGER = 8
#: Bits of a window's hash in the first pass; the rest of 64 bits holds its count. Both are whole bytes.
KEY_BITS = 40
COUNT_BITS = 64 - KEY_BITS
COUNT_MASK = np.uint64((1 << COUNT_BITS) - 1)
#: Bits of the table for each frequent hash, and the table's largest size (a power of two).
FILTER_BITS = 16
FILTER_BYTES = 64 * 1024 * 1024
#: Dictionary rows that a task parses at once, and hashes that it holds before it sends them.
SLAB_ROWS = 1 << 16
HELD_KEYS = 1 << 21
#: Window occurrences for each hash range; there are at most 2 ** MAX_RANGE_BITS ranges.
RANGE_KEYS = 1 << 21
MAX_RANGE_BITS = 13


def _pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
        F.explode(F.split(lowered, PIECE_BREAK, -1)).alias("piece"),
    ).select("lang", F.filter(F.split("piece", WORD_BREAK, -1), lambda w: w != "").alias("ws")).filter(
        F.size("ws") > 0
    )


def _starts(ws: Column) -> Column:
    """Positions that start a chunk: the first word and every trigger word."""
    return F.filter(
        F.sequence(F.lit(0), F.size(ws) - 1),
        lambda i: (i == 0) | (F.pmod(F.xxhash64(F.element_at(ws, i + 1)), F.lit(TRIGGER)) == 0),
    )


def _chunks(ws: Column, starts: Column) -> Column:
    """(chunk text, owned starts) of one piece's words; chunks overlap by MAX_WORDS - 1 words.

    `ws` and `starts` must be plain columns: a lambda re-evaluates an expression that it refers to.
    """
    n = F.size(ws)

    def chunk(b: Column, j: Column) -> Column:
        stop = F.coalesce(F.try_element_at(starts, j + 2), n)
        words = F.slice(ws, b + 1, F.least(stop + (MAX_WORDS - 1), n) - b)
        return F.struct(F.array_join(words, " ").alias("chunk"), (stop - b).alias("own"))

    return F.transform(starts, chunk)


def chunk_dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chunk, own, freq): every distinct chunk with its parse frequency."""
    parsed = (
        _pieces(docs, text, lang)
        .select("lang", "ws", _starts(F.col("ws")).alias("starts"))
        .select("lang", F.explode(_chunks(F.col("ws"), F.col("starts"))).alias("c"))
    )
    return parsed.groupBy("lang", F.col("c.chunk").alias("chunk"), F.col("c.own").alias("own")).agg(
        F.count(F.lit(1)).alias("freq")
    )


def _slabs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `rows` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _text_hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of texts, the same in every task."""
    return hash_array(np.array(texts.to_pylist(), dtype=object), categorize=False).astype(np.uint64)


@dataclass(frozen=True)
class Parsed:
    """The words of some dictionary rows, one after the other, and the windows that they own."""

    words: pa.Array  # distinct words
    langs: pa.Array  # distinct languages
    word: np.ndarray  # per distinct (language, word): index in `words`
    lang: np.ndarray  # per distinct (language, word): index in `langs`
    ids: np.ndarray  # per position: its (language, word)
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # size -> positions of first words, chunk frequencies, hashes


def _parsed(rows: pa.RecordBatch, sizes: list[int]) -> Parsed:
    split = pc.split_pattern(rows.column("chunk"), " ")
    coded = split.flatten().dictionary_encode()
    langs = rows.column("lang").dictionary_encode()
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
    n_words = len(coded.dictionary)
    both = langs.indices.to_numpy().astype(np.int64)[row] * n_words + coded.indices.to_numpy()
    distinct, ids = np.unique(both, return_inverse=True)
    lang, word = np.divmod(distinct, max(n_words, 1))
    hashes = _mixed(_text_hashes(coded.dictionary)[word] ^ _mixed(_text_hashes(langs.dictionary) + np.uint64(1))[lang])
    own, freq = rows.column("own").to_numpy(), rows.column("freq").to_numpy()
    by_place = hashes[ids]
    windows = {}
    for k in sizes:
        first = np.flatnonzero((place < own[row]) & (place + k <= lengths[row]))
        keys = by_place[first]
        for step in range(1, k):
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + by_place[first + step])
        windows[k] = first, freq[row[first]], keys >> np.uint64(COUNT_BITS)
    return Parsed(coded.dictionary, langs.dictionary, word, lang, ids, windows)


def _summed(packed: np.ndarray, cap: int) -> np.ndarray:
    """Sorted numbers (hash << COUNT_BITS | count), one for each hash, with its counts' sum up to `cap`."""
    packed = np.sort(packed)
    keys, counts = packed >> np.uint64(COUNT_BITS), packed & COUNT_MASK
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first] << np.uint64(COUNT_BITS) | np.minimum(np.add.reduceat(counts, first), np.uint64(cap))


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The `width` low bytes of numbers, all lowest bytes first: planes of zeros compress to nothing."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, :width] = planes.T
    return whole.reshape(-1).view("<u8").astype(np.uint64)


def _sent(packed: np.ndarray, range_bits: int) -> pa.RecordBatch:
    """(range, keys, counts): differences of a hash range's sorted hashes and their counts, as byte planes."""
    keys, counts = packed >> np.uint64(COUNT_BITS), packed & COUNT_MASK
    ranges = keys >> np.uint64(KEY_BITS - range_bits)
    begin = np.flatnonzero(np.diff(ranges, prepend=~ranges[:1]))
    spans = list(zip(begin, np.append(begin[1:], len(keys))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ranges[begin].astype(np.int32)),
            pa.array([_planes(np.diff(keys[b:e], prepend=np.uint64(0)), KEY_BITS // 8) for b, e in spans], pa.binary()),
            pa.array([_planes(counts[b:e], COUNT_BITS // 8) for b, e in spans], pa.binary()),
        ],
        names=["range", "keys", "counts"],
    )


def frequent_keys(dictionary: DataFrame, min_count: int, range_bits: int) -> DataFrame:
    """(range, n, keys): the window hashes of each hash range that are seen `min_count` times, 8 bytes each.

    A task's work follows the distinct windows in its part or range; one seen everywhere is one number from
    each sending task.
    """
    cap = min(max(min_count, 1), int(COUNT_MASK))
    sizes = list(range(1, MAX_WORDS + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for slab in _slabs(batches, SLAB_ROWS):
            for _, freq, keys in _parsed(slab, sizes).windows.values():
                if len(keys):
                    held.append(_summed(keys << np.uint64(COUNT_BITS) | np.minimum(freq, cap).astype(np.uint64), cap))
                    n += len(held[-1])
            if n >= HELD_KEYS:
                held = [_summed(np.concatenate(held), cap)]
                n = len(held[0])
                if 2 * n >= HELD_KEYS:
                    yield _sent(held[0], range_bits)
                    held, n = [], 0
        if n:
            yield _sent(_summed(np.concatenate(held), cap), range_bits)

    def frequent(part: pa.Table) -> pa.Table:
        columns = zip(part.column("keys").to_pylist(), part.column("counts").to_pylist())
        packed = _summed(
            np.concatenate([
                np.cumsum(_from_planes(keys, KEY_BITS // 8)) << np.uint64(COUNT_BITS) | _from_planes(counts, COUNT_BITS // 8)
                for keys, counts in columns
            ]),
            cap,
        )
        kept = (packed >> np.uint64(COUNT_BITS))[packed & COUNT_MASK >= cap]
        return pa.table({
            "range": part.column("range").slice(0, 1), "n": pa.array([len(kept)], pa.int64()),
            "keys": pa.array([kept.astype("<u8").tobytes()], pa.binary()),
        })

    sent = dictionary.select("lang", "chunk", "own", "freq").mapInArrow(count, "range int, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(frequent, "range int, n long, keys binary")


def key_filter(dictionary: DataFrame, min_count: int) -> tuple[Broadcast, int]:
    """A bit table over the leading bits of hashes, set for all that are seen `min_count` times, and its bits' logarithm."""
    spark = dictionary.sparkSession
    n_words = dictionary.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("n")).first()["n"]
    range_bits = min(MAX_RANGE_BITS, max(3, (MAX_WORDS * n_words // RANGE_KEYS).bit_length()))
    frequent = stage(frequent_keys(dictionary, min_count, range_bits), "frequent_keys")
    n_keys = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = min((FILTER_BYTES * 8).bit_length() - 1, max(range_bits + 3, (FILTER_BITS * n_keys).bit_length()))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys in zip(batch.column("range").to_pylist(), batch.column("keys").to_pylist()):
                table = np.zeros(1 << (bits - range_bits), bool)
                places = np.frombuffer(keys, "<u8") >> np.uint64(KEY_BITS - bits)
                table[places & np.uint64(len(table) - 1)] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["range", "bits"]
                )

    whole = np.zeros((1 << range_bits, 1 << (bits - range_bits - 3)), np.uint8)
    for row in frequent.select("range", "keys").mapInArrow(slices, "range int, bits binary").toLocalIterator():
        whole[row["range"]] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(whole.reshape(-1)), bits


def window_counts(
    dictionary: DataFrame, sizes: list[int] = [1, 2, 3], keep: tuple[Broadcast, int] | None = None
) -> DataFrame:
    """(lang, k, gram, f): occurrences of windows of the listed sizes, counted inside chunks.

    With `keep` (see `key_filter`), windows whose bit is not set are left out; the counts of the others are exact.
    """
    table, bits = keep or (None, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _slabs(batches, SLAB_ROWS):
            parsed = _parsed(slab, sizes)
            for k, (first, freq, keys) in parsed.windows.items():
                if table is not None:
                    place = keys >> np.uint64(KEY_BITS - bits)
                    set_ = table.value[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1
                    first, freq = first[set_ == 1], freq[set_ == 1]
                if not len(first):
                    continue
                # Equal windows get equal numbers, word by word.
                number = parsed.ids[first]
                for step in range(1, k):
                    number = np.unique(number, return_inverse=True)[1] * len(parsed.word) + parsed.ids[first + step]
                order = np.argsort(number, kind="stable")
                begin = np.flatnonzero(np.diff(number[order], prepend=-1))
                one = first[order[begin]]
                parts = [parsed.words.take(pa.array(parsed.word[parsed.ids[one + step]])) for step in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [
                        parsed.langs.take(pa.array(parsed.lang[parsed.ids[one]])), pa.array(np.full(len(one), k, np.int32)),
                        pc.binary_join_element_wise(*parts, " "), pa.array(np.add.reduceat(freq[order], begin)),
                    ],
                    names=["lang", "k", "gram", "n"],
                )

    counted = dictionary.select("lang", "chunk", "own", "freq").mapInArrow(count, "lang string, k int, gram string, n long")
    return counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("f"))


def _exact_score(a: str, l: str, r: str) -> Column:
    """floor(1e6 * a^2 / (l * r)) by integral division of 38-digit decimals: no rounding, no 64-bit overflow."""
    wide = [f"CAST({c} AS DECIMAL(38,0))" for c in (a, a, l, r)]
    return F.expr(f"({wide[0]} * {wide[1]} * 1000000) div ({wide[2]} * {wide[3]})").cast("long")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (all numbers long) of the best `top` phrases of each language."""
    dictionary = stage(chunk_dictionary(docs, text, lang), "collocation_chunks", "snappy")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    keep = key_filter(dictionary, min_count)
    seen = stage(window_counts(dictionary, keep=keep).filter(F.col("f") >= min_count), "frequent_windows", "snappy")
    candidates = seen.filter(F.col("k") >= 2).select("lang", "k", F.col("gram").alias("phrase"), F.col("f").alias("a"))

    words = F.split("phrase", " ", -1)
    cuts = candidates.select(
        "lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select(
        "lang", "k", "phrase", "a", "cut",
        F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ").alias("right"),
    )
    parts = seen.select("lang", "gram", "f")
    scored = (
        cuts.join(parts.withColumnRenamed("gram", "left").withColumnRenamed("f", "l"), ["lang", "left"])
        .join(parts.withColumnRenamed("gram", "right").withColumnRenamed("f", "r"), ["lang", "right"])
        .withColumn("score", _exact_score("a", "l", "r"))
    )
    best = scored.groupBy("lang", "k", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("b")
    ).select("lang", "k", "phrase", "a", "b.score", "b.l", "b.r")

    longer = candidates.filter(F.col("k") == MAX_WORDS).select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("at")
    ).groupBy("lang", F.array_join(F.slice(words, F.col("at"), MAX_WORDS - 1), " ").alias("phrase")).agg(
        F.max("a").alias("longer_a")
    )
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer_a").isNull() | (F.col("longer_a") * 100 < F.col("a") * SUBSUMED_PERCENT)
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.join(totals, "lang").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase",
        *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")],
    )
