"""Line deduplication within an edit bound of one character, by a deletion-neighbourhood join.

Two lines are within one edit if deleting the same position of both leaves equal text (a substitution), or
deleting one position of one leaves the other (an insertion). So each line emits hashed keys: its own text,
its text without each single character, and the same with the position. All lines under one key with a
position differ in that position only, and all lines under a plain key differ by one character from the
line that is the key. The earliest line under each key is therefore a near copy of the others, and one
aggregation finds it: no pairs are formed, however large the group. Each find is confirmed by the true edit
distance before a line goes.

Emitting every variant of every line would be many times the corpus. A line first has to share an
unchanged half with another of fitting length (one edit cannot touch both halves), which loses nothing.

Of lines within the bound the earliest stays: a line goes if an equal line, or one within one edit, came
earlier in the order of (doc_id, text digest, line number), null ids last. Lines under `min_chars`
characters are too short for an edit to be noise; they go only when equal to an earlier one. Lines are
compared without surrounding blanks; blank lines are never removed.

Defined cases: null text stays null with no lines; rows equal in id and text are one document occurrence
each and treated alike (all lose the lines that an earlier document holds, none those of each other); an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.jaccard import mixed
from rankloom.llm.tables import stage
from rankloom.llm.text import prepare_python, text_key, utf8
from rankloom.plans.joins import broadcast_if_small

MIN_CHARS = 12
BROADCAST_BYTES = 16 * 1024 * 1024
_BASE = np.uint64(0x5851F42D4C957F2D)
BLANKS = b" \t\r"
OWN, LESS, AT = 0, 1, 2


def half_keys(line: bytes) -> list[int]:
    """Hashes that two lines within one edit share one of: an intact half, for each length both could have in common."""
    chars = line.decode("utf-8", "replace")
    keys = []
    for shorter in (len(chars), len(chars) - 1):
        half = shorter // 2
        for side, part in ((0, chars[:half]), (1, chars[len(chars) - half :])):
            keys.append(xxhash.xxh3_64_intdigest(part.encode("utf-8", "replace"), seed=2 * shorter + side))
    return keys


_LINE = pa.struct([("place", pa.int32()), ("key", pa.binary()), ("halves", pa.list_(pa.int64()))])


def _splitter(min_chars: int):
    def lines_of(texts: pa.Array) -> pa.Array:
        out = []
        for raw in texts.to_pylist():
            own = []
            for place, line in enumerate((raw or b"").split(b"\n")):
                line = line.strip(BLANKS)
                if line:
                    long = len(line) >= min_chars and len(line.decode("utf-8", "replace")) >= min_chars
                    halves = np.array(half_keys(line), dtype=np.uint64).view(np.int64) if long else None
                    own.append({"place": place, "key": xxhash.xxh3_128_digest(line), "halves": halves})
            out.append(own)
        return pa.array(out, type=pa.list_(_LINE))

    return lines_of


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashed keys, kinds) of a line: OWN for its text, LESS for each single deletion, AT for each with its position."""
    codes = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    size = len(codes)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
    weighted = codes * powers[::-1]
    ends = np.cumsum(weighted)
    # the characters before a gap move one power down; instead, all the others are moved one up
    without = ends - weighted + (ends[-1:] - ends) * _BASE
    less = mixed(without + mixed(np.full(size, size - 1, dtype=np.uint64)))
    at = mixed(less + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = mixed(ends[-1:] * _BASE + mixed(np.full(1, size, dtype=np.uint64)))
    less, at = np.unique(less), np.unique(at)
    keys = np.concatenate([own, less, at]).view(np.int64)
    return keys, np.repeat(np.array([OWN, LESS, AT], dtype=np.int32), [1, len(less), len(at)])


_KEYS = pa.list_(pa.struct([("variant", pa.int64()), ("kind", pa.int32())]))


def _keys_of(lines: pa.Array) -> pa.Array:
    found = [deletion_keys(line) for line in lines.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(keys) for keys, _ in found])]).astype(np.int32)
    flat = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=t) for i, t in enumerate((np.int64, np.int32))]
    structs = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], fields=list(_KEYS.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), structs)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, gone): for each document that loses lines, their numbers from 0."""
    prepare_python(docs.sparkSession)
    keyed = docs.select("doc_id", F.unhex(text_key()).alias("text_key"), "text")
    cut = F.arrow_udf(_splitter(min_chars), "array<struct<place: int, key: binary, halves: array<bigint>>>")(utf8("text"))
    lines = stage(keyed.select("doc_id", "text_key", F.explode(cut).alias("l")).select("doc_id", "text_key", "l.*"), "line_places", "snappy")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "place")
    kinds = stage(
        lines.groupBy("key").agg(
            F.min(order).alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves")
        ),
        "line_kinds",
    )
    halves = kinds.filter(F.col("halves").isNotNull()).select("key", "first", F.explode("halves").alias("half"))
    shared = stage(halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"), "line_halves")
    near = stage(
        halves.join(broadcast_if_small(shared, BROADCAST_BYTES), "half", "left_semi").select("key", "first").distinct(), "line_near"
    )
    firsts = near.select("key", "first", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_text"))
    at_first = (F.col("text_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    line = F.element_at(F.split("text", "\n"), F.col("first.place") + 1)
    texts = stage(
        keyed.join(broadcast_if_small(firsts, BROADCAST_BYTES), at_first)
        .select("key", "first", F.trim(line, F.lit(BLANKS.decode())).alias("line")).dropDuplicates(["key"]),
        "line_texts", "snappy",
    )
    variants = texts.select("key", F.explode(F.arrow_udf(_keys_of, "array<struct<variant: bigint, kind: int>>")("line")).alias("v"))
    held = stage(variants.select("key", "v.*"), "line_variants", "snappy")
    meeting = stage(held.groupBy("variant").agg(F.count("*").alias("n")).filter("n > 1").select("variant"), "line_meeting")
    met = stage(
        held.join(broadcast_if_small(meeting, BROADCAST_BYTES), "variant").join(
            broadcast_if_small(texts.select("key", "first"), BROADCAST_BYTES), "key"
        ),
        "line_met",
    )
    found = stage(_earlier(met), "line_found")
    line_of = texts.select("key", F.col("line").alias("text"))
    confirmed = (
        found.join(broadcast_if_small(line_of, BROADCAST_BYTES), "key").withColumnRenamed("text", "own")
        .join(broadcast_if_small(line_of.withColumnRenamed("key", "witness"), BROADCAST_BYTES), "witness")
        .filter(F.levenshtein("own", "text", 1).between(0, 1)).select("key").distinct()
    )
    near_copies = stage(confirmed.withColumn("near", F.lit(True)), "line_confirmed")
    judged = stage(
        kinds.select("key", "first", "times").join(broadcast_if_small(near_copies, BROADCAST_BYTES), "key", "left").filter(
            (F.col("times") > 1) | F.col("near")
        ).select("key", F.when(F.col("near"), F.lit(None)).otherwise(F.col("first")).alias("stays")),
        "line_judged",
    )
    occurrences = lines.select("doc_id", "text_key", "place", "key").join(broadcast_if_small(judged, BROADCAST_BYTES), "key")
    own = (
        F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))
        & (F.col("place") == F.col("stays.place"))
    )
    gone = occurrences.filter(F.col("stays").isNull() | ~own)
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("place")).alias("gone"))


def _earlier(met: DataFrame) -> DataFrame:
    """(key, witness): lines and the earliest line that a variant ties them to, where that came earlier.

    Under a position, all lines tie to each other. Under a plain key, the line that is the key ties to
    those one character longer, but these do not tie to each other.
    """
    row = F.struct("first", "key")
    lowest = [F.min(F.when(F.col("kind") == kind, row)).alias(f"k{kind}") for kind in (OWN, LESS, AT)]
    firsts = met.groupBy("variant").agg(*lowest)
    other = F.when(F.col("kind") == OWN, F.col(f"k{LESS}")).when(F.col("kind") == LESS, F.col(f"k{OWN}")).otherwise(F.col(f"k{AT}"))
    tied = met.join(broadcast_if_small(firsts, BROADCAST_BYTES), "variant").select("key", "first", other.alias("other"))
    return tied.filter(F.col("other.first") < F.col("first")).select("key", F.col("other.key").alias("witness")).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, name: str = "deduped") -> DataFrame:
    """Adds `name`: struct(text, n_lines, n_gone), the text without its repeated lines."""
    gone = repeated_lines(docs, min_chars).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"), F.col("gone").alias("_gone")
    )
    rows = docs.drop(name).select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.unhex(text_key()).alias("_key"))
    joined = rows.join(
        broadcast_if_small(stage(gone, "line_gone"), BROADCAST_BYTES),
        (F.col("_key") == F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left",
    )
    parts = F.split(F.col("_row.text"), "\n")
    none = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    kept = F.filter(parts, lambda line, place: ~F.array_contains(none, place))
    return joined.select(
        "_row.*",
        F.struct(
            F.array_join(kept, "\n").alias("text"), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.size(none).alias("n_gone")
        ).alias(name),
    )
