"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of ten consecutive words of the test items (a shorter item is one
window), over texts normalised to lower-case words with single spaces. Each document is scanned once;
matches are mapped back to words and to character offsets of the original text. No document text is
shuffled. The items are broadcast in blocks of a counted size; a benchmark beyond one block is scanned
block by block with the same code.

Defined cases: null or wordless texts have no words and no hits; items without words have no windows; a
null item id counts as the empty string; items with equal ids are one item; repeated document rows are
each judged; an empty benchmark hits nothing. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import prepare_python, utf8, words_of

WINDOW = 10
BLOCK_BYTES = 16 * 1024 * 1024
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPAN = pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(_SPAN))])
FOUND_TYPE = "struct<n_words: bigint, n_hit: bigint, spans: array<struct<item: string, start: bigint, `end`: bigint>>>"
_AUTOMATA: dict[str, ahocorasick.Automaton | None] = {}


def windows(words: list[bytes], size: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


def build_automaton(items: list[tuple[str, bytes]], size: int) -> ahocorasick.Automaton | None:
    """Automaton over the windows, each with its word count and the items that hold it; None without any."""
    holders: dict[str, tuple[int, set[str]]] = {}
    for item, raw in items:
        for window in windows(words_of(raw), size):
            pattern = " " + b" ".join(window).decode("latin-1") + " "
            holders.setdefault(pattern, (len(window), set()))[1].add(item)
    if not holders:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, (count, names) in holders.items():
        automaton.add_word(pattern, (count, tuple(sorted(names))))
    automaton.make_automaton()
    return automaton


def offsets(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of each word in characters of the original text."""
    places, at, chars = [], 0, 0
    for match in _WORD.finditer(raw):
        start = chars + len(raw[at : match.start()].decode("utf-8", "replace"))
        end = start + len(match.group().decode("utf-8", "replace"))
        places.append((start, end))
        at, chars = match.end(), end
    return places


def scan(raw: bytes | None, automaton: ahocorasick.Automaton | None) -> dict:
    """Words, hit words and the matched spans of one text."""
    folded = words_of(raw)
    found = {"n_words": len(folded), "n_hit": 0, "spans": []}
    if automaton is None or not folded:
        return found
    line = b" " + b" ".join(folded) + b" "
    matches = list(automaton.iter(line.decode("latin-1")))
    if not matches:
        return found
    spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    lasts = np.searchsorted(spaces, np.array([end for end, _ in matches])) - 1
    hit, places = np.zeros(len(folded), dtype=bool), offsets(raw)
    runs: dict[str, list[list[int]]] = {}
    for last, (_, (count, names)) in zip(lasts.tolist(), matches):
        first = last - count + 1
        hit[first : last + 1] = True
        for name in names:
            own = runs.setdefault(name, [])
            if own and first <= own[-1][1] + 1:
                own[-1] = [min(first, own[-1][0]), max(last, own[-1][1])]
            else:
                own.append([first, last])
    found["n_hit"] = int(hit.sum())
    found["spans"] = [
        {"item": name, "start": places[a][0], "end": places[b][1]} for name in sorted(runs) for a, b in runs[name]
    ]
    return found


def _scanner(items, size: int):
    key = uuid.uuid4().hex

    @F.arrow_udf(FOUND_TYPE)
    def scanner(texts: pa.Array) -> pa.Array:
        if key not in _AUTOMATA:
            _AUTOMATA[key] = build_automaton(items.value, size)
        automaton = _AUTOMATA[key]
        return pa.array([scan(raw, automaton) for raw in texts.to_pylist()], type=_FOUND)

    return scanner


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "found",
) -> DataFrame:
    """Adds `name`: struct(n_words, n_hit, spans) with one span for each run of an item's matched words.

    With more than one block of items, n_hit is counted over the merged word runs of all blocks.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), utf8(item_text).alias("raw")
    ).filter(F.col("raw").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("raw") + F.lit(64)), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(row["item"], bytes(row["raw"])) for row in own.collect()])
        parts.append(_scanner(held, size)(utf8(text)))
    if blocks == 1:
        return docs.withColumn(name, parts[0])
    columns = [f"_part{i}" for i in range(blocks)]
    found = docs.withColumns(dict(zip(columns, parts)))
    spans = F.flatten(F.array(*[F.col(c)["spans"] for c in columns]))
    merged = found.withColumn("_spans", spans)
    counted = F.arrow_udf(_count_hit, "bigint")(F.col("_spans"), utf8(text))
    return merged.withColumn(
        name,
        F.struct(F.col(columns[0])["n_words"].alias("n_words"), counted.alias("n_hit"), F.col("_spans").alias("spans")),
    ).drop(*columns, "_spans")


def _count_hit(spans: pa.Array, texts: pa.Array) -> pa.Array:
    out = []
    for own, raw in zip(spans.to_pylist(), texts.to_pylist()):
        if not own:
            out.append(0)
            continue
        places = np.array(offsets(raw))
        hit = np.zeros(len(places), dtype=bool)
        for span in own:
            hit |= (places[:, 0] >= span["start"]) & (places[:, 1] <= span["end"])
        out.append(int(hit.sum()))
    return pa.array(out, type=pa.int64())


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items_sha256 and contaminated; one row for each input row."""
    found = find_passages(docs, benchmark, name="_found_passages", **options)
    names = F.array_sort(F.array_distinct(F.transform(F.col("_found_passages")["spans"], lambda s: s["item"])))
    return found.select(
        "doc_id",
        F.col("_found_passages")["n_words"].alias("n_words"),
        F.col("_found_passages")["n_hit"].alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_found_passages")["n_hit"] > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, with their own columns, that hold no test passage."""
    found = find_passages(docs, benchmark, name="_found_passages", **options)
    return found.filter(F.col("_found_passages")["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
