"""Product codes for vectors, assigned through memoised grid cells.

Valid vectors become integers (floor(1024 x) per component) and are cut into `PARTS` equal consecutive parts;
each part position has a codebook of up to `ENTRIES` entries, first the parts of the vectors with the smallest
vec_ids. Every round assigns each part to its nearest entry (squared distance, ties to the lower index) and
moves each entry to the componentwise floor of the mean of its parts; entries without parts stay.

Assignment is the work. A part falls into a coarse grid cell (its components shifted right by `CELL_BITS`).
For a cell's box, an entry whose least possible distance to the box exceeds the smallest greatest distance of
any entry can never be nearest, nor tie, for a part inside it. The entries that survive are cached by a hash
of the cell for the rest of the task, and only they are evaluated exactly; the more vectors share cells, the
fewer entries each costs. Tasks send one row per (part, entry, component) of sums and counts, so the update
is a small aggregation; the codebooks (entries x dimensions integers) are the only thing that reaches the
driver or is broadcast, and they do not grow with the rows. The valid rows are written once and read by
every round, so a lost executor repeats one round's tasks.

Defined cases: null vectors and vectors with a null, NaN, infinite or too large component (|x| >= 2^20, where
64-bit squared distances could overflow) are dropped, and so are vectors whose length differs from that of
the vector with the smallest vec_id (that length must divide by `PARTS`). With fewer than `ENTRIES` valid
rows the codebooks have fewer entries. Ties of vec_id are ordered by the vector. A null label is a label of its
own for `label_error`. Repeated rows are coded as often as they occur. An empty table gives no rows. Only
vec_id, the vector and the label are read, so other columns do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import stage
from rankloom.llm.text import prepare_python
from rankloom.plans.joins import broadcast_if_small

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CELL_BITS = 8
LIMIT = float(1 << 20)

SUMS = "part int, entry int, position int, total long, count long"
CODES = "vec_id long, label int, code string, error long"


def valid_rows(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, q): the valid rows with their integer components."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("int").alias("label"),
        F.when(F.col(vector).isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))).alias("q"),
    ).filter(F.col("q").isNotNull())
    first = rows.orderBy("vec_id", "q").select(F.size("q").alias("d")).first()
    if first is None:
        return rows
    if first.d % PARTS:
        raise ValueError(f"vectors of {first.d} components cannot be cut into {PARTS} equal parts")
    return rows.filter(F.size("q") == first.d)


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray | None:
    """(PARTS, entries, d / PARTS) integers: the parts of the rows with the smallest vec_ids; None without rows."""
    head = rows.orderBy("vec_id", "q").limit(entries).select("q").collect()
    if not head:
        return None
    return np.asarray([r.q for r in head], dtype=np.int64).reshape(len(head), PARTS, -1).transpose(1, 0, 2).copy()


def candidates(cell: np.ndarray, book: np.ndarray, bits: int) -> np.ndarray:
    """Indexes (ascending) of the entries that can be nearest to some integer point of the cell's box."""
    low = cell << bits
    high = low + (1 << bits) - 1
    least = ((np.maximum(low - book, 0) + np.maximum(book - high, 0)) ** 2).sum(1)
    most = np.maximum((book - low) ** 2, (book - high) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def assign(parts: np.ndarray, book: np.ndarray, memo: dict, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part, evaluated exactly against its cell's cached candidates."""
    n = len(parts)
    entry = np.zeros(n, dtype=np.int64)
    distance = np.zeros(n, dtype=np.int64)
    if not n:
        return entry, distance
    cells, inverse = np.unique(parts >> bits, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    order = np.argsort(inverse, kind="stable")
    bounds = np.searchsorted(inverse[order], np.arange(len(cells) + 1))
    for number, cell in enumerate(cells):
        key = cell.tobytes()
        near = memo.get(key)
        if near is None:
            near = memo[key] = candidates(cell, book, bits)
        rows = order[bounds[number] : bounds[number + 1]]
        gaps = ((parts[rows, None, :] - book[near][None, :, :]) ** 2).sum(-1)
        best = gaps.argmin(1)
        entry[rows] = near[best]
        distance[rows] = gaps[np.arange(len(rows)), best]
    return entry, distance


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    q = batch.column("q")
    width = len(q[0]) if len(q) else 0
    return np.asarray(q.flatten(), dtype=np.int64).reshape(len(q), width)


def _assign_all(vectors: np.ndarray, books: np.ndarray, memos: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    width = books.shape[2]
    entries = np.zeros((len(vectors), PARTS), dtype=np.int64)
    errors = np.zeros(len(vectors), dtype=np.int64)
    for part in range(PARTS):
        got, gap = assign(vectors[:, part * width : (part + 1) * width], books[part], memos[part])
        entries[:, part] = got
        errors += gap
    return entries, errors


def round_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, position, total, count) over all rows for the next codebooks."""
    size, width = books.shape[1], books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [{} for _ in range(PARTS)]
        total = np.zeros((PARTS, size, width), dtype=np.int64)
        count = np.zeros((PARTS, size), dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch)
            entries, _ = _assign_all(vectors, books, memos)
            for part in range(PARTS):
                np.add.at(total[part], entries[:, part], vectors[:, part * width : (part + 1) * width])
                count[part] += np.bincount(entries[:, part], minlength=size)
        part, entry, position = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(position, pa.int32()),
                pa.array(total[part, entry, position]), pa.array(count[part, entry] * (position == 0)),
            ],
            names=["part", "entry", "position", "total", "count"],
        )

    return rows.select("q").mapInArrow(sums, SUMS)


def next_codebooks(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    summed = round_sums(rows, books).groupBy("part", "entry", "position").agg(
        F.sum("total").alias("total"), F.sum("count").alias("count")
    ).collect()
    moved = books.copy()
    counts = {(r.part, r.entry): r["count"] for r in summed if r.position == 0}
    for r in summed:
        moved[r.part, r.entry, r.position] = r.total // counts[(r.part, r.entry)]
    return moved


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def product_codes(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    rounds: int = ROUNDS,
    entries: int = ENTRIES,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of every valid row."""
    spark = vectors.sparkSession
    prepare_python(spark)
    rows = stage(valid_rows(vectors, vec_id, vector, label), "codebook_rows")
    books = first_codebooks(rows, entries)
    if books is None:
        return spark.createDataFrame([], CODES).select(
            "vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"),
            F.lit(None).cast("string").alias("codebooks_sha256"), "label",
        )
    for _ in range(rounds):
        books = next_codebooks(rows, books)
    final = books

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [{} for _ in range(PARTS)]
        for batch in batches:
            entries_, errors = _assign_all(_matrix(batch), final, memos)
            text = ["".join(f"{e:02x}" for e in row) for row in entries_.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors)],
                names=["vec_id", "label", "code", "error"],
            )

    coded = stage(rows.mapInArrow(codes, CODES), "codebook_codes")
    by_label = broadcast_if_small(
        coded.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error"))
    )
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["same_label"]), "left")
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(final)).alias("codebooks_sha256"), "label"
    )
