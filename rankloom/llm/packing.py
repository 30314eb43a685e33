"""Token ids in fixed-length rows: best-fit-decreasing packing without a shuffle.

Each task tokenises its texts and cuts a document longer than a row into full rows and a rest; nothing is
cut off. The rests collect in a buffer of a set number of tokens; a full buffer is packed, longest first,
each piece into the fullest row that still takes it. That row is found with a segment tree over free
capacity. Only the buffer is held in memory, and no text or token leaves its task, so a hot source or
document costs nothing extra and a lost task repeats alone.

A packed row has `length` ids (padded at the end), the bounds of its segments (`cu_seqlens`), the position
within its segment for every id (`position_ids`, which fall back to 0 at each bound), and for each segment
its document and the number of the piece. Row ids hold the partition and a counter: they are unique, and
equal between runs that read equal partitions.

Defined cases: null and empty texts have no ids and so no segment; a null doc_id stays null in `doc_ids`;
repeated rows are packed as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rankloom.llm.text import prepare_python

ROW_LENGTH = 2048
BUFFER_TOKENS = 1 << 22
ROWS_PER_BATCH = 256
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PAD_ID = 50256
#: Fixed value: how the rank files' vocabularies cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PACKED = (
    "row_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>,"
    " ids array<int>, position_ids array<int>"
)
MATRICES = "matrix_id long, n_rows int, row_length int, ids binary, cu_seqlens binary, row_segments binary, resets binary"

Piece = tuple[int | None, int, np.ndarray]


class CapacityTree:
    """Open rows by free capacity; finds the smallest capacity that holds a piece in O(log capacity)."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, removed from the tree; None if no open row has room."""
        node = need + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.width
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.width
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every length is between 1 and `capacity`."""
    tree, rows = CapacityTree(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = tree.take(lengths[piece])
        if fit is None:
            rows.append([])
            fit = (capacity, len(rows) - 1)
        free, row = fit
        rows[row].append(piece)
        if free > lengths[piece]:
            tree.add(free - lengths[piece], row)
    return rows


@lru_cache(maxsize=2)
def encoding_of(ranks: bytes) -> tiktoken.Encoding:
    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def cut(doc_id: int | None, ids: np.ndarray, length: int) -> list[Piece]:
    return [(doc_id, number, ids[at : at + length]) for number, at in enumerate(range(0, len(ids), length))]


def _batch(rows: list[list[Piece]], first_id: int, length: int, pad: int) -> pa.RecordBatch:
    ids = np.full((len(rows), length), pad, dtype=np.int32)
    places = np.zeros((len(rows), length), dtype=np.int32)
    bounds, sizes = [], []
    for number, row in enumerate(rows):
        ends = np.cumsum([0, *[len(p[2]) for p in row]])
        for (_, _, piece), a, b in zip(row, ends[:-1], ends[1:]):
            ids[number, a:b] = piece
            places[number, a:b] = np.arange(b - a)
        bounds.append(ends.tolist())
        sizes.append(int(ends[-1]))
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * length)
    columns = {
        "row_id": pa.array(range(first_id, first_id + len(rows)), type=pa.int64()),
        "n_tokens": pa.array(sizes, type=pa.int32()),
        "doc_ids": pa.array([[p[0] for p in row] for row in rows], type=pa.list_(pa.int64())),
        "pieces": pa.array([[p[1] for p in row] for row in rows], type=pa.list_(pa.int32())),
        "cu_seqlens": pa.array(bounds, type=pa.list_(pa.int32())),
        "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.ravel())),
        "position_ids": pa.ListArray.from_arrays(offsets, pa.array(places.ravel())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def pack_stream(
    documents: Iterator[tuple[int | None, np.ndarray]], length: int, pad: int, buffer_tokens: int, first_id: int
) -> Iterator[pa.RecordBatch]:
    """Packed rows of one task's documents."""
    full: list[list[Piece]] = []
    rests: list[Piece] = []
    held, row_id = 0, first_id

    def drained(rows: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
        nonlocal row_id
        for at in range(0, len(rows), ROWS_PER_BATCH):
            part = rows[at : at + ROWS_PER_BATCH]
            yield _batch(part, row_id, length, pad)
            row_id += len(part)

    def packed_rests() -> list[list[Piece]]:
        rows = best_fit_decreasing([len(p[2]) for p in rests], length)
        return [[rests[i] for i in row] for row in rows]

    for doc_id, ids in documents:
        for piece in cut(doc_id, ids, length):
            if len(piece[2]) == length:
                full.append([piece])
            else:
                rests.append(piece)
                held += len(piece[2])
        if len(full) >= ROWS_PER_BATCH:
            yield from drained(full)
            full = []
        if held >= buffer_tokens:
            yield from drained(packed_rests())
            rests, held = [], 0
    yield from drained(full + packed_rests())


def pack_tokens(
    docs: DataFrame, vocabulary: str = VOCABULARY, length: int = ROW_LENGTH, pad: int = PAD_ID,
    buffer_tokens: int = BUFFER_TOKENS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Packed rows (see above) of the whole texts of `docs`.

    `vocabulary` is a rank file that the driver reads and broadcasts (below 1 MB for 50,000 ids).
    """
    spark = docs.sparkSession
    prepare_python(spark)
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value)

        def documents():
            for batch in batches:
                for own_id, own_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if own_text:
                        yield own_id, np.array(encoding.encode_ordinary(own_text), dtype=np.int32)

        first_id = TaskContext.get().partitionId() << 40
        yield from pack_stream(documents(), length, pad, buffer_tokens, first_id)

    return docs.select(doc_id, text).mapInArrow(pack, PACKED)


def to_matrices(packed: DataFrame, rows: int = 64) -> DataFrame:
    """Packed rows as binary matrices of up to `rows` rows, little-endian, row by row.

    `ids` is n_rows x row_length of uint32; `cu_seqlens` (int32) are the rows' bounds one after another,
    `row_segments` (int32) how many segments each row has; `resets` (int64) the places in the flattened
    matrix where positions fall back to 0.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                count = part.num_rows
                ids = part.column(1).flatten().to_numpy().astype("<u4")
                bounds = part.column(2).to_pylist()
                width = len(ids) // count
                resets = [i * width + b for i, row in enumerate(bounds) for b in row[:-1]]
                values = [
                    part.column(0)[0].as_py(), count, width, ids.tobytes(),
                    np.array([b for row in bounds for b in row], dtype="<i4").tobytes(),
                    np.array([len(row) - 1 for row in bounds], dtype="<i4").tobytes(),
                    np.array(resets, dtype="<i8").tobytes(),
                ]
                types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
                names = ["matrix_id", "n_rows", "row_length", "ids", "cu_seqlens", "row_segments", "resets"]
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types)], names=names)

    return packed.select("row_id", "ids", "cu_seqlens").mapInArrow(build, MATRICES)


def write_matrices(packed: DataFrame, path: str, rows: int = 64) -> None:
    """Writes the binary matrices as a Parquet folder."""
    to_matrices(packed, rows).write.parquet(path)


def read_matrix(row) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(ids, bounds of each row, position ids) of one written matrix."""
    ids = np.frombuffer(row["ids"], dtype="<u4").reshape(row["n_rows"], row["row_length"])
    counts = np.frombuffer(row["row_segments"], dtype="<i4") + 1
    bounds = np.split(np.frombuffer(row["cu_seqlens"], dtype="<i4"), np.cumsum(counts)[:-1])
    resets = np.frombuffer(row["resets"], dtype="<i8")
    flat = np.arange(ids.size)
    positions = flat - resets[np.searchsorted(resets, flat, side="right") - 1]
    return ids, bounds, positions.reshape(ids.shape)
