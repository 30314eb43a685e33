"""Token pieces packed into sequences by bound-certified repacking.

Every document becomes its token ids (a public tokenizer file, no special tokens) followed by `END_ID`; only
a document longer than a sequence is cut, into pieces of `length` ids and a shorter last piece. Ids stay in
their task: a piece travels as (row, piece, doc_id, start, length, crc32 of its little-endian 32-bit ids).

Packing runs in rounds. The pool (at first all pieces) is dealt by a hash of the piece and the round into
groups of at most `group_tokens` tokens and `group_items` pieces, so no group grows with the data and a hot
document's pieces spread over all groups. Each group is packed best-fit-decreasing: pieces longest first,
each into the open sequence with the least room that still takes it, found in a segment tree over free room.
A lower bound from dual-feasible functions (the L1 bound, the Fekete-Schepers family u^(k) and the
Martello-Toth family f_lambda) certifies a group when its count of sequences equals the bound. Full
sequences are final. A certified group cannot do with fewer sequences, so only its emptiest sequence, which
might still fill up with other groups' pieces, is reopened; an uncertified group reopens every sequence with a
gap. Reopened pieces form the next round's pool: they exchange places with pieces of other groups and
best-fit-decreasing runs again. When the pool fits one group, or after `rounds` rounds, the last packing is kept. Each round is written to the shared folder, so a lost
executor repeats one round's tasks only.

Defined cases: a null text is empty and so one id (`END_ID`); a null doc_id stays null; repeated rows are
packed as often as they occur, each its own pieces; an empty table gives no rows; other columns are not read
and do not clash. Sequence ids are unique: (round, group, place of the sequence in the group). Offsets within
a sequence are gapless from 0, in the order best fit placed the pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import stage
from rankloom.llm.text import prepare_python
from rankloom.llm.word_ids import WordIds

LENGTH = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
GROUP_TOKENS = 1 << 24
GROUP_ITEMS = 1 << 18
ROUNDS = 4
#: Parameters k of the Fekete-Schepers functions tried for the lower bound.
FS_ORDERS = range(1, 11)
#: At most this many thresholds lambda of the Martello-Toth functions are tried.
MT_THRESHOLDS = 64
BIN_BITS = 26
GROUP_BITS = 33

PIECES = "row long, piece int, doc_id {id}, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, final boolean"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def piece_rows(texts: pa.Array, path: str, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of a batch of texts: columns (text's number in the batch, piece, start, length, crc32)."""
    ids, sizes = _tokenizer(path).encode(texts)
    ids = np.insert(ids, np.cumsum(sizes), np.array(END_ID, dtype="<u4"))
    sizes = sizes + 1
    pieces = -(-sizes // length)
    index = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * length
    lengths = np.minimum(sizes[index] - start, length)
    ends = np.cumsum(lengths).tolist()
    crc = np.fromiter((zlib.crc32(ids[a:b].data) for a, b in zip([0, *ends], ends)), dtype=np.int64, count=len(ends))
    return index, piece, start, lengths, crc


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, piece, doc_id, start, length, ids_crc32) of every document; `row` numbers the input rows."""
    prepare_python(docs.sparkSession)
    path = path or tokenizer_path()
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, piece, start, lengths, crc = piece_rows(batch.column("text"), path, length)
            index = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(index),
                    pa.array(piece.astype(np.int32)),
                    batch.column("doc_id").take(index),
                    *[pa.array(column) for column in (start, lengths, crc)],
                ],
                names=["row", "piece", "doc_id", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(tokenise, PIECES.format(id=id_type))


class RoomTree:
    """Count of open sequences by free room; finds the least room of at least `need` in O(log length)."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def pop_fit(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the open sequence with the least room >= need, taken out; None if none."""
        node = need + self.size
        if not self.count[node]:
            while not (node & 1 == 0 and self.count[node + 1]):
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece and the free room of each sequence."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    tree, rooms = RoomTree(length), []
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    for item in order:
        need = int(lengths[item])
        fit = tree.pop_fit(need)
        if fit is None:
            rooms.append(length)
            fit = (length, len(rooms) - 1)
        room, place = fit
        sequence[item], offset[item] = place, length - room
        rooms[place] = room - need
        if room > need:
            tree.put(room - need, place)
    return sequence, offset, np.asarray(rooms, dtype=np.int64)


def lower_bound(lengths: np.ndarray, length: int) -> int:
    """Least number of sequences any packing of these pieces needs, from dual-feasible functions."""
    if not len(lengths):
        return 0
    sizes = lengths.astype(np.int64)
    best = -(-int(sizes.sum()) // length)
    for k in FS_ORDERS:
        scaled = (k + 1) * sizes
        whole = scaled % length == 0
        value = np.where(whole, sizes * k, (scaled // length) * length)
        best = max(best, -(-int(value.sum()) // (k * length)))
    small = np.unique(sizes[sizes <= length // 2])
    if len(small) > MT_THRESHOLDS:
        small = small[np.linspace(0, len(small) - 1, MT_THRESHOLDS).astype(int)]
    for threshold in small:
        value = np.where(sizes > length - threshold, length, np.where(sizes >= threshold, sizes, 0))
        best = max(best, -(-int(value.sum()) // length))
    return best


def pack_group(group: pd.DataFrame, round_number: int, last: bool, length: int) -> pd.DataFrame:
    lengths = group["length"].to_numpy(dtype=np.int64)
    sequence, offset, rooms = best_fit_decreasing(lengths, length)
    certified = len(rooms) == lower_bound(lengths, length)
    room = rooms[sequence]
    if last:
        final = np.full(len(group), True)
    elif certified:
        # No packing of this group needs fewer sequences: only its emptiest sequence may still gain by exchange.
        final = (room == 0) | (sequence != int(np.argmax(rooms)))
    else:
        final = room == 0
    key = group["group"].iloc[0]
    ids = (np.int64(round_number) << (GROUP_BITS + BIN_BITS)) | (np.int64(key) << BIN_BITS) | sequence
    out = group.drop(columns=["group"]).copy()
    out["sequence_id"], out["offset"], out["final"] = ids, offset, final
    return out


def _packer(round_number: int, last: bool, length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, round_number, last, length)

    return run


def pack_pieces(
    pieces: DataFrame,
    length: int = LENGTH,
    rounds: int = ROUNDS,
    group_tokens: int = GROUP_TOKENS,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """Pieces with sequence_id and offset; every piece is placed once and no sequence exceeds `length`."""
    prepare_python(pieces.sparkSession)
    schema = PACKED.format(id=pieces.schema["doc_id"].dataType.simpleString())
    pool, done = stage(pieces, "repack_pool"), []
    for round_number in range(1, rounds + 1):
        size = pool.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
        if not size.n:
            break
        groups = max(1, -(-size.t // group_tokens), -(-size.n // group_items))
        last = groups == 1 or round_number == rounds
        dealt = pool.withColumn(
            "group", F.pmod(F.xxhash64("row", "piece", F.lit(round_number)), F.lit(groups))
        )
        packed = stage(
            dealt.groupBy("group").applyInPandas(_packer(round_number, last, length), schema),
            "repack_round",
        )
        done.append(packed.filter("final").drop("final"))
        if last:
            break
        pool = packed.filter(~F.col("final")).drop("sequence_id", "offset", "final")
    if not done:
        return pieces.sparkSession.createDataFrame([], schema).drop("final")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
