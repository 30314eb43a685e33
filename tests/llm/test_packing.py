"""Packing is lossless, full and within bounds."""

import random

import numpy as np

from rankloom.llm import packing
from rankloom.llm.packing import CapacityTree, best_fit_decreasing, encoding_of, pack_tokens, read_matrix, to_matrices, write_matrices


def test_tree_finds_the_smallest_capacity_that_fits():
    chance = random.Random(2)
    for most in (1, 7, 8, 100):
        tree, held = CapacityTree(most), []
        for row in range(300):
            if held and chance.random() < 0.5:
                need = chance.randint(1, most)
                fits = [c for c, _ in held if c >= need]
                got = tree.take(need)
                assert (got[0] if got else None) == min(fits, default=None)
                if got:
                    held.remove(got)
            else:
                capacity = chance.randint(1, most)
                tree.add(capacity, row)
                held.append((capacity, row))


def test_best_fit_decreasing():
    assert best_fit_decreasing([], 5) == []
    rows = best_fit_decreasing([3, 2, 5, 2, 3, 4, 1], 5)
    assert sorted(sum(rows, [])) == list(range(7)) and len(rows) == 4


def restored(rows):
    found = {}
    for row in rows:
        assert row.n_tokens == row.cu_seqlens[-1] <= len(row.ids) == len(row.position_ids)
        for doc, piece, a, b in zip(row.doc_ids, row.pieces, row.cu_seqlens, row.cu_seqlens[1:]):
            assert b > a and row.position_ids[a:b] == list(range(b - a))
            found.setdefault(doc, []).append((piece, row.ids[a:b]))
    return found


def test_round_trip(spark, edge_docs, empty_docs):
    with open(packing.VOCABULARY, "rb") as file:
        encoding = encoding_of(file.read())
    for buffer in (1 << 22, 500):
        rows = pack_tokens(edge_docs, length=128, buffer_tokens=buffer).collect()
        assert len({r.row_id for r in rows}) == len(rows)
        found = restored(rows)
        for doc in edge_docs.collect():
            if doc.doc_id in (3, None):
                continue  # several texts under one id
            whole = sum((ids for _, ids in sorted(found.get(doc.doc_id, []))), [])
            assert encoding.decode(whole) == (doc.text or "")
        total = sum(len(encoding.encode_ordinary(d.text or "")) for d in edge_docs.collect())
        assert sum(r.n_tokens for r in rows) == total
    assert pack_tokens(empty_docs).count() == 0


def test_rows_are_full(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    rows = pack_tokens(docs, length=512).collect()
    assert sum(r.n_tokens for r in rows) / (512 * len(rows)) > 0.97
    assert rows == pack_tokens(docs, length=512).collect()


def test_binary_matrices(spark, edge_docs, tmp_path):
    packed = pack_tokens(edge_docs, length=64).cache()
    write_matrices(packed, f"{tmp_path}/matrices", rows=16)
    by_first = {r.row_id: r for r in packed.collect()}
    seen = 0
    for matrix in spark.read.parquet(f"{tmp_path}/matrices").collect():
        ids, bounds, positions = read_matrix(matrix)
        for number in range(matrix.n_rows):
            row = by_first[matrix.matrix_id + number]
            assert ids[number].tolist() == row.ids and bounds[number].tolist() == row.cu_seqlens
            assert positions[number, : row.n_tokens].tolist() == row.position_ids[: row.n_tokens]
            seen += 1
    assert seen == len(by_first)
    assert to_matrices(packed.limit(0)).count() == 0
    assert np.dtype("<u4").itemsize == 4
