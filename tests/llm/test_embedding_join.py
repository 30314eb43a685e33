"""The pigeonhole join against all pairs."""

import numpy as np
import pytest

from rankloom.llm import embedding_join
from rankloom.llm.embedding_join import block_bounds, near_duplicates, rotation, share


def all_pairs(rows, threshold=0.9):
    vectors = {}
    for number, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own = np.array(v)
            own = own / np.abs(own).max()
            vectors[number] = own / np.sqrt(own @ own)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in vectors:
        for b in vectors:
            if a < b and len(vectors[a]) == len(vectors[b]) and vectors[a] @ vectors[b] >= threshold - 1e-12:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            low[root(i)] = min(low.get(root(i), vec), vec)
    return links, [low.get(root(i)) for i in range(len(rows))]


def clustered(dims, seed):
    chance = np.random.default_rng(seed)
    out = []
    for size, noise in ((30, 0.3), (10, 0.05), (25, 0.6)):
        centre = chance.standard_normal(dims)
        out += [(centre + noise * chance.standard_normal(dims) * chance.random()).tolist() for _ in range(size)]
    return out + [chance.standard_normal(dims).tolist() for _ in range(60)]


@pytest.mark.parametrize("block_rows,blocks,grid", [(8192, 4, 2), (16, 4, 2), (16, 8, 1), (8192, 1, 3)])
def test_matches_all_pairs(spark, monkeypatch, block_rows, blocks, grid):
    monkeypatch.setattr(embedding_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(embedding_join, "BROADCAST_BYTES", 0 if block_rows == 16 else 1 << 25)
    rows = list(enumerate(clustered(16, 1) + clustered(3, 2) + clustered(1, 3)[:4]))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (5, rows[5][1]), (None, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None, 1.0]), (2005, [float("inf"), 1.0])]
    rows += [(2006, [1e300, 1e300, 0.0]), (2007, [1e-300, 1e-300, 0.0]), (2008, [10.0, 0.0, 0.0, 0.0, 0.0]), (2009, [9.0, 4.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_duplicates(frame, blocks=blocks, grid=grid).collect()
    links, components = all_pairs(rows)
    want = sorted(map(str, zip((i for i, _ in rows), links, components)))
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in got))) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and max(links) > 8


def test_shares_add_up_and_rotation_is_orthogonal():
    for dims in (1, 3, 64):
        bounds = block_bounds(dims, 4)
        assert sum(b - a for a, b in bounds) == dims
        assert abs(sum(share(b, dims, 0.9) for b in bounds) - 0.2) < 1e-8
        assert np.allclose(rotation(dims) @ rotation(dims).T, np.eye(dims))


def test_floats_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.95, 0.1], "b"), (3, [0.0, 1.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string")
    assert [tuple(r) for r in near_duplicates(frame).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert near_duplicates(frame.limit(0)).count() == 0
