"""Components and groups."""

import random

import numpy as np
import pyarrow as pa

from rankloom.llm.links import connected_components, groups_of, local_roots, pairs_of


def test_components_match_union_find(spark):
    chance = random.Random(9)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    edges += [(2000, 2000 + i) for i in range(1, 80)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    linked = {i for e in edges if e[0] != e[1] for i in e}
    assert {r.node: r.root for r in got} == {i: root(i) for i in linked} and len(got) == len(linked)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_span_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "x": list(range(len(k)))}) for k in ([], [1, 1, 2], [2], [2, 3, 1], [])]
    assert [(t.column("k")[0].as_py(), t.num_rows) for t in groups_of(iter(batches), 1)] == [(1, 2), (2, 3), (3, 1), (1, 1)]


def test_pairs_are_complete():
    for count in (1, 2, 700):
        pairs = [p for a, b in pairs_of(np.zeros(count, dtype=int), False) for p in zip(a.tolist(), b.tolist())]
        assert sorted(pairs) == [(a, b) for a in range(count) for b in range(a + 1, count)]
    block = np.array([1, 0, 1, 0, 0])
    pairs = [p for a, b in pairs_of(block, True) for p in zip(a.tolist(), b.tolist())]
    assert sorted(map(sorted, pairs)) == sorted(sorted((a, b)) for a in (1, 3, 4) for b in (0, 2))
    assert list(pairs_of(np.array([2, 2]), True)) == [] or all(len(a) == 0 for a, _ in pairs_of(np.array([2, 2]), True))


def test_local_roots():
    assert local_roots(6, np.array([5, 3, 4]), np.array([3, 1, 0])).tolist() == [0, 1, 2, 1, 0, 1]
