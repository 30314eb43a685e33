"""The join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from rankloom.llm import jaccard
from rankloom.llm.jaccard import fewest_agreements, join_documents, one_of_each, shingle_set, signature, verified

WORDS = [f"w{i}" for i in range(400)]


def brute_force(rows):
    """(n_links, component) by row number."""
    sets = [set(shingle_set((t or "").encode()).tolist()) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and shared and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return links, [low[root(i)] for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies():
    chance = random.Random(11)
    rows, number = [], 0
    for size in (1, 1, 2, 3, 40, 5):
        base = chance.choices(WORDS, k=chance.choice([6, 30, 150, 300]))
        for _ in range(size):
            own = list(base)
            for _ in range(chance.choice([0, 0, 1, 2, 3])):
                own[chance.randrange(len(own))] = chance.choice(WORDS)
            rows.append((number, chance.choice([" ", ", "]).join(own)))
            number += 1
    rows += [(900, None), (901, ""), (902, "w1 w2"), (903, "W1, w2!"), (904, "!!")]
    return rows


@pytest.mark.parametrize("block_rows,broadcast", [(2048, 1 << 25), (4, 0)])
def test_matches_all_pairs(spark, copies, monkeypatch, block_rows, broadcast):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", broadcast)
    got = {r.doc_id: r for r in join_documents(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    links, components = brute_force(copies)
    assert [got[i].n_links for i, _ in copies] == links
    assert [got[i].component_id for i, _ in copies] == components
    assert [got[i].kept for i, _ in copies] == [i == c for (i, _), c in zip(copies, components)]
    assert max(links) > 10


def test_pruning_limits_hardly_lose_a_pair():
    for seen, limit in zip(range(16, 129, 16), fewest_agreements(0.8, 1e-9)):
        draws = np.random.default_rng(seen).binomial(seen, 0.8, size=200_000)
        assert (draws < limit).sum() == 0
        assert limit > 0.1 * seen


def test_signature_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    agreed = (signature(jaccard.mixed(a)) == signature(jaccard.mixed(b))).mean()
    assert abs(agreed - 800 / 1200) < 0.15


def test_bit_rows_count_like_sets():
    chance = np.random.default_rng(4)
    sets = [np.unique(chance.integers(0, 60, size=40).astype(np.uint64)) for _ in range(30)]
    first, second = np.triu_indices(30, 1)
    sizes = np.array([len(s) for s in sets])
    by_bits = jaccard._shared_by_bits(first, second, sets)
    assert by_bits.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(first, second)]
    assert verified(first, second, sets, sizes, jaccard.Fraction(1, 2)).any()


def test_edge_cases(spark, edge_docs, empty_docs):
    got = join_documents(edge_docs)
    assert got.count() == edge_docs.count()
    kept = one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [r.text for r in kept.collect()]
    worded = [t for t in texts if t and t.split()]
    assert len(worded) == len(set(worded))
    assert sum(t is None for t in texts) == 2 and {"", " \t\n "} <= set(texts)
    assert join_documents(empty_docs).count() == 0 and one_of_each(empty_docs).count() == 0


@pytest.mark.parametrize("threshold", [0.45, 0.6, 0.8])
def test_recall_at_lower_thresholds(spark, threshold):
    """Bands follow the threshold: every pair at or above it is linked, checked against all pairs."""
    chance = random.Random(int(threshold * 100))
    rows, number = [], 0
    for _ in range(30):
        base = chance.choices(WORDS, k=40)
        for _ in range(4):
            own = list(base)
            for _ in range(chance.randrange(0, 9)):
                own[chance.randrange(len(own))] = chance.choice(WORDS)
            rows.append((number, " ".join(own)))
            number += 1
    sets = [set(shingle_set(t.encode()).tolist()) for _, t in rows]
    want = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            want[a] += 1
            want[b] += 1
    assert sum(want) > 0
    got = {r.doc_id: r.n_links for r in join_documents(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()}
    assert [got[i] for i, _ in rows] == want
    with pytest.raises(ValueError):
        jaccard.band_width(0.05)
