"""Targets and samples against a plain loop."""

import hashlib
import math
import random
import re

import pytest

from rankloom.llm import mixture
from rankloom.llm.mixture import mix, mixed_documents, quality_weights, source_targets, word_count


def shared_out(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: target}, sharing the excess of stopped sources anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, stopped = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        total = sum(weight[s] for s in free)
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / total for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.fixture(scope="module")
def docs(spark):
    chance = random.Random(6)
    rows = []
    for number in range(900):
        source = chance.choices(["a", "b", "é", "\U0001f600", "￿", None, "big"], [1, 2, 1, 1, 1, 1, 6])[0]
        rows.append((number % 880, source, chance.choice([0, 1, 5, 40, 300]), chance.choice([0.5, 1.0, 2.0])))
    rows.append((None, "a", 7, 1.0))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")


def test_targets(docs):
    rows, frame = docs
    sizes = {}
    for _, source, size, _ in rows:
        sizes[source] = sizes.get(source, 0) + size
    got = {r.source: r for r in source_targets(frame.select("source", "size")).collect()}
    want = shared_out(sizes)
    assert got.keys() == want.keys()
    for source, target in want.items():
        assert got[source].source_size == sizes[source] and math.isclose(got[source].target, target, rel_tol=1e-9)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))


@pytest.mark.parametrize("rows_per_interval", [2000, 3])
def test_sample_follows_key_order(docs, rows_per_interval):
    rows, frame = docs
    got = mix(frame, rows_per_interval=rows_per_interval).collect()
    assert len(got) == len(rows)
    by_source = {}
    for row in got:
        by_source.setdefault(row.source, []).append(row)
    for own in by_source.values():
        target, total = own[0].target, own[0].source_size
        epochs, before = (int(target / total + 1e-12) if total else 0), 0

        def key(r):
            text = "" if r.doc_id is None else str(r.doc_id)
            u = (int(hashlib.md5(f"17:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / r.weight, r.doc_id is not None, r.doc_id or 0, r.size

        for row in sorted(own, key=key):
            extra = before + row.size / 2 <= target - epochs * total
            assert row.times == (epochs + extra if row.size else 0) and row.taken == row.times * row.size <= 2 * row.size
            before += row.size
        assert abs(sum(r.taken for r in own) - target) <= 300
    assert sorted(map(str, got)) == sorted(map(str, mix(frame).collect()))


def test_better_documents_come_first(spark):
    rows = [(i, "s", 1, 5.0 if i % 2 else 0.2) for i in range(4000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, size long, weight double"), share=0.3).collect()
    good, bad = (sum(r.times for r in got if r.doc_id % 2 == odd) for odd in (1, 0))
    assert good + bad == 1200 and good > 10 * bad


def test_word_count(spark, edge_docs):
    for row in edge_docs.select("text", word_count().alias("n")).collect():
        assert row.n == len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))


def test_edge_cases(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    weights = {r.doc_id: r.weight for r in quality_weights(edge_docs.select("doc_id", "text"), labels).collect()}
    assert (weights[1], weights[2], weights[None]) == (0.5, 1.0, 1.0)
    out = mixed_documents(edge_docs, labels)
    assert out.columns == edge_docs.columns and out.filter("size <> 'x'").count() == 0 and out.count() > 0
    assert mixed_documents(empty_docs, labels).count() == 0
    nothing = spark.createDataFrame([(1, None, 0, 1.0)], "doc_id long, source string, size long, weight double")
    assert mix(nothing).first().taken == 0
    assert mixture.WEIGHTS == (3, 1, 2)
