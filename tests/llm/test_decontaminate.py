"""One automaton against a plain search for every window."""

import hashlib
import random
import re

import pytest

from rankloom.llm.decontaminate import contamination, drop_contaminated, find_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = ["red", "blue", "green", "\u00e9t\u00e9", "sun", "Moon", "42"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items):
    own = words(text)
    hit, names = set(), set()
    for item, passage in items:
        parts = words(passage)
        size = min(10, len(parts))
        for window in (parts[i : i + size] for i in range(len(parts) - size + 1)) if parts else ():
            for at in range(len(own) - size + 1):
                if own[at : at + size] == window:
                    hit.update(range(at, at + size))
                    names.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit)


@pytest.fixture(scope="module")
def case(spark):
    chance = random.Random(3)
    line = lambda n: " ".join(chance.choices(VOCABULARY, k=n))
    items = [(1, line(14)), (2, line(11)), (10, "sun; MOON!"), (10, line(10)), (None, line(12)), (5, None), (6, " .. ")]
    docs = [(i, line(chance.randrange(0, 40))) for i in range(60)]
    docs += [(100 + i, f"{line(9)}, {text.upper().replace(' ', '--')} {line(3)}") for i, (_, text) in enumerate(items) if text]
    docs += [(7, None), (8, ""), (100, docs[60][1])]
    return items, docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 24, 100])
def test_matches_plain_search(case, block_bytes):
    items, docs, frame, benchmark = case
    got = sorted(tuple(r) for r in contamination(frame, benchmark, block_bytes=block_bytes).collect())
    assert got == sorted((i, *expected(text, items)) for i, text in docs)
    assert any(r[5] for r in got)


def test_spans_point_into_the_original_text(spark):
    docs = spark.createDataFrame([(1, "\u00dcber: one, TWO \u2014 three. one two")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "One two")], "item_id long, text string")
    row = find_passages(docs, items).first()
    assert [row.text[s.start : s.end] for s in row.found.spans] == ["one, TWO", "one two"]


def test_only_clean_documents_stay(case):
    items, docs, frame, benchmark = case
    kept = sorted(r.doc_id for r in drop_contaminated(frame, benchmark).collect())
    assert kept == sorted(i for i, text in docs if not expected(text, items)[4])


def test_edge_cases(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in contamination(edge_docs, none).collect()} == {False}
    assert drop_contaminated(edge_docs, none).columns == edge_docs.columns
    assert drop_contaminated(edge_docs, none).count() == edge_docs.count()
    assert contamination(empty_docs, none).count() == 0
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert sorted(r.doc_id for r in contamination(edge_docs, items).filter("contaminated").collect()) == [7, 8]
