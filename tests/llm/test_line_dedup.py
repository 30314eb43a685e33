"""Lines against all earlier lines, by edit distance."""

import hashlib
import random

import pytest

from rankloom.llm import line_dedup
from rankloom.llm.line_dedup import MIN_CHARS, dedup_lines, deletion_keys


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(
        short[:i] + short[i + (len(a) == len(b)) :] == long[:i] + long[i + 1 :] for i in range(len(long))
    )


def brute_force(rows):
    """For each row the numbers of the lines that go."""
    lines = []
    for doc, text in rows:
        digest = hashlib.md5((text or "").encode()).digest()
        for place, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r"):
                lines.append(((doc is None, doc or 0, digest, place), line.strip(" \t\r")))
    first = {}
    for order, line in lines:
        first[line] = min(first.get(line, order), order)
    near = {
        line: any(
            len(line) >= MIN_CHARS and len(other) >= MIN_CHARS and first[other] < first[line] and within_one(line, other)
            for other in first if other != line
        )
        for line in first
    }
    return near, first


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(8)
    bases = ["the quick brown fox jumps", "a line of some length here", "completely different t\u00e9xt", "short", "tiny one"]

    def changed(line):
        at, letter = chance.randrange(len(line)), chance.choice("abc ")
        return chance.choice([line, line[:at] + line[at + 1 :], line[:at] + letter + line[at:], line[:at] + letter + line[at + 1 :], line + " "])

    made = [
        (chance.choice([n, n, None]), "\n".join(changed(changed(chance.choice(bases))) for _ in range(chance.randrange(5))))
        for n in range(150)
    ]
    return [*made, made[0], (500, None), (501, ""), (502, " \n\t")]


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_matches_all_pairs(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    near, first = brute_force(rows)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.text is None:
            assert row.deduped.text is None and row.deduped.n_lines == row.deduped.n_gone == 0
            continue
        digest = hashlib.md5(row.text.encode()).digest()
        kept = []
        for place, line in enumerate(row.text.split("\n")):
            own = line.strip(" \t\r")
            order = (row.doc_id is None, row.doc_id or 0, digest, place)
            if not own or (not near[own] and first[own] == order):
                kept.append(line)
        assert row.deduped.text == "\n".join(kept)
    assert sum(near.values()) > 20


def test_lines_within_one_edit_share_a_key():
    keys = lambda s: set(zip(*map(list, deletion_keys(s))))
    plain = lambda s: {k for k, kind in keys(s) if kind < 2}
    assert plain("abcd") & plain("abd") and plain("abcd") & plain("abcdx") and keys("abcd") & keys("axcd")
    assert not keys("abcd") & keys("dcba") and len(deletion_keys("a")[0]) == 3


def test_edge_cases(edge_docs, empty_docs):
    got = dedup_lines(edge_docs)
    assert got.count() == edge_docs.count() and set(edge_docs.columns) <= set(got.columns)
    assert dedup_lines(empty_docs).count() == 0
