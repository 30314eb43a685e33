import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import passages
from rankloom.sources import collections

WIDTH = 3


def brute_force(documents, queries):
    def runs(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}

    return sorted(
        {(q, d) for q, asked in queries for d, text in documents if runs(asked) & runs(text)}, key=str
    )


@pytest.fixture(scope="module")
def rows():
    """Documents of which many open alike; ids that are null, that come twice and that ask twice."""
    pick = random.Random(7)
    text = lambda n: " ".join(pick.choice("abcdef") for _ in range(n))
    documents = [(i, "the same opening " + text(4)) for i in range(40)] + [(i, text(9)) for i in range(40, 90)]
    documents += [(3, "x y z"), (3, "the same opening"), (None, "x y z"), (None, text(8)), (90, None), (91, ""), (92, "a b")]
    queries = [(i, "same opening the" if i % 2 else "the Same\topening") for i in range(30)]
    queries += [(i, text(7)) for i in range(30, 50)] + [(31, "x y z"), (None, "x y z"), (50, None), (51, "a b")]
    return documents, queries


@pytest.mark.parametrize("block, pairs", [(2048, 16_000_000), (7, 50)])
@pytest.mark.parametrize("table_bytes", [64 * 1024 * 1024, 1024 * 4])
def test_shared_runs_equal_brute_force(spark, monkeypatch, rows, block, pairs, table_bytes):
    monkeypatch.setattr(passages, "BLOCK_ROWS", block)
    monkeypatch.setattr(passages, "PAIRS_A_TASK", pairs)
    monkeypatch.setattr(passages, "TABLE_BYTES", table_bytes)
    documents = spark.createDataFrame(rows[0], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(rows[1], "qid long, text string")
    found = collections.passage_qrels(documents, queries, WIDTH)
    assert sorted(((r.qid, r.doc_id) for r in found.collect()), key=str) == brute_force(*rows)
    assert found.columns == ["qid", "doc_id", "grade"] and found.schema["grade"].dataType.simpleString() == "int"


def test_full_bit_table_loses_nothing(spark, monkeypatch, rows):
    documents = spark.createDataFrame([(str(i), t) for i, t in rows[0]], "doc_id string, text string").coalesce(1)
    table = spark.sparkContext.broadcast(np.full(1 << 12, 255, np.uint8))
    got = passages.runs_in_table(documents, table, 15, WIDTH).collect()
    expected = [
        (str(i), run) for i, text in rows[0]
        for run in {" ".join(w[j : j + WIDTH]) for w in [(text or "").split()] for j in range(len(w) - WIDTH + 1)}
    ]
    assert sorted((r.doc_id, r.run) for r in got) == sorted(expected)


@pytest.mark.parametrize("pairs", [16_000_000, 50])
def test_pairs_are_not_moved_once_made(spark, monkeypatch, pairs):
    """Every document opens alike and is asked for by its opening: the pairs are the square of the documents."""
    monkeypatch.setattr(passages, "PAIRS_A_TASK", pairs)
    monkeypatch.setattr(passages, "BLOCK_ROWS", 16)
    corpus = spark.range(60).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d e f g h i j k l"), "id").alias("text")
    )
    asked = collections.known_item_queries(corpus, None, 42)
    found = collections.passage_qrels(corpus, asked)
    assert found.count() == 3600 and found.distinct().count() == 3600
    steps = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in steps and "Repartition" not in steps
    if pairs == 50:
        made = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert max(r["count"] for r in made) <= 3600 / 4
