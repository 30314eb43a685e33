import hashlib

import pytest
from pyspark.sql import functions as F

from rankloom.operators import sampling
from rankloom.plans import ordering


def by_hash(ids, purpose, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{purpose}:{i}".encode()).hexdigest())


def test_nth_hash_picks_exactly_n_of_many(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_BUCKET", 1)
    monkeypatch.setattr(ordering, "HASH_DIGITS_PER_STEP", 1)
    ids = spark.range(5000).withColumnRenamed("id", "qid")
    for n in (1, 17, 4999):
        got = {r.qid for r in ordering.first_by_hash(ids, "qid", n, 42, "sample").collect()}
        assert got == set(by_hash(range(5000), "sample")[:n])
    assert ordering.first_by_hash(ids, "qid", 5000, 42, "sample").count() == 5000
    assert ordering.first_by_hash(ids, "qid", 0, 42, "sample").count() == 0


@pytest.mark.parametrize("small_rows", [0, 1_000_000])
def test_running_total_both_ways(spark, small_rows):
    rows = [(g, (g * 7919 + v * 31) % 997, v % 5 + 1) for g in range(3) for v in range(300)]
    rows = list({(g, o): (g, o, n) for g, o, n in rows}.values())
    df = spark.createDataFrame(rows, "g int, o int, n long")
    got = ordering.running_total(df, ["g"], ["o"], "n", "t", small_rows).collect()
    expected, totals = {}, {}
    for g, o, n in sorted(rows):
        expected[g, o] = totals.get(g, 0)
        totals[g] = totals.get(g, 0) + n
    assert {(r.g, r.o): r.before for r in got} == expected
    numbered = ordering.number_rows(df.select("o").distinct(), ["o"], "p", "n", small_rows)
    assert [r.p for r in numbered.orderBy("o").collect()] == list(range(1, numbered.count() + 1))


@pytest.fixture
def judged(spark):
    corpus = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    qrels = spark.createDataFrame(
        [(q, d, 1) for q, d in ((1, 90), (1, 3), (2, 50), (3, 7), (3, 999))],
        "qid long, doc_id long, grade int",
    )
    return corpus, qrels


def test_limit_keeps_judged_documents_first(judged):
    corpus, qrels = judged
    kept, left = sampling.limit_corpus(corpus, qrels, 10)
    ids = {r.doc_id for r in kept.collect()}
    free = by_hash(set(range(100)) - {3, 7, 50, 90}, "corpus")[:6]
    assert ids == {3, 7, 50, 90} | set(free)
    assert left.count() == 4


def test_limit_below_the_judged_set(judged):
    corpus, qrels = judged
    kept, left = sampling.limit_corpus(corpus, qrels, 2)
    assert {r.doc_id for r in kept.collect()} == {3, 7}
    assert {(r.qid, r.doc_id) for r in left.collect()} == {(1, 3), (3, 7)}


@pytest.mark.parametrize("limit", [None, 0, -1, 100, 500])
def test_no_limit(judged, limit):
    corpus, qrels = judged
    kept, left = sampling.limit_corpus(corpus, qrels, limit)
    assert kept.count() == 100 and left.count() == 4


@pytest.mark.parametrize("n, share, held_out", [(10, 0.2, 2), (3, 0.01, 1), (3, 0.99, 2), (2, 1.0, 1)])
def test_split_sizes(spark, n, share, held_out):
    split = sampling.split_queries(spark.range(n).withColumnRenamed("id", "qid"), share)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"test": held_out, "train": n - held_out}


def test_split_needs_two_queries(spark):
    with pytest.raises(ValueError):
        sampling.split_queries(spark.range(1).withColumnRenamed("id", "qid"), 0.2)


def test_sample_is_of_eligible_queries(spark, judged):
    _, qrels = judged
    queries = spark.range(6).select(F.col("id").alias("qid"), F.lit("x").alias("text"))
    assert {r.qid for r in sampling.sample_queries(queries, qrels, 9).collect()} == {1, 2, 3}
    assert {r.qid for r in sampling.sample_queries(queries, qrels, 2).collect()} == set(
        by_hash([1, 2, 3], "sample")[:2]
    )
