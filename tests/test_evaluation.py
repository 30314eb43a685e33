import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import evaluation, hybrid


@pytest.fixture(scope="module")
def qrels(spark):
    return spark.createDataFrame(
        [(1, 10, 2), (1, 11, 1), (1, 12, 0), (2, 20, 1), (3, 30, 0)],
        "qid long, doc_id long, grade int",
    )


def run_of(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id long, score double, rank long")


def test_metrics_by_hand(spark, qrels):
    run = run_of(spark, [(1, 12, 3.0, 1), (1, 11, 2.0, 2), (1, 10, 1.0, 3), (3, 30, 1.0, 1)])
    got = {r.qid: r for r in evaluation.per_query_metrics(run, qrels).collect()}
    ideal = 2 + 1 / math.log2(3)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3) + 2 / 2) / ideal)
    assert got[1].ap == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert got[2].ndcg == 0.0 and got[2].ap == 0.0  # judged, not in the run
    assert got[3].ndcg == 0.0 and got[3].ap == 0.0  # nothing relevant


def test_ideal_run_scores_one_and_only_asked_queries_count(spark, qrels):
    run = run_of(spark, [(1, 10, 3.0, 1), (1, 11, 2.0, 2), (7, 10, 3.0, 1)])
    ids = spark.createDataFrame([(1,), (7,)], "qid long")
    row = evaluation.evaluate_run(run, qrels, ids).first()
    assert row.ndcg_at_10 == 1.0 and row["map"] == 1.0


def test_relevant_documents_below_ten_count_against_the_ideal(spark):
    judged = spark.createDataFrame([(1, d, 1) for d in range(12)], "qid long, doc_id long, grade int")
    run = run_of(spark, [(1, d, 20.0 - d, d + 1) for d in range(12)])
    row = evaluation.per_query_metrics(run, judged).first()
    assert row.ndcg == pytest.approx(1.0) and row.ap == pytest.approx(1.0)


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        [(1, 10, 5.0, 0.2), (1, 11, 1.0, 0.9), (1, 12, 3.0, 0.5), (2, 20, 4.0, 0.3), (2, 21, 4.0, 0.1)],
        "query_id long, doc_id long, bm25 double, score double",
    )


def test_blend(scored):
    got = {
        (r.query_id, r.doc_id): r.hybrid_score for r in hybrid.blend(scored, 0.25).collect()
    }
    assert got[1, 10] == pytest.approx(0.25) and got[1, 11] == pytest.approx(0.75)
    assert got[2, 20] == pytest.approx(0.75) and got[2, 21] == 0.0  # constant bm25 becomes 0


@pytest.mark.parametrize("alpha, column", [(0.0, "score"), (1.0, "bm25")])
def test_extreme_weights_order_like_one_side(scored, alpha, column):
    ids = scored.filter("query_id = 1").select(F.col("query_id").alias("qid")).distinct()
    blended = hybrid.hybrid_run(scored, ids, 3, alpha).orderBy("rank").collect()
    single = evaluation.reranked_run(scored, column, ids, 3).orderBy("rank").collect()
    assert [r.doc_id for r in blended] == [r.doc_id for r in single]


def test_alpha_grid_first_best_wins(spark, scored):
    qrels = spark.createDataFrame([(1, 11, 1), (2, 20, 1)], "qid long, doc_id long, grade int")
    ids = qrels.select("qid")
    table = hybrid.alpha_results(scored, qrels, ids, 10)
    assert table.count() == len(hybrid.ALPHA_GRID)
    assert hybrid.best_alpha(table).first().alpha == 0.0


def test_all_models_in_one_job(spark, scored, qrels):
    ids = qrels.select("qid")
    runs = {
        "a": evaluation.reranked_run(scored, "bm25", ids, 10),
        "b": evaluation.reranked_run(scored, "score", ids, 10),
    }
    table = {r.model: (r.ndcg_at_10, r["map"]) for r in evaluation.compare_models(runs, qrels, ids).collect()}
    for name, run in runs.items():
        row = evaluation.evaluate_run(run, qrels, ids).first()
        assert table[name] == (row.ndcg_at_10, row["map"])
