import pytest

from rankloom.operators import candidates


@pytest.fixture(scope="module")
def tables(spark):
    top = spark.createDataFrame(
        [(1, 10, 9.0, 1), (1, 11, 8.0, 2), (1, 12, 7.0, 3), (2, 10, 5.0, 1), (2, 13, 4.0, 2)],
        "qid long, doc_id long, score double, rank long",
    )
    qrels = spark.createDataFrame(
        [(1, 10, 1), (1, 12, 1), (1, 40, 1), (1, 41, 2), (1, 11, 0), (2, 10, 1)],
        "qid long, doc_id long, grade int",
    )
    split = spark.createDataFrame([(1, "train"), (2, "test")], "qid long, split string")
    return top, qrels, split


def test_positives_hardest_first_within_a_grade(tables):
    top, qrels, split = tables
    got = candidates.positives(qrels, top, split, 4).orderBy("pick").collect()
    assert [(r.qid, r.doc_id) for r in got] == [(1, 41), (1, 40), (1, 12), (1, 10)]


def test_negatives_are_unjudged_even_when_grade_is_zero(tables):
    top, qrels, split = tables
    assert candidates.negatives(top, qrels, split, 3).count() == 0
    only_ten = qrels.filter("doc_id = 10")
    got = candidates.negatives(top, only_ten, split, 1).collect()
    assert [(r.qid, r.doc_id) for r in got] == [(1, 11)]
    assert candidates.negatives(top, only_ten, split, 0).count() == 0


def test_appended_positives_rank_after_the_list(tables):
    top, qrels, split = tables
    lists = candidates.candidate_lists(top, qrels, split, 2)
    rows = {(r.qid, r.doc_id): r for r in lists.collect()}
    assert rows[1, 41].pos == 4 and rows[1, 40].pos == 5 and rows[1, 41].n_candidates == 5
    assert rows[2, 13].pos == 2 and len(rows) == 7
    pairs = candidates.feature_pairs(lists, qrels, top, split, 2, 2)
    got = {(r.qid, r.doc_id): (r.split, r.bm25, r["rank"]) for r in pairs.collect()}
    assert got[1, 40] == ("train", 0.0, 6) and got[1, 41] == ("train", 0.0, 6)
    assert got[2, 13] == ("test", 4.0, 2) and (2, 10) in got
    marks = {r.doc_id: r.in_train for r in candidates.candidate_documents(lists).collect()}
    assert marks[10] and not marks[13]


def test_inference_ranks_by_score_then_position(spark):
    listed = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "qid long, doc_id long, pos long")
    scores = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0), (1, 7, 2.0)], "qid long, doc_id long, score double")
    got = candidates.inference_pairs(listed, scores).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [6, 7, 5] and got[0]["split"] == "inference"
