"""Candidate documents are looked up, not scanned for."""

import re

from rankloom.operators import bm25, features
from rankloom.operators.tfidf import documents_of
from rankloom.plans import joins


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_few_ids_reach_the_text_scan(spark, toy, tmp_path):
    index = bm25.build_index(toy.corpus, f"{tmp_path}/it's an index")
    few = toy.qrels.select("doc_id")
    found = documents_of(index.texts, few)
    pushed = re.findall(r"PushedFilters: \[([^\n]*)\]", plan_of(found))
    assert any("doc_id" in p and "d1" in p for p in pushed)
    assert sorted(r.doc_id for r in found.collect()) == ["d1", "d2"]
    assert {r.doc_id: r.title for r in index.texts.collect()}["d3"] == "Weight"


def test_many_ids_give_the_same_rows(spark, toy, tmp_path, monkeypatch):
    index = bm25.build_index(toy.corpus, f"{tmp_path}/index")
    few = toy.qrels.select("doc_id")
    wanted = sorted(map(tuple, documents_of(index.texts, few).collect()))
    monkeypatch.setattr(joins, "SCAN_KEYS", 0)
    for fits in (True, False):
        assert sorted(map(tuple, documents_of(index.texts, few, fits).collect())) == wanted


def test_overlap_from_texts_equals_overlap_from_postings(spark, toy, tmp_path):
    index = bm25.build_index(toy.corpus, f"{tmp_path}/index")
    pairs = toy.queries.select("qid").crossJoin(toy.corpus.select("doc_id"))
    side = bm25.measure_queries(toy.queries)
    texts = documents_of(index.texts, pairs)
    from_texts = features.text_overlap(index, toy.queries, pairs, texts, side)
    files = from_texts.inputFiles()
    assert any("/texts/" in f for f in files) and not any("/postings/" in f for f in files)
    from_postings = bm25.pair_overlap(index, toy.queries, pairs).drop("score")
    assert sorted(map(tuple, from_texts.collect())) == sorted(map(tuple, from_postings.collect()))


def test_first_ids_are_written(spark, toy, tmp_path):
    bm25.build_index(toy.corpus, f"{tmp_path}/index")
    again = bm25.load_index(spark, f"{tmp_path}/index")
    assert sorted(r.doc_id for r in again.first_ids.collect()) == ["d1", "d2", "d3", "d4"]
    assert again.texts.count() == 4
