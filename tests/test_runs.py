"""Whole runs on the given tables, written results, and search with them."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import RankingConfig
from rankloom.operators import bm25
from rankloom.operators.semantic import encode_texts
from rankloom.plans.experiment import Experiment
from rankloom.plans.serving import prepare_runtime
from rankloom.plans.staging import fresh_path
from rankloom.schemas import FEATURE_COLUMNS, FRAME_COLUMNS
from rankloom.sources import artifacts, collections
from rankloom.sources.collections import Collection

SMALL = "/root/testdata/sf0.001"


def toy_encoder():
    """Stands in for a sentence encoder: hashed bag of words."""
    def load():
        def encode(texts):
            out = np.zeros((len(texts), 16))
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    out[i, zlib.crc32(word.encode()) % 16] += 1.0
            return out

        return encode

    return load


@pytest.fixture(scope="module")
def run(spark):
    corpus = collections.document_corpus(spark.read.parquet(f"{SMALL}/documents.parquet"))
    queries = collections.known_item_queries(corpus, 24, 7)
    qrels = collections.passage_qrels(corpus, queries)
    config = RankingConfig(bm25_top_k=8, max_docs=150, enable_feature_selection=True,
                           feature_selection_min_features=9, tuning_folds=3)
    return Experiment(
        Collection(corpus, queries, qrels), config,
        query_vectors=encode_texts(queries, "qid", toy_encoder()),
        document_vectors=encode_texts(corpus, "doc_id", toy_encoder()),
        index_path=fresh_path(spark, "run-index"),
    )


@pytest.fixture(scope="module")
def saved(run, spark):
    folder = fresh_path(spark, "run-out")
    return folder, run.save(folder)


def test_frame_shape(run):
    assert run.frame.columns == FRAME_COLUMNS
    assert run.corpus.count() == 150
    rows = run.frame.toPandas()
    assert not rows[FEATURE_COLUMNS].isna().any().any()
    assert not rows.duplicated(["query_id", "doc_id"]).any()
    assert rows.semantic_similarity.between(-1.0001, 1.0001).all() and rows.semantic_similarity.max() > 0.1
    train = rows[rows.split == "train"].groupby("query_id").label.agg(["sum", "size"])
    assert (train["sum"] == 1).all() and (train["size"] <= 5).all()
    test = rows[rows.split == "test"].groupby("query_id").size()
    assert (test == 8).all()
    assert not set(train.index) & set(test.index)


def test_reranking_helps_or_ties_on_known_items(run, saved):
    _, summary = saved
    for name in ("bm25", "ltr", "hybrid"):
        assert 0.0 <= summary[name]["map"] <= summary[name]["ndcg@10"] + 1e-9 <= 1.0 + 1e-9
    assert summary["train_queries"] + summary["test_queries"] == run.queries.count()
    assert 9 <= len(summary["feature_selection"]["selected_features"]) <= 11
    assert len(summary["logistic_tuning"]["candidate_results"]) == 6


def test_results_read_back(run, saved, spark):
    folder, summary = saved
    back = artifacts.read_frame(spark, folder, "features", run.frame)
    assert back.exceptAll(run.frame).count() == 0 and back.count() == summary["feature_rows"]
    assert artifacts.load_config(spark, folder) == run.config
    assert artifacts.load_model(spark, folder) == run.model
    assert artifacts.read_table(spark, folder, "alpha_tuning").count() == 9
    assert artifacts.read_table(spark, folder, "correlation_matrix").count() == 121
    assert artifacts.read_json(spark, folder, "summary")["hybrid_alpha"] == run.alpha


def test_split_folder_prunes_the_scan(run, saved, spark):
    folder, _ = saved
    plan = (
        artifacts.read_frame(spark, folder, "features", run.frame).filter("split = 'test'")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "PartitionFilters: [isnotnull(split" in plan


@pytest.mark.parametrize("mode", ["bm25", "ltr", "hybrid"])
def test_search_modes(run, saved, spark, mode):
    folder, _ = saved
    runtime = prepare_runtime(spark, folder, run.index_path)
    asked = spark.createDataFrame(
        [("a", run.queries.first()["text"]), ("b", "nothingmatchesthis")], "qid string, text string"
    )
    got = runtime.search(asked, mode, top=3, candidate_k=6).collect()
    assert sorted((r.qid, r["rank"]) for r in got) == [(q, i) for q in "ab" for i in (1, 2, 3)]
    assert all(len(r.text_preview) <= 220 and "\n" not in r.text_preview for r in got)
    with pytest.raises(ValueError):
        runtime.search(asked, "other")


def test_missing_results_are_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="model_params"):
        prepare_runtime(spark, str(tmp_path), "x")


def test_titles_show_only_when_not_blank(toy, spark):
    from rankloom.operators.search import with_previews

    index = bm25.build_index(toy.corpus)
    rows = {r.doc_id: r.title for r in with_previews(bm25.top_k(index, toy.queries, 4), toy.corpus).collect()}
    assert rows == {"d1": None, "d2": None, "d3": "Weight", "d4": None}


def test_invalid_input_is_refused(toy):
    twice = Collection(toy.corpus.union(toy.corpus), toy.queries, toy.qrels)
    with pytest.raises(ValueError, match="corpus_duplicate_id=4"):
        collections.require_valid(twice)
    with pytest.raises(ValueError, match="empty tables"):
        collections.require_valid(Collection(toy.corpus, toy.queries, toy.qrels.limit(0)))
    dangling = toy.qrels.withColumn("doc_id", F.lit("gone"))
    counts = {
        r.check_name: r.violations
        for r in collections.input_contract(Collection(toy.corpus, toy.queries, dangling)).collect()
    }
    assert counts["dangling_doc_id"] == 1 and counts["dangling_qid"] == 0


def test_profiles_and_round_trip():
    medium = RankingConfig.profile("medium")
    assert (medium.bm25_top_k, medium.max_docs, RankingConfig.profile("full").max_docs) == (100, 500000, None)
    assert RankingConfig.from_dict({**medium.to_dict(), "unknown": 1}) == medium
