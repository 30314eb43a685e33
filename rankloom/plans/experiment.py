"""The training run as a chain of written tables, each computed once on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import RankingConfig
from rankloom.operators import bm25, candidates, evaluation, features, hybrid, tfidf
from rankloom.operators.diagnostics import feature_summary, spearman_matrix
from rankloom.operators.reranker import (
    RerankerModel, coefficient_importance, fit_reranker, score_rows,
)
from rankloom.operators.sampling import (
    limit_corpus, sample_queries, split_queries,
)
from rankloom.operators.tuning import (
    FoldData, prepare_folds, select_features, selection_report, tune, tuning_report,
)
from rankloom.plans.joins import broadcast_if_small
from rankloom.plans.staging import stage
from rankloom.schemas import FEATURE_COLUMNS
from rankloom.sources import artifacts
from rankloom.sources.collections import Collection


class Experiment:
    """All steps of one run over a judged collection.

    Every property is a table (or a model) that later steps share, as the index of a search system is
    shared by its queries. `collection.qrels` may name documents the corpus slice lost; they are cut.
    """

    def __init__(
        self, collection: Collection, config: RankingConfig,
        query_vectors: DataFrame | None = None, document_vectors: DataFrame | None = None,
        index_path: str | None = None,
    ):
        self.config = config
        self.source = collection
        self.query_vectors = query_vectors
        self.document_vectors = document_vectors
        self.index_path = index_path
        self.spark = collection.corpus.sparkSession

    @cached_property
    def _limited(self) -> tuple[DataFrame, DataFrame]:
        return limit_corpus(
            self.source.corpus, self.source.qrels, self.config.max_docs, self.config.random_state
        )

    @property
    def corpus(self) -> DataFrame:
        return self._limited[0]

    @cached_property
    def qrels(self) -> DataFrame:
        return stage(self._limited[1], "qrels")

    @cached_property
    def queries(self) -> DataFrame:
        """The sampled queries."""
        sampled = sample_queries(
            self.source.queries, self.qrels, self.config.sample_size, self.config.random_state
        )
        return stage(sampled, "queries")

    @cached_property
    def split(self) -> DataFrame:
        return stage(
            split_queries(self.queries, self.config.test_size, self.config.random_state), "split"
        )

    def ids(self, name: str) -> DataFrame:
        return self.split.filter(F.col("split") == name).select("qid")

    @cached_property
    def index(self) -> bm25.BM25Index:
        return bm25.build_index(self.corpus, self.index_path)

    @cached_property
    def top(self) -> DataFrame:
        """Retrieval at full depth, once; shallower runs are prefixes of it."""
        return stage(bm25.top_k(self.index, self.queries, self.config.bm25_top_k), "top")

    @cached_property
    def lists(self) -> DataFrame:
        return stage(
            candidates.candidate_lists(
                self.top, self.qrels, self.split, self.config.positives_per_query
            ),
            "lists",
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return stage(
            candidates.feature_pairs(
                self.lists, self.qrels, self.top, self.split,
                self.config.positives_per_query, self.config.negatives_per_query,
            ),
            "pairs",
        )

    @cached_property
    def vocabulary(self) -> DataFrame:
        train_documents = stage(
            candidates.candidate_documents(self.lists).filter("in_train").select("doc_id"),
            "train_documents",
        )
        return stage(
            tfidf.fit_vocabulary(
                self.queries.join(broadcast_if_small(self.ids("train")), "qid", "left_semi"),
                tfidf.documents_of(self.index.texts, train_documents),
            ),
            "vocabulary",
        )

    @cached_property
    def frame(self) -> DataFrame:
        frame = stage(
            features.build_frame(
                self.pairs, self.index.texts, self.queries, self.index, self.vocabulary, self.qrels,
                self.query_vectors, self.document_vectors,
            ),
            "features",
        )
        if frame.filter(F.col("split") == "train").isEmpty():
            raise ValueError("no training rows: raise sample_size or lower test_size")
        return frame

    @property
    def train(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "train")

    @cached_property
    def folds(self) -> FoldData | None:
        if self.ids("train").count() < 2:
            return None
        return prepare_folds(self.train, FEATURE_COLUMNS, self.config.tuning_folds)

    @cached_property
    def tuning(self) -> dict:
        if self.config.enable_model_tuning:
            return tune(self.folds)
        return tuning_report([], enabled=False)

    @cached_property
    def selection(self) -> dict:
        if self.config.enable_feature_selection:
            return select_features(
                self.folds, self.tuning["selected_params"], self.config.feature_selection_min_features
            )
        return selection_report([], enabled=False, known_score=self.tuning["best_cv_ndcg_at_10"])

    @cached_property
    def model(self) -> RerankerModel:
        return fit_reranker(
            self.train, self.selection["selected_features"], self.tuning["selected_params"]
        )

    @cached_property
    def scored(self) -> DataFrame:
        return stage(score_rows(self.model, self.frame), "scored")

    @cached_property
    def alphas(self) -> DataFrame:
        return stage(
            hybrid.alpha_results(
                self.scored, self.qrels, self.ids("train"), self.config.rerank_eval_k
            ),
            "alphas",
        )

    @cached_property
    def alpha(self) -> float:
        return hybrid.best_alpha(self.alphas).first()["alpha"]

    def runs(self) -> dict[str, DataFrame]:
        """The three test runs at evaluation depth."""
        k, test = self.config.rerank_eval_k, self.ids("test")
        lexical = self.top.join(broadcast_if_small(test), "qid", "left_semi").filter(F.col("rank") <= k)
        return {
            "bm25": lexical,
            "ltr": evaluation.reranked_run(self.scored, "score", test, k),
            "hybrid": hybrid.hybrid_run(self.scored, test, k, self.alpha),
        }

    @cached_property
    def metrics(self) -> DataFrame:
        return stage(evaluation.compare_models(self.runs(), self.qrels, self.ids("test")), "metrics")

    def summary(self) -> dict:
        # The keys are an output format.
        scores = {
            row["model"]: {"ndcg@10": row["ndcg_at_10"], "map": row["map"]}
            for row in self.metrics.collect()
        }
        return {
            **scores,
            "hybrid_alpha": self.alpha,
            "hybrid_components": ["bm25", "ltr"],
            "logistic_tuning": self.tuning,
            "feature_selection": self.selection,
            "train_queries": self.ids("train").count(),
            "test_queries": self.ids("test").count(),
            "feature_rows": self.frame.count(),
        }

    def save(self, folder: str) -> dict:
        """Write every result of the run under `folder`; returns the summary."""
        spark = self.spark
        artifacts.save_config(self.config, spark, folder)
        artifacts.write_table(self.split, folder, "query_split")
        artifacts.write_frame(self.frame, folder, "features")
        artifacts.write_frame(self.scored, folder, "ltr_ranked")
        artifacts.write_frame(hybrid.blend(self.scored, self.alpha), folder, "hybrid_ranked")
        artifacts.write_table(self.vocabulary, folder, "vocabulary")
        artifacts.save_model(self.model, spark, folder)
        artifacts.write_table(feature_summary(self.train, FEATURE_COLUMNS), folder, "feature_summary")
        artifacts.write_table(spearman_matrix(self.train, FEATURE_COLUMNS), folder, "correlation_matrix")
        artifacts.write_table(coefficient_importance(self.model, spark), folder, "importance")
        artifacts.write_table(artifacts.tuning_table(spark, self.tuning), folder, "tuning")
        artifacts.write_table(artifacts.selection_table(spark, self.selection), folder, "selection")
        artifacts.write_table(self.alphas, folder, "alpha_tuning")
        artifacts.write_table(self.metrics, folder, "metrics")
        summary = self.summary()
        artifacts.write_json(spark, folder, "summary", summary)
        return summary
