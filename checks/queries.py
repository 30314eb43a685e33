"""The registered queries. Each takes (spark, folder of the given tables) and returns a DataFrame.

Queries over the same folder share one written index and the written steps that follow from it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.config import RankingConfig
from rankloom.functions.text import compress_score, tokens
from rankloom.functions.vectors import dot, unit_norm
from rankloom.operators import (
    bm25, candidates, diagnostics, evaluation, features, hybrid, reranker, sampling, search,
    semantic, statistics, tfidf, tuning,
)
from rankloom.plans.experiment import Experiment
from rankloom.plans.serving import prepare_runtime
from rankloom.plans.staging import fresh_path, stage
from rankloom.schemas import FEATURE_COLUMNS
from rankloom.sources import artifacts, collections
from rankloom.sources.collections import Collection

CONFIG = RankingConfig(max_docs=None, sample_size=None)
CORPUS_LIMIT = 500
JUDGED_LIMIT = 10

# Coefficients for the checks that must not depend on a fit; inputs are scaled on the training rows.
FIXED_INTERCEPT = -0.25
FIXED_COEFFICIENTS = {
    "tfidf": 0.9,
    "semantic_similarity": 0.4,
    "bm25_feature": 0.7,
    "bm25_rank_feature": 0.5,
    "common_terms": -0.2,
    "overlap_ratio": 0.6,
    "query_coverage": 0.3,
    "idf_overlap": 0.8,
    "doc_length_feature": -0.35,
    "query_length_feature": 0.15,
    "length_ratio": -0.45,
}


class CheckedExperiment(Experiment):
    """A run whose scores come from the fixed coefficients; `trained` is the fitted model."""

    @cached_property
    def scaling(self) -> DataFrame:
        clean = statistics.sanitize(self.train, FEATURE_COLUMNS)
        return stage(statistics.feature_scaling(clean, FEATURE_COLUMNS), "scaling")

    @cached_property
    def model(self) -> reranker.RerankerModel:
        rows = {r["feature"]: r for r in self.scaling.collect()}
        return reranker.RerankerModel(
            list(FEATURE_COLUMNS),
            [rows[f]["median"] for f in FEATURE_COLUMNS],
            [rows[f]["mean"] for f in FEATURE_COLUMNS],
            [rows[f]["std"] for f in FEATURE_COLUMNS],
            [FIXED_COEFFICIENTS[f] for f in FEATURE_COLUMNS],
            FIXED_INTERCEPT,
        )

    @cached_property
    def trained(self) -> reranker.RerankerModel:
        return reranker.fit_reranker(
            self.train, self.selection["selected_features"], self.tuning["selected_params"]
        )


_EXPERIMENTS: dict[tuple[str, str], CheckedExperiment] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collection(spark: SparkSession, folder: str) -> Collection:
    corpus = collections.document_corpus(table(spark, folder, "documents"))
    queries = collections.passage_queries(table(spark, folder, "benchmark"))
    qrels = collections.graded_qrels(
        collections.passage_qrels(corpus, queries), table(spark, folder, "labels")
    )
    return Collection(corpus, queries, stage(qrels, "judgements"))


def experiment(spark: SparkSession, folder: str) -> CheckedExperiment:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _EXPERIMENTS:
        _EXPERIMENTS[key] = CheckedExperiment(collection(spark, folder), CONFIG)
    return _EXPERIMENTS[key]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


QUERIES: dict[str, object] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Sources, slicing, sampling ------------------------------------------------------------------------


@register
def load_dataset(spark, folder):
    """Write the collection in its file layout, read and check it."""
    path = fresh_path(spark, "collection")
    collections.write_jsonl_collection(collection(spark, folder), path, "dev")
    loaded = collections.load_dataset(spark, path, "dev", CONFIG)
    return loaded.corpus.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(
        loaded.qrels.groupBy("doc_id").agg(F.sum("grade").alias("grades")), "doc_id", "left"
    )


@register
def input_contract(spark, folder):
    return collections.input_contract(collection(spark, folder))


@register
def passage_qrels(spark, folder):
    return collection(spark, folder).qrels


@register
def known_item_qrels(spark, folder):
    """Every document as a known-item query, with all documents that hold the asked passage."""
    corpus = collection(spark, folder).corpus
    asked = collections.known_item_queries(corpus, CONFIG.sample_size, CONFIG.random_state)
    return collections.passage_qrels(corpus, asked)


@register
def corpus_limit(spark, folder):
    given = collection(spark, folder)
    return sampling.limit_corpus(given.corpus, given.qrels, CORPUS_LIMIT)[0].select("doc_id")


@register
def corpus_limit_judged(spark, folder):
    """More judged documents than room: the smallest judged ids stay."""
    given = collection(spark, folder)
    return sampling.limit_corpus(given.corpus, given.qrels, JUDGED_LIMIT)[0].select("doc_id")


@register
def qrels_restrict(spark, folder):
    given = collection(spark, folder)
    return sampling.limit_corpus(given.corpus, given.qrels, JUDGED_LIMIT)[1]


@register
def eligible_queries(spark, folder):
    given = collection(spark, folder)
    return sampling.eligible_queries(given.queries, given.qrels).select("qid")


@register
def query_sample(spark, folder):
    """Ten of the eligible queries."""
    given = collection(spark, folder)
    return sampling.sample_queries(given.queries, given.qrels, 10).select("qid")


@register
def query_split(spark, folder):
    return experiment(spark, folder).split


@register
def subset_qrels(spark, folder):
    run = experiment(spark, folder)
    return sampling.subset_qrels(run.qrels, run.ids("test"))


# Text and retrieval --------------------------------------------------------------------------------


@register
def tokenize(spark, folder):
    words = tokens(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", words.alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_tokens"),
        F.array_join("words", " ").alias("token_text"),
    )


@register
def compress_lengths(spark, folder):
    size = F.col("n_chars").cast("double")
    return rounded(
        table(spark, folder, "documents").select(
            "doc_id", compress_score(size).alias("up"), compress_score(-size).alias("down")
        )
    )


@register
def postings(spark, folder):
    return experiment(spark, folder).index.postings.filter("term is not null").select(
        "term", "doc_id", "tf"
    )


@register
def doc_stats(spark, folder):
    return experiment(spark, folder).index.doc_stats


@register
def term_idf(spark, folder):
    return rounded(experiment(spark, folder).index.term_stats)


@register
def bm25_score(spark, folder):
    run = experiment(spark, folder)
    return bm25.score_all(run.index, run.source.queries)


@register
def bm25_topk(spark, folder):
    run = experiment(spark, folder)
    return bm25.top_k(run.index, run.source.queries, CONFIG.bm25_top_k)


@register
def bm25_topk_padded(spark, folder):
    """Nation names as queries: few or no documents match, zero scores fill the lists."""
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("qid"), F.col("n_name").alias("text")
    )
    return bm25.top_k(experiment(spark, folder).index, names, CONFIG.bm25_top_k)


@register
def score_candidates(spark, folder):
    """True scores of all judged pairs."""
    run = experiment(spark, folder)
    return bm25.score_candidates(run.index, run.source.queries, run.qrels)


@register
def baseline_run(spark, folder):
    run = experiment(spark, folder)
    return bm25.baseline_run(run.index, run.queries, run.ids("test"), CONFIG.rerank_eval_k)


# Candidates and pairs ------------------------------------------------------------------------------


@register
def positives(spark, folder):
    run = experiment(spark, folder)
    return candidates.positives(run.qrels, run.top, run.split, 2)


@register
def negatives(spark, folder):
    run = experiment(spark, folder)
    return candidates.negatives(run.top, run.qrels, run.split, CONFIG.negatives_per_query)


@register
def candidate_lists(spark, folder):
    """Retrieval at depth 3, so that positives get appended."""
    run = experiment(spark, folder)
    shallow = run.top.filter(F.col("rank") <= 3)
    return candidates.candidate_lists(shallow, run.qrels, run.split, 2)


@register
def candidate_docs(spark, folder):
    return candidates.candidate_documents(experiment(spark, folder).lists)


@register
def train_pairs(spark, folder):
    return experiment(spark, folder).pairs


@register
def candidate_ranks(spark, folder):
    """Fresh ranks by true score for candidates listed in id order."""
    run = experiment(spark, folder)
    order = F.row_number().over(
        candidates.Window.partitionBy("qid").orderBy("doc_id")
    ).cast("long")
    listed = run.top.select("qid", "doc_id", order.alias("pos"))
    scores = bm25.score_candidates(run.index, run.queries, listed)
    return candidates.inference_pairs(listed, scores)


# Features ------------------------------------------------------------------------------------------


@register
def tfidf_vocab(spark, folder):
    return rounded(experiment(spark, folder).vocabulary)


@register
def tfidf_cosine(spark, folder):
    run = experiment(spark, folder)
    documents = tfidf.documents_of(run.index.texts, run.pairs)
    return rounded(tfidf.pair_cosine(run.pairs, run.queries, documents, run.vocabulary))


@register
def semantic_similarity(spark, folder):
    """Every vector against the one with the next id."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", unit_norm(F.col("embedding")).alias("vector")
    )
    pairs = vectors.select(F.col("vec_id").alias("qid"), (F.col("vec_id") + 1).alias("doc_id"))
    return rounded(
        semantic.pair_similarity(
            pairs, vectors.withColumnRenamed("vec_id", "qid"),
            vectors.withColumnRenamed("vec_id", "doc_id"),
        )
    )


@register
def vector_dot(spark, folder):
    value = dot(F.col("embedding"), F.col("embedding"))
    return table(spark, folder, "embeddings").select("vec_id", F.round(value, 4).alias("squared"))


@register
def overlap_features(spark, folder):
    run = experiment(spark, folder)
    return rounded(features.overlap_features(run.index, run.queries, run.pairs))


@register
def length_features(spark, folder):
    run = experiment(spark, folder)
    return rounded(features.length_features(run.index, run.queries, run.pairs))


@register
def retrieval_features(spark, folder):
    return rounded(features.retrieval_features(experiment(spark, folder).pairs))


@register
def labels(spark, folder):
    run = experiment(spark, folder)
    return features.labels(run.pairs.select("qid", "doc_id", "split"), run.qrels)


@register
def feature_frame(spark, folder):
    return rounded(experiment(spark, folder).frame)


@register
def inference_frame(spark, folder):
    """All queries, judged or not, with their 20 best documents."""
    run = experiment(spark, folder)
    found = bm25.top_k(run.index, run.source.queries, 20).withColumnRenamed("rank", "pos")
    return rounded(
        features.build_inference_frame(
            stage(found, "found"), run.index.texts, run.source.queries, run.index, run.vocabulary
        )
    )


# Reranker ------------------------------------------------------------------------------------------


def broken_frame(run: CheckedExperiment) -> DataFrame:
    """The frame with infinities at labelled rows and NaN at second ranks."""
    value = (
        F.when(F.col("label") == 1, float("inf"))
        .when(F.col("bm25_rank_feature") == 0.5, float("nan"))
        .otherwise(F.col("tfidf"))
    )
    return run.frame.withColumn("tfidf", value)


@register
def sanitize(spark, folder):
    clean = statistics.sanitize(broken_frame(experiment(spark, folder)), FEATURE_COLUMNS)
    return rounded(clean.select("query_id", "doc_id", "tfidf", "bm25_feature"))


@register
def scaling(spark, folder):
    run = experiment(spark, folder)
    clean = statistics.sanitize(broken_frame(run), FEATURE_COLUMNS).filter("split = 'train'")
    return rounded(statistics.feature_scaling(clean, FEATURE_COLUMNS))


@register
def impute_scale(spark, folder):
    run = experiment(spark, folder)
    return rounded(
        statistics.impute_and_scale(run.train, run.scaling, FEATURE_COLUMNS)
        .select("query_id", "doc_id", *FEATURE_COLUMNS)
    )


@register
def class_weights(spark, folder):
    return rounded(statistics.class_weights(experiment(spark, folder).train))


@register
def query_folds(spark, folder):
    run = experiment(spark, folder)
    return tuning.assign_folds(run.train, CONFIG.tuning_folds)


@register
def frame_qrels(spark, folder):
    return tuning.frame_qrels(experiment(spark, folder).frame)


@register
def feature_summary(spark, folder):
    run = experiment(spark, folder)
    return rounded(
        diagnostics.feature_summary(broken_frame(run).filter("split = 'train'"), FEATURE_COLUMNS)
    )


@register
def spearman_matrix(spark, folder):
    run = experiment(spark, folder)
    return rounded(
        diagnostics.spearman_matrix(broken_frame(run).filter("split = 'train'"), FEATURE_COLUMNS), 5
    )


@register
def score_fixed(spark, folder):
    return rounded(experiment(spark, folder).scored.select("query_id", "doc_id", "split", "score"))


@register
def reranker_fit(spark, folder):
    """The reranker fitted with default parameters on all features of the training rows."""
    fitted = reranker.fit_reranker(experiment(spark, folder).train, list(FEATURE_COLUMNS), reranker.DEFAULT_PARAMS)
    return fitted.to_frame(spark).select("feature", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


@register
def logistic_coefficients(spark, folder):
    return rounded(experiment(spark, folder).trained.to_frame(spark))


@register
def importance(spark, folder):
    return rounded(reranker.coefficient_importance(experiment(spark, folder).trained, spark))


@register
def tuning_grid(spark, folder):
    """Every setting of the grid with the nDCG of each fold."""
    tried = artifacts.tuning_table(spark, experiment(spark, folder).tuning)
    return tried.select(
        "c", "solver", F.transform("fold_scores", lambda x: F.round(x, 6)).alias("fold_scores"),
        F.round("mean_ndcg_at_10", 6).alias("mean_ndcg_at_10"),
    )


@register
def feature_selection(spark, folder):
    return artifacts.selection_table(spark, experiment(spark, folder).selection)


# Blending and evaluation ---------------------------------------------------------------------------


@register
def minmax_norm(spark, folder):
    scored = experiment(spark, folder).scored
    return rounded(
        scored.select(
            "query_id", "doc_id", hybrid.normalized("bm25").alias("lexical"),
            hybrid.normalized("score").alias("learned"),
        )
    )


@register
def hybrid_blend(spark, folder):
    return rounded(
        hybrid.blend(experiment(spark, folder).scored, 0.4).select("query_id", "doc_id", "hybrid_score")
    )


@register
def alpha_grid(spark, folder):
    return rounded(experiment(spark, folder).alphas)


@register
def best_alpha(spark, folder):
    return rounded(hybrid.best_alpha(experiment(spark, folder).alphas))


@register
def hybrid_run(spark, folder):
    run = experiment(spark, folder)
    return rounded(
        hybrid.hybrid_run(run.scored, run.ids("test"), CONFIG.rerank_eval_k, 0.4)
    )


@register
def reranked_run(spark, folder):
    run = experiment(spark, folder)
    return rounded(
        evaluation.reranked_run(run.scored, "score", run.ids("test"), CONFIG.rerank_eval_k)
    )


def shallow_run(run: CheckedExperiment) -> DataFrame:
    """BM25 at depth 10 over all queries: misses some relevant documents of the graded judgements."""
    return run.top.filter(F.col("rank") <= CONFIG.rerank_eval_k)


@register
def ndcg_at_10(spark, folder):
    run = experiment(spark, folder)
    return rounded(evaluation.per_query_metrics(shallow_run(run), run.qrels).select("qid", "ndcg"))


@register
def average_precision(spark, folder):
    run = experiment(spark, folder)
    return rounded(evaluation.per_query_metrics(shallow_run(run), run.qrels).select("qid", "ap"))


@register
def evaluate_run(spark, folder):
    run = experiment(spark, folder)
    return rounded(evaluation.evaluate_run(shallow_run(run), run.qrels, run.split))


@register
def model_comparison(spark, folder):
    return rounded(experiment(spark, folder).metrics)


# Search --------------------------------------------------------------------------------------------


@register
def search_bm25(spark, folder):
    run = experiment(spark, folder)
    return search.search_bm25(run.index, run.source.queries)


@register
def search_ltr(spark, folder):
    run = experiment(spark, folder)
    return rounded(
        search.search_ltr(run.index, run.index.texts, run.source.queries, run.vocabulary, run.model)
    )


@register
def search_hybrid(spark, folder):
    run = experiment(spark, folder)
    return rounded(
        search.search_hybrid(
            run.index, run.index.texts, run.source.queries, run.vocabulary, run.model, 0.4
        )
    )


@register
def result_preview(spark, folder):
    run = experiment(spark, folder)
    found = search.search_bm25(run.index, run.source.queries)
    return search.with_previews(found, run.index.texts)


# Written results -----------------------------------------------------------------------------------


def _saved(spark, folder) -> tuple[CheckedExperiment, str]:
    run = experiment(spark, folder)
    if not hasattr(run, "saved_at"):
        run.saved_at = fresh_path(spark, "run")
        run.save(run.saved_at)
    return run, run.saved_at


@register
def feature_sink(spark, folder):
    run, path = _saved(spark, folder)
    return rounded(artifacts.read_frame(spark, path, "features", run.frame))


@register
def feature_sink_csv(spark, folder):
    run, path = experiment(spark, folder), fresh_path(spark, "csv")
    artifacts.write_frame(run.frame, path, "features", "csv")
    return rounded(artifacts.read_frame(spark, path, "features", run.frame, "csv"))


@register
def scored_sink(spark, folder):
    run, path = _saved(spark, folder)
    back = artifacts.read_frame(spark, path, "ltr_ranked", run.scored)
    return rounded(back.select("query_id", "doc_id", "split", "score"))


@register
def hybrid_sink(spark, folder):
    _, path = _saved(spark, folder)
    back = artifacts.read_table(spark, path, "hybrid_ranked")
    return back.select("query_id", "doc_id", F.round("hybrid_score", 6).alias("hybrid_score"))


@register
def metric_sink(spark, folder):
    _, path = _saved(spark, folder)
    return rounded(artifacts.read_table(spark, path, "metrics"))


@register
def run_summary(spark, folder):
    _, path = _saved(spark, folder)
    facts = artifacts.read_json(spark, path, "summary")
    return spark.createDataFrame(
        [(facts["train_queries"], facts["test_queries"], facts["feature_rows"])],
        "train_queries long, test_queries long, feature_rows long",
    )


@register
def reloaded_model(spark, folder):
    """Frame scored by the model read back from its table."""
    run, path = _saved(spark, folder)
    scored = reranker.score_rows(artifacts.load_model(spark, path), run.frame)
    return rounded(scored.select("query_id", "doc_id", "split", "score"))


@register
def saved_search(spark, folder):
    """Hybrid search with the tables of a saved run only."""
    run = experiment(spark, folder)
    if not hasattr(run, "stored_at"):
        run.stored_at = fresh_path(spark, "stored-index")
        bm25.build_index(run.index.texts, run.stored_at)
    _, path = _saved(spark, folder)
    runtime = prepare_runtime(spark, path, run.stored_at)
    found = runtime.search(run.source.queries, "hybrid")
    return rounded(found.select("qid", "rank", "doc_id", "score"))
