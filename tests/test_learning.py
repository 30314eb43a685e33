import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import diagnostics, reranker, statistics, tuning
from rankloom.plans import ordering
from rankloom.schemas import FEATURE_COLUMNS

NAMES = FEATURE_COLUMNS[:4]


def make_rows(n_queries=14, per_query=9, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n_queries):
        for d in range(per_query):
            label = int(d == 0 or (d == 1 and q % 3 == 0))
            x = rng.normal(size=len(NAMES)) + label * np.array([1.0, 0.5, -0.7, 0.0])
            rows.append((q, d, "train", label, *map(float, x)))
    columns = ["query_id", "doc_id", "split", "label", *NAMES]
    return pd.DataFrame(rows, columns=columns)


@pytest.fixture(scope="module")
def table():
    return make_rows()


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table).withColumn("label", F.col("label").cast("int")).cache()


def newton(x, y, c, penalise_intercept):
    """Reference optimum of the weighted, L2-penalised logistic loss."""
    n = len(y)
    s = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    x = np.hstack([x, np.ones((n, 1))])
    penalty = np.full(x.shape[1], 1.0 / c)
    if not penalise_intercept:
        penalty[-1] = 0.0
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (s * (p - y)) + penalty * w
        h = x.T @ (x * (s * p * (1 - p))[:, None]) + np.diag(penalty)
        w = w - np.linalg.solve(h, g)
    return w


def standardised(table):
    x = table[NAMES].to_numpy()
    return (x - x.mean(axis=0)) / x.std(axis=0)


@pytest.mark.parametrize("solver", ["liblinear", "lbfgs"])
def test_fit_reaches_the_optimum(frame, table, solver):
    model = reranker.fit_reranker(frame, NAMES, {"C": 2.0, "solver": solver})
    expected = newton(standardised(table), table.label.to_numpy(), 2.0, solver == "liblinear")
    assert np.allclose([*model.coefficient, model.intercept], expected, atol=1e-5)


def test_joint_fits_reach_the_same_optimum_per_fold(frame, table):
    data = tuning.prepare_folds(frame, NAMES, 3)
    settings = [
        {"C": 0.5, "solver": "liblinear", "class_weight": "balanced", "max_iter": 100},
        {"C": 2.0, "solver": "lbfgs", "class_weight": "balanced", "max_iter": 100},
    ]
    options = [tuning.Candidate("x", tuple(NAMES), tuple(s.items())) for s in settings]
    options.append(tuning.Candidate("drop", (NAMES[0], NAMES[2]), tuple(settings[0].items())))
    fits = tuning.fit_all(data, options)
    assert all(fit.converged for fit in fits.values())
    fitted = {key: fit.weights for key, fit in fits.items()}
    for fold in range(3):
        part = table[table.query_id % 3 != fold]
        x, y = standardised(part), part.label.to_numpy()
        assert np.allclose(fitted[0, fold], newton(x, y, 0.5, True), atol=1e-6)
        assert np.allclose(fitted[1, fold], newton(x, y, 2.0, False), atol=1e-6)
        small = newton(x[:, [0, 2]], y, 0.5, True)
        assert np.allclose(fitted[2, fold][[0, 2, 4]], small, atol=1e-6)
        assert fitted[2, fold][1] == 0.0 and fitted[2, fold][3] == 0.0


def dcg(labels):
    return sum(l / np.log2(i + 2) for i, l in enumerate(labels[:10]))


def test_cross_validation_by_hand(frame, table):
    params = {"C": 0.5, "solver": "liblinear", "class_weight": "balanced", "max_iter": 100}
    scores = []
    for fold in range(4):
        fit, val = table[table.query_id % 4 != fold], table[table.query_id % 4 == fold]
        mean, std = fit[NAMES].mean().to_numpy(), fit[NAMES].to_numpy().std(axis=0)
        w = newton((fit[NAMES].to_numpy() - mean) / std, fit.label.to_numpy(), 0.5, True)
        margin = (val[NAMES].to_numpy() - mean) / std @ w[:-1] + w[-1]
        ndcg = []
        for _, group in val.assign(m=margin).groupby("query_id"):
            ranked = group.sort_values("m", ascending=False).label.tolist()
            ndcg.append(dcg(ranked) / dcg(sorted(ranked, reverse=True)))
        scores.append(np.mean(ndcg))
    got = tuning.cross_validated_ndcg(frame, NAMES, params, 4)
    assert got == pytest.approx(np.mean(scores), abs=1e-6)


def test_folds_are_dealt_in_id_order(spark):
    rows = spark.createDataFrame([(q,) for q in (9, 3, 5, 1, 7, 11, 2)], "query_id long")
    got = {r.query_id: r.fold for r in tuning.assign_folds(rows, 3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 5: 0, 7: 1, 9: 2, 11: 0}
    two = tuning.assign_folds(rows.filter("query_id in (1, 2)"), 5)
    assert {r.fold for r in two.collect()} == {0, 1}
    assert tuning.assign_folds(rows, 1).select("fold").distinct().count() == 2


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_has_an_optimum_with_a_penalised_intercept(frame, table, label):
    lonely = frame.filter(F.col("label") == label)
    model = reranker.fit_reranker(lonely, NAMES, {"C": 2.0, "solver": "liblinear"})
    rows = table[table.label == label]
    expected = newton(standardised(rows), rows.label.to_numpy(), 2.0, True)
    assert np.allclose([*model.coefficient, model.intercept], expected, atol=1e-5)
    assert (model.intercept > 0) == (label == 1)
    with pytest.raises(ValueError, match="one class"):
        reranker.fit_reranker(lonely, NAMES, {"C": 2.0, "solver": "lbfgs"})


@pytest.mark.parametrize("rows", [1, 2])
def test_a_few_rows_of_one_class_still_get_an_intercept(frame, rows):
    few = frame.filter("label = 1").orderBy("query_id", "doc_id").limit(rows)
    model = reranker.fit_reranker(few, NAMES, {"C": 2.0, "solver": "liblinear"})
    w = 0.0
    for _ in range(50):  # every feature is constant or symmetric, so the intercept has an optimum of its own
        p = 1 / (1 + np.exp(-w))
        w -= (rows * 0.5 * (p - 1) + w / 2.0) / (rows * 0.5 * p * (1 - p) + 1 / 2.0)
    assert model.intercept == pytest.approx(w, abs=1e-5)


def test_one_class_fits_are_skipped(spark, frame):
    lonely = frame.filter("query_id < 2").withColumn(
        "label", F.when(F.col("query_id") == 0, F.col("label")).otherwise(0)
    )
    data = tuning.prepare_folds(lonely, NAMES, 5)
    assert data.n_folds == 2 and data.usable == [1]
    assert tuning.cross_validated_ndcg(frame.filter("query_id = 0"), NAMES, reranker.DEFAULT_PARAMS, 5) is None


def test_tuning_takes_the_first_best_and_falls_back(frame):
    data = tuning.prepare_folds(frame, NAMES, 3)
    same = [dict(reranker.PARAM_GRID[1]), dict(reranker.PARAM_GRID[1])]
    result = tuning.tune(data, same)
    assert result["selected_params"] == same[0] and len(result["candidate_results"]) == 2
    assert tuning.tune(None)["selected_params"] == reranker.DEFAULT_PARAMS


def test_selection_stops_at_the_floor_and_only_gains(frame):
    data = tuning.prepare_folds(frame, NAMES, 3)
    kept = tuning.select_features(data, reranker.DEFAULT_PARAMS, 4)
    assert kept["selected_features"] == NAMES and len(kept["history"]) == 1
    free = tuning.select_features(data, reranker.DEFAULT_PARAMS, 1)
    assert free["best_cv_ndcg_at_10"] >= kept["best_cv_ndcg_at_10"]
    assert set(free["selected_features"]) <= set(NAMES)


@pytest.fixture(scope="module")
def broken(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame(rng.integers(0, 6, size=(40, 3)).astype(float), columns=["a", "b", "c"])
    table["c"] = 7.0
    table["d"] = np.nan
    table.loc[[1, 4, 9], "a"] = np.inf
    table.loc[[2, 4], "a"] = np.nan
    table.loc[[0, 7], "b"] = -np.inf
    return table, spark.createDataFrame(table)


def test_summary_matches_pandas(broken):
    table, frame = broken
    clean = table.replace([np.inf, -np.inf], np.nan)
    for row in diagnostics.feature_summary(frame, list("abcd")).collect():
        s = clean[row.feature]
        assert row.missing_count == s.isna().sum()
        assert row.missing_ratio == pytest.approx(s.isna().mean())
        assert row.inf_count == np.isinf(table[row.feature]).sum()
        if s.notna().any():
            assert row["mean"] == pytest.approx(s.mean()) and row["std"] == pytest.approx(s.std())
            assert row.variance == pytest.approx(s.var())
        else:
            assert row["mean"] == row["std"] == row.variance == 0.0


@pytest.mark.parametrize("small_rows", [0, 1_000_000])
def test_spearman_matches_pandas(broken, monkeypatch, small_rows):
    table, frame = broken
    monkeypatch.setattr(ordering.running_total, "__defaults__", (small_rows,))
    clean = table.replace([np.inf, -np.inf], np.nan)
    expected = clean.corr(method="spearman").fillna(0.0).round(6)
    got = diagnostics.spearman_matrix(frame, list("abcd")).collect()
    assert len(got) == 16
    for row in got:
        assert row.correlation == pytest.approx(expected.loc[row.feature_a, row.feature_b], abs=1e-6)


@pytest.mark.parametrize("small_rows", [0, 1_000_000])
def test_scaling_matches_numpy(broken, monkeypatch, small_rows):
    table, frame = broken
    monkeypatch.setattr(ordering.running_total, "__defaults__", (small_rows,))
    clean = table.replace([np.inf, -np.inf], np.nan)
    got = {
        r.feature: r
        for r in statistics.feature_scaling(statistics.sanitize(frame, list("abcd")), list("abcd")).collect()
    }
    for name in "ab":
        filled = clean[name].fillna(clean[name].median())
        assert got[name].median == pytest.approx(clean[name].median())
        assert got[name]["mean"] == pytest.approx(filled.mean())
        assert got[name]["std"] == pytest.approx(filled.std(ddof=0))
    assert (got["c"]["mean"], got["c"]["std"]) == (7.0, 1.0)
    assert (got["d"]["median"], got["d"]["mean"], got["d"]["std"]) == (0.0, 0.0, 1.0)


def test_scores_use_imputed_values_and_are_one_projection(spark):
    model = reranker.RerankerModel(["a"], [2.0], [1.0], [4.0], [3.0], 0.5)
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "a double")
    scored = reranker.score_rows(model, frame)
    expected = [1 / (1 + np.exp(-m)) for m in (0.5, 1.25, 1.25)]
    assert [r.score for r in scored.collect()] == pytest.approx(expected)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    back = reranker.RerankerModel.from_frame(model.to_frame(spark))
    assert back == model
    assert reranker.coefficient_importance(model, spark).first().abs_coefficient == 3.0
