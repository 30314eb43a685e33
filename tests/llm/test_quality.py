"""Held-out accuracy, and the fits against known answers."""

import random

import numpy as np

from rankloom.llm import quality
from rankloom.llm.quality import co_train, content_view, fit_line, fit_logistic, fit_quality, good_documents, layout_view, score_quality

PLAIN = [f"word{i}" for i in range(300)]


def corpus(seed, count):
    """(rows, labels): good prose, shouted junk with symbols, and prose with abusive words."""
    chance = random.Random(seed)
    rows, labels = [], []
    for number in range(count):
        words = chance.choices(PLAIN, k=chance.randrange(30, 120))
        kind = chance.choices(["good", "junk", "toxic"], [6, 2, 2])[0]
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            for _ in range(4):
                words[chance.randrange(len(words))] = chance.choice(["vileword", "foulword"])
        text = " ".join(words)
        rows.append((number, text, chance.choice(["en", "fr", None]), chance.choice(["a", "b"]), len(text)))
        if number % 2:
            labels.append((number, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 1500)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = fit_quality(docs, marks)
    fresh, truth = corpus(2, 600)
    scored = {r.doc_id: r.quality for r in score_quality(spark.createDataFrame(fresh, SCHEMA), model).collect()}
    want = {i: q == 1 and t == 0 for i, q, t in truth}
    right = [scored[i].good == good for i, good in want.items()]
    assert sum(right) / len(right) > 0.95
    clean = [scored[i].good for i, good in want.items() if good]
    assert sum(clean) / len(clean) > 0.97
    chance = np.array([scored[i].score for i in want])
    assert abs(chance.mean() - np.mean(list(want.values()))) < 0.08  # calibrated
    again = fit_quality(docs.repartition(7), marks)
    assert np.allclose(model.views["content"][0], again.views["content"][0]) and np.allclose(model.mix, again.mix)


def test_samples_keep_their_bound(spark):
    many = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert 300 < quality._sample(many, 400).count() < 500 and quality._sample(many, 5000).count() == 5000


def test_fits_reach_the_optimum():
    chance = np.random.default_rng(3)
    x = chance.standard_normal((400, 2))
    y = (chance.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.0] + 0.5)))).astype(float)
    newton = fit_line(x, y)
    rows = (np.arange(401) * 2, np.tile([0, 1], 400), x.ravel())
    slopes, shift = fit_logistic(rows, y, 2, 0.0, 0.0, 500)
    assert np.allclose([*slopes, shift], newton, atol=1e-2)
    sparse, _ = fit_logistic(rows, y, 2, 0.5, 0.0, 200)
    assert not sparse.any()


def test_views_swap_confident_labels():
    """The layout view learns a sign that only the content view's pseudo-labels show."""
    chance = np.random.default_rng(5)
    count = 1200
    good = (chance.random(count) < 0.5).astype(float)
    part = np.array(["train"] * 40 + ["held"] * 200 + ["pool"] * (count - 240))
    starts = np.arange(count + 1)
    content = (starts, (good * 2 + chance.integers(0, 2, count)).astype(int), None)
    layout = (starts, np.where(chance.random(count) < 0.8, good * 20, 10 + good * 20).astype(int) + chance.integers(0, 10, count), np.ones(count))
    held = part == "held"

    def accuracy(rounds):
        models, _, _ = co_train({"content": content, "layout": layout}, np.where(part == "pool", 0, good), part, rounds, 0.6)
        odds = models["layout"][0][layout[1]] + models["layout"][1]
        return ((odds > 0) == good)[held].mean()

    assert accuracy(2) > accuracy(0)


def test_every_unlabelled_document_is_judged(spark, monkeypatch):
    rows, labels = corpus(6, 400)
    spare = [(1000 + i, f"word{i % 300} word{i % 7}", "en", "a", 12) for i in range(21_000)] + [(None, "word1 word2", "en", "a", 11)]
    seen = []
    whole = quality.pool_sums

    def counted(pool, models, confident):
        seen.append(pool.count())
        return whole(pool, models, confident)

    monkeypatch.setattr(quality, "pool_sums", counted)
    fit_quality(spark.createDataFrame(rows + spare, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert seen == [len(rows) + len(spare) - len(labels)] * quality.ROUNDS


def test_pool_sums_equal_those_of_one_task(spark):
    texts = [row[1] for row in corpus(9, 300)[0]]
    views = [(content_view(t.encode())[0].tolist(), *map(np.ndarray.tolist, layout_view(t.encode(), "en", "a", len(t)))) for t in texts]
    pool = spark.createDataFrame(views, "content array<int>, layout array<int>, numbers array<double>").repartition(5)
    chance = np.random.default_rng(8)
    models = {view: (chance.standard_normal(size) / 5, 0.0) for view, size in quality.SIZES.items()}
    alone = quality.pseudo_sums(quality._rows_of(pool.toArrow().to_batches()), models, 0.6)
    spread = quality.pool_sums(pool, models, 0.6)
    assert all((spread[v] == alone[v]).all() and alone[v][:, -1].all() for v in quality.SIZES)


def test_pseudo_labels_of_one_class_count():
    """Word 7 stands in no labelled row; the pseudo-labels, all bad, tell of it."""
    rows = (np.arange(101), np.tile([1, 2], 50), None)
    layout = (np.arange(101), np.tile([1, 2], 50), np.ones(100))
    good = np.tile([1.0, 0.0], 50)
    sums = {view: np.zeros((2, size + 1)) for view, size in quality.SIZES.items()}
    sums["content"][0, [2, 7, -1]] = 400
    models = quality.fit_views({"content": rows, "layout": layout}, good, np.ones(100, bool), sums)
    assert models["content"][0][7] < 0 and models["content"][0][8] == 0


def test_edge_cases(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], LABELS)
    assert fit_quality(edge_docs, none) is None
    kept = good_documents(edge_docs, none)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    rows, labels = corpus(4, 300)
    model = fit_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 0), (1, None, None), (3, 1, None)], LABELS))
    scored = score_quality(edge_docs, model)
    assert all(0 <= r.quality.score <= 1 for r in scored.collect()) and scored.count() == edge_docs.count()
    assert score_quality(empty_docs, model).count() == 0 and good_documents(empty_docs, none).count() == 0
    for raw in (None, b"", b"\n"):
        assert len(content_view(raw)[0]) == 0 and len(layout_view(raw, None, None, None)[0]) > 0


def test_one_bad_label_still_fits(spark):
    chance = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(chance.choices(words, k=30)) + f" n{i}", "en", "a", 200) for i in range(300)]
    rows.append((999, "buy now cheap pills " * 10, "en", "b", 200))
    labels = [(i, 1, 0) for i in range(200)] + [(999, 0, 1)]
    model = fit_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert model is not None
