"""Quality classifier by co-training on two views of a document.

The content view sees hashed words only (folded, so neither case nor punctuation); the metadata view sees
language, source, length and layout statistics, but no words. Each view has a logistic regression. In each
round, both judge every unlabelled document, and what one is confident of becomes training data of the
other: the pseudo-labels are summed by class and feature in one pass, and the log ratios of these sums and
those of the labelled rows (naive Bayes) enter the other's next fit as one more column, whose weight the labelled rows decide. At the
end each view is calibrated on held-out labels (Platt scaling), and a third regression on the calibrated
log-odds combines them. All documents are scored in one pass without a shuffle; only the coefficients are
broadcast, and their number is fixed.

Good means labelled quality 1 and not toxic. Labelled rows are a sample of at most about `fit_rows` rows,
picked by a hash of id and text; unlabelled ones (without id too) all take part. Every FOLDS-th distinct text
of each class, in the order of a hash of the text, is held out for calibration, so copies never stand in both
the training and the held-out part and both parts hold both classes; a class of a single text is trained on,
and calibration then uses all labelled rows.

Defined cases: null text is empty text; null language, source and n_chars are values of their own; labels
with a null doc_id or null quality are ignored, of several labels of one id the worst counts, null toxic is
0; with labels of one class only, or none, every document scores 1 and is kept; repeated rows are each
judged; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import prepare_python, utf8, words_of
from rankloom.plans.joins import broadcast_if_small
from rankloom.llm.tables import stage

FIT_ROWS = 20_000
ROUNDS = 2
CONFIDENT = 0.98
KEEP_FROM = 0.3
FOLDS = 5
PIECE_ROWS = 4096
WORD_BITS = 17
#: (L1 penalty times the root of the row count, L2 penalty, steps) of each view; L1 leaves few of the many words
#: with a weight, and falls with the noise as rows grow.
FITTING = {"content": (0.04, 0.0, 120), "layout": (0.0, 1e-4, 100)}
#: (documents that stand for the prior, standard errors taken off) of each view's log ratios of pseudo-labels.
RATIOS = {"content": (1.0, 3.0), "layout": (1.0, 0.0)}

#: Steps into which each layout share is cut, so that a linear model can bend.
STEPS = np.array([0.0005, 0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!", b"|", b"#$%&*"]
CODES = {"lang": 32, "source": 256}
SHARES = len(_CLASSES) + 5
LAYOUT = SHARES * (len(STEPS) + 2) + 32 + sum(CODES.values())
SIZES = {"content": 1 << WORD_BITS, "layout": LAYOUT}
OTHER = {"content": "layout", "layout": "content"}


def content_view(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): each distinct word once."""
    words = set(words_of(raw))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    places = np.unique(hashes & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    return places, np.ones(len(places))


def layout_view(raw: bytes | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the metadata view."""
    raw = raw or b""
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = max(1, len(raw))
    words = words_of(raw)
    shares = [counts[list(own)].sum() / size for own in _CLASSES]
    shares.append(counts[128:].sum() / size)
    shares.append(len(set(words)) / max(1, len(words)))
    shares.append(sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)))
    lines = raw.split(b"\n")
    shares.append(1 - len(set(lines)) / len(lines))
    shares.append(min(1.0, sum(map(len, words)) / max(1, len(words)) / 20))
    own = np.array(shares)
    width = len(STEPS) + 2
    steps = np.arange(SHARES) * width + np.searchsorted(STEPS, own, side="right")
    length = SHARES * width + min(31, int(math.log2(max(1, n_chars or 0) + 1) * 1.5))
    codes, base = [], SHARES * width + 32
    for name, value in (("lang", lang), ("source", source)):
        codes.append(base + xxhash.xxh3_64_intdigest(repr(value)) % CODES[name])
        base += CODES[name]
    places = np.concatenate([steps, np.arange(SHARES) * width + width - 1, [length, *codes]])
    values = np.concatenate([np.ones(SHARES), own, np.ones(3)])
    order = np.argsort(places, kind="stable")
    return places[order], values[order]


Rows = tuple[np.ndarray, np.ndarray, np.ndarray | None]  # starts, places, values (None: all 1)


def sparse_rows(batches: list[tuple[pa.ListArray, pa.ListArray | None]]) -> Rows:
    """Rows given as lists of places, and of values or none."""
    lengths = [places.value_lengths().to_numpy(zero_copy_only=False) for places, _ in batches]
    places = np.concatenate([places.flatten().to_numpy() for places, _ in batches])
    values = None if batches[0][1] is None else np.concatenate([values.flatten().to_numpy() for _, values in batches])
    return np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64), places, values


def chosen_rows(rows: Rows, chosen: np.ndarray) -> Rows:
    """The rows flagged in `chosen`."""
    starts, places, values = rows
    lengths = np.diff(starts)
    entries = np.repeat(chosen, lengths)
    left = np.concatenate([[0], np.cumsum(lengths[chosen])])
    return left, places[entries], None if values is None else values[entries]


def _pieces(rows: Rows):
    """(row range, local starts, places, values) of some rows at a time, so that only these are expanded."""
    starts, places, values = rows
    for low in range(0, len(starts) - 1, PIECE_ROWS):
        own = starts[low : low + PIECE_ROWS + 1]
        part = slice(own[0], own[-1])
        yield slice(low, low + len(own) - 1), own - own[0], places[part], None if values is None else values[part]


def _log_odds(rows: Rows, model: tuple[np.ndarray, float]) -> np.ndarray:
    out = np.empty(len(rows[0]) - 1)
    for own, starts, places, values in _pieces(rows):
        weights = model[0][places] if values is None else model[0][places] * values
        total = np.concatenate([[0.0], np.cumsum(weights)])
        out[own] = total[starts[1:]] - total[starts[:-1]] + model[1]
    return out


def _column_sums(rows: Rows, by_row: np.ndarray, size: int) -> np.ndarray:
    """For each column the sum of its values, each times the number given for its row."""
    out = np.zeros(size)
    for own, starts, places, values in _pieces(rows):
        weights = np.repeat(by_row[own], np.diff(starts))
        out += np.bincount(places, weights=weights if values is None else weights * values, minlength=size)
    return out


def fit_logistic(
    rows: Rows, good: np.ndarray, size: int, l1: float, l2: float, steps: int, hint: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated proximal gradient steps.

    Each coefficient has a step of its own, from the bound sum_i |x_ij| sum_k |x_ik| on the curvature, so
    that rare words move as fast as frequent ones. `hint` holds coefficients learnt elsewhere: the rows'
    log-odds under it are one more column, without penalty and with a weight of 0 or more.
    """
    count = len(good)
    size_of = (rows[0], rows[1], None if rows[2] is None else np.abs(rows[2]))
    mass = _log_odds(size_of, (np.ones(size), 1.0))
    column, middle, unit = np.zeros(count), 0.0, 0.0
    if hint is not None:
        column = _log_odds(rows, (hint, 0.0))
        middle = column.mean()
        unit = math.sqrt(mass.mean()) / max(column.std(), 1e-9)
        column = (column - middle) * unit
        mass += np.abs(column)
    column_curve = (np.abs(column) * mass).sum() / (4 * count) + 1e-12
    curve = _column_sums(size_of, mass, size) / (4 * count) + l2 + 1e-12
    start_curve = mass.sum() / (4 * count)
    now, shift = np.zeros(size), 0.0
    ahead, ahead_shift, pace = now, shift, 1.0
    trust = ahead_trust = 0.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-_log_odds(rows, (ahead, ahead_shift)) - ahead_trust * column)) - good
        slope = _column_sums(rows, off, size) / count + l2 * ahead
        moved = ahead - slope / curve
        moved = np.sign(moved) * np.maximum(np.abs(moved) - l1 / curve, 0)
        moved_shift = ahead_shift - off.mean() / start_curve
        moved_trust = max(0.0, ahead_trust - (off * column).mean() / column_curve)
        if ((ahead - moved) * curve) @ (moved - now) > 0:  # the momentum points uphill
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / faster * (moved - now)
        ahead_shift = moved_shift + (pace - 1) / faster * (moved_shift - shift)
        ahead_trust = moved_trust + (pace - 1) / faster * (moved_trust - trust)
        now, shift, trust, pace = moved, moved_shift, moved_trust, faster
    if hint is None:
        return now, shift
    return now + trust * unit * hint, shift - trust * unit * middle


def fit_line(columns: np.ndarray, good: np.ndarray, steps: int = 30) -> np.ndarray:
    """Coefficients (the last is the intercept) of a logistic regression on a few columns, by Newton steps."""
    design = np.column_stack([columns, np.ones(len(columns))])
    line = np.zeros(design.shape[1])
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        curve = (design * (chance * (1 - chance))[:, None]).T @ design / len(good) + 1e-6 * np.eye(len(line))
        line = line - np.linalg.solve(curve, design.T @ (chance - good) / len(good) + 1e-6 * line)
    return line


def class_sums(rows: Rows, classes: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """For the rows flagged as bad and as good, how many hold each feature, and last how many there are."""
    present = (*rows[:2], None)
    return np.stack([np.append(_column_sums(present, own.astype(float), size), own.sum()) for own in classes])


def pseudo_sums(views: dict[str, Rows], models: dict, confident: float) -> dict[str, np.ndarray]:
    """For each view the `class_sums` of what the other view is sure of."""
    edge = math.log(confident / (1 - confident))
    out = {}
    for view, other in OTHER.items():
        odds = _log_odds(views[other], models[other])
        out[view] = class_sums(views[view], (odds <= -edge, odds >= edge), SIZES[view])
    return out


def log_ratios(sums: np.ndarray, prior: float, errors: float) -> np.ndarray | None:
    """Coefficients from the `class_sums` of a view, nearer to 0 by their standard errors; None if a class has no rows."""
    if not sums[:, -1].all():
        return None
    (bad, good), share = sums[:, :-1], sums[1, -1] / sums[:, -1].sum()
    good, bad = good + prior * share, bad + prior * (1 - share)
    ratios = np.log(good / bad) - math.log(share / (1 - share))
    error = np.sqrt(1 / ((good + bad) * share * (1 - share)))  # if the classes held the feature equally often
    return np.sign(ratios) * np.maximum(np.abs(ratios) - errors * error, 0)


def fit_views(views: dict[str, Rows], good: np.ndarray, train: np.ndarray, sums: dict[str, np.ndarray] | None) -> dict:
    """Both views' models from the rows in `train` and the sums of the pseudo-labels.

    The ratios are those of pseudo-labels and labels together, so that pseudo-labels of one class count too.
    """
    models = {}
    for view, size in SIZES.items():
        l1, l2, steps = FITTING[view]
        hint = None
        if sums is not None and sums[view].any():
            labelled = class_sums(views[view], (train & (good == 0), train & (good == 1)), size)
            hint = log_ratios(labelled + sums[view], *RATIOS[view])
        models[view] = fit_logistic(chosen_rows(views[view], train), good[train], size, l1 / math.sqrt(train.sum()), l2, steps, hint)
    return models


def combine(views: dict[str, Rows], models: dict, good: np.ndarray, held: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Calibration of each view and their combination, from the rows in `held`."""
    odds = {view: _log_odds(views[view], models[view])[held] for view in SIZES}
    scales = {view: fit_line(odds[view][:, None], good[held]) for view in SIZES}
    calibrated = np.column_stack([odds[view] * scales[view][0] + scales[view][1] for view in SIZES])
    return scales, fit_line(calibrated, good[held])


def co_train(views: dict[str, Rows], good: np.ndarray, part: np.ndarray, rounds: int, confident: float):
    """Both views' models, their calibration and the combination, from rows in `part` train, held or pool."""
    train, held, pool = (part == name for name in ("train", "held", "pool"))
    unlabelled = {view: chosen_rows(rows, pool) for view, rows in views.items()}
    models = fit_views(views, good, train, None)
    for _ in range(rounds):
        models = fit_views(views, good, train, pseudo_sums(unlabelled, models, confident) if pool.any() else None)
    return models, *combine(views, models, good, held)


def _sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most about `most` rows, by a hash of the key columns (the id by default)."""
    count = rows.count()
    if count <= most:
        return rows
    key = F.xxhash64(*(keys or ("doc_id",)), F.lit(5))
    return rows.filter(F.pmod(key, F.lit(1 << 20)) < int(most / count * (1 << 20)))


def _held_parts(rows: DataFrame) -> DataFrame:
    """Adds `part`: 'held' for every FOLDS-th text of each class in the order of a hash of the text, else 'train'.

    Folds are chosen within each class, so both parts hold both classes whenever each class has two texts or
    more; a class of one text keeps it for training. Copies of a text share their part. Runs over the bounded
    labelled sample only.
    """
    text_hash = F.xxhash64("text", F.lit(3))
    ranked = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy("good").orderBy(text_hash)))
    ranked = ranked.withColumn("_texts", F.max("_rank").over(Window.partitionBy("good")))
    held = (F.col("_texts") >= 2) & (F.col("_rank") % FOLDS == 1)
    return ranked.withColumn("part", F.when(held, "held").otherwise("train")).drop("_rank", "_texts")


class QualityModel:
    """Coefficients and intercept of both views, (slope, shift) of their calibration, and the combination."""

    def __init__(self, views: dict[str, tuple[np.ndarray, float]], scales: dict[str, list[float]], mix: list[float]):
        self.views, self.scales, self.mix = views, scales, mix


_VIEWS = pa.struct([("content", pa.list_(pa.int32())), ("layout", pa.list_(pa.int32())), ("numbers", pa.list_(pa.float64()))])


def _both_views(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for raw, *facts in zip(texts.to_pylist(), langs.to_pylist(), sources.to_pylist(), sizes.to_pylist()):
        places, values = layout_view(raw, *facts)
        out.append({"content": content_view(raw)[0].tolist(), "layout": places.tolist(), "numbers": values.tolist()})
    return pa.array(out, type=_VIEWS)


def _rows_of(batches: list[pa.RecordBatch]) -> dict[str, Rows]:
    return {
        "content": sparse_rows([(b.column("content"), None) for b in batches]),
        "layout": sparse_rows([(b.column("layout"), b.column("numbers")) for b in batches]),
    }


def pool_sums(pool: DataFrame, models: dict, confident: float) -> dict[str, np.ndarray]:
    """`pseudo_sums` over all rows of a table of features; each task sums its rows, then features are added up by a shuffle."""
    held = pool.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {view: np.zeros((2, size + 1)) for view, size in SIZES.items()}
        for batch in batches:
            if batch.num_rows:
                for view, sums in pseudo_sums(_rows_of([batch]), held.value, confident).items():
                    total[view] += sums
        for view, (bad, good) in total.items():
            places = np.flatnonzero(bad + good)
            yield pa.RecordBatch.from_arrays(
                [pa.array([view] * len(places), pa.string()), pa.array(places), pa.array(bad[places]), pa.array(good[places])],
                names=["view", "place", "bad", "good"],
            )

    found = pool.select("content", "layout", "numbers").mapInArrow(judge, "view string, place long, bad double, good double")
    table = found.groupBy("view", "place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    held.unpersist()
    views, places = np.array(table["view"].to_pylist(), dtype=str), table["place"].to_numpy()
    both = np.stack([table["bad"].to_numpy(), table["good"].to_numpy()])
    out = {view: np.zeros((2, size + 1)) for view, size in SIZES.items()}
    for view, sums in out.items():
        sums[:, places[views == view]] = both[:, views == view]
    return out


def fit_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, confident: float = CONFIDENT
) -> QualityModel | None:
    """Co-trains on a bounded sample of labelled and on all unlabelled rows; None if the labels don't hold both classes.

    All features (about 1 KB for each document) are made in parallel and written. Each round is one pass over
    those of the unlabelled rows, whose sums are of fixed size, and one task that fits the labelled sample.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    is_good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min(F.when(is_good, 1.0).otherwise(0.0)).alias("good")
    )
    columns = docs.select("doc_id", "text", "lang", "source", "n_chars")
    seen = F.arrow_udf(_both_views, "struct<content: array<int>, layout: array<int>, numbers: array<double>>")
    features = seen(utf8("text"), F.col("lang"), F.col("source"), F.col("n_chars")).alias("v")
    # The sample bounds labelled rows, not ids: a repeated id with many texts cannot fill the fitting task.
    every = columns.join(broadcast_if_small(known), "doc_id")
    labelled = stage(_sample(every, fit_rows, "doc_id", "text"), "quality_known")
    labelled = _held_parts(labelled)
    sample = stage(labelled.select("good", "part", features).select("good", "part", "v.*"), "quality_sample")
    if sample.select("good").distinct().count() < 2:
        return None
    rest = columns.join(broadcast_if_small(known.select("doc_id")), "doc_id", "left_anti")
    pool = stage(rest.select(features).select("v.*"), "quality_pool")

    def fitted(sums: dict[str, np.ndarray] | None) -> tuple[dict, dict[str, list[float]], list[float]]:
        held_sums = spark.sparkContext.broadcast(sums)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = list(batches)
            good = np.concatenate([b.column("good").to_numpy() for b in own])
            part = np.concatenate([np.array(b.column("part").to_pylist()) for b in own])
            views = _rows_of(own)
            own.clear()
            models = fit_views(views, good, part == "train", held_sums.value)
            held = part == "held"
            if len(np.unique(good[held])) < 2:  # a class too small to hold out: calibrate on all labelled rows
                held = np.ones(len(good), dtype=bool)
            scales, mix = combine(views, models, good, held)
            values = [[view, [*models[view][0], models[view][1]], list(scales[view])] for view in views] + [["mix", [], list(mix)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[k] for v in values], type=t) for k, t in enumerate((pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())))],
                names=["view", "model", "line"],
            )

        rows = {
            row["view"]: row
            for row in sample.repartition(1).sortWithinPartitions("part", "good", "content", "layout").mapInArrow(
                fit, "view string, model array<double>, line array<double>").collect()
        }
        held_sums.unpersist()
        models = {v: (np.array(rows[v]["model"][:-1]), rows[v]["model"][-1]) for v in SIZES}
        return models, {v: list(rows[v]["line"]) for v in SIZES}, list(rows["mix"]["line"])

    model = fitted(None)
    for _ in range(rounds):
        model = fitted(pool_sums(pool, model[0], confident))
    return QualityModel(*model)


def score_quality(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds quality: struct(p_content, p_layout, score, good) with calibrated probabilities of a good document."""
    if model is None:
        one = F.lit(1.0)
        return docs.withColumn(
            "quality", F.struct(one.alias("p_content"), one.alias("p_layout"), one.alias("score"), F.lit(True).alias("good"))
        )
    spark = docs.sparkSession
    prepare_python(spark)
    held = spark.sparkContext.broadcast(model.views)

    def judge(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        (words, start), (layout, offset) = held.value["content"], held.value["layout"]
        content, page = [], []
        for raw, *facts in zip(texts.to_pylist(), langs.to_pylist(), sources.to_pylist(), sizes.to_pylist()):
            places, values = content_view(raw)
            content.append(float(words[places] @ values) + start)
            places, values = layout_view(raw, *facts)
            page.append(float(layout[places] @ values) + offset)
        return pa.StructArray.from_arrays([pa.array(content, pa.float64()), pa.array(page, pa.float64())], names=["content", "layout"])

    odds = F.arrow_udf(judge, "struct<content: double, layout: double>")(utf8("text"), F.col("lang"), F.col("source"), F.col("n_chars"))
    scored = docs.withColumn("_odds", odds)
    calibrated = {v: F.col("_odds")[v] * slope + shift for v, (slope, shift) in model.scales.items()}
    *weights, shift = model.mix
    total = sum((w * calibrated[v] for w, v in zip(weights, calibrated)), F.lit(shift))
    chance = lambda x: 1 / (1 + F.exp(-x))
    return scored.withColumn(
        "quality",
        F.struct(
            chance(calibrated["content"]).alias("p_content"), chance(calibrated["layout"]).alias("p_layout"),
            chance(total).alias("score"), (chance(total) >= keep_from).alias("good"),
        ),
    ).drop("_odds")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, with their own columns, that the classifier finds good."""
    facts = docs.select("doc_id", "text", "lang", "source", "n_chars", F.struct("*").alias("_row"))
    scored = score_quality(facts, fit_quality(docs, labels, **options))
    return scored.filter(F.col("quality")["good"]).select("_row.*")
