"""The pointwise reranker: median imputation, standardisation, L2 logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import sigmoid
from rankloom.operators.statistics import (
    class_weights, feature_scaling, impute_and_scale, sanitize,
)

# Default parameters and search grid, in order.
DEFAULT_PARAMS = {"C": 0.5, "solver": "liblinear", "class_weight": "balanced", "max_iter": 2000}
PARAM_GRID = [
    {"C": 0.1, "solver": "liblinear", "class_weight": "balanced", "max_iter": 2000},
    {"C": 0.5, "solver": "liblinear", "class_weight": "balanced", "max_iter": 2000},
    {"C": 1.0, "solver": "liblinear", "class_weight": "balanced", "max_iter": 2000},
    {"C": 2.0, "solver": "liblinear", "class_weight": "balanced", "max_iter": 2000},
    {"C": 1.0, "solver": "lbfgs", "class_weight": "balanced", "max_iter": 2000},
    {"C": 2.0, "solver": "lbfgs", "class_weight": "balanced", "max_iter": 2000},
]

PARAMS_SCHEMA = "position int, feature string, median double, mean double, std double, coefficient double"
INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class RerankerModel:
    """Everything needed to score a frame, one entry per selected feature."""

    features: list[str]
    median: list[float]
    mean: list[float]
    std: list[float]
    coefficient: list[float]
    intercept: float
    params: dict[str, object] = field(default_factory=lambda: dict(DEFAULT_PARAMS))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, *row) for i, row in enumerate(
                zip(self.features, self.median, self.mean, self.std, self.coefficient)
            )
        ]
        rows.append((len(rows), INTERCEPT, 0.0, 0.0, 1.0, self.intercept))
        return spark.createDataFrame(rows, PARAMS_SCHEMA)

    @classmethod
    def from_frame(cls, table: DataFrame, params: dict[str, object] | None = None) -> "RerankerModel":
        rows = table.orderBy("position").collect()
        inputs = [row for row in rows if row["feature"] != INTERCEPT]
        intercept = next(row["coefficient"] for row in rows if row["feature"] == INTERCEPT)
        return cls(
            [r["feature"] for r in inputs], [r["median"] for r in inputs], [r["mean"] for r in inputs],
            [r["std"] for r in inputs], [r["coefficient"] for r in inputs], intercept,
            dict(params or DEFAULT_PARAMS),
        )


def fit_reranker(
    train: DataFrame, features: list[str], params: dict[str, object] | None = None
) -> RerankerModel:
    """Fit on all given rows (query_id, doc_id, label, features...).

    The loss summed over rows with inverse strength C equals Spark's mean loss with
    regParam = 1 / (C * total weight). The `liblinear` variant also penalises the intercept: it is
    then a constant input. Spark gives constant inputs no coefficient, so each row enters twice with half its
    weight: as it is, and with all inputs and the label flipped, which leaves the loss unchanged.

    Rows of one class only (all of a query's best documents can be judged, which leaves no negatives) have
    an optimum when the intercept is penalised; a free intercept would grow without end and is refused.
    """
    params = {**DEFAULT_PARAMS, **(params or {})}
    clean = sanitize(train, features)
    scaling = feature_scaling(clean, features)
    table = {row["feature"]: row for row in scaling.collect()}
    rows = impute_and_scale(clean, scaling, features)
    if params["class_weight"] == "balanced":
        weights = {r["label"]: r["weight"] for r in class_weights(train).collect()}
        weight = F.when(F.col("label") > 0, weights.get(1, 0.0)).otherwise(weights.get(0, 0.0))
    else:
        weight = F.lit(1.0)
    rows = rows.withColumn("_weight", weight)
    penalise_intercept = params["solver"] == "liblinear"
    if not penalise_intercept and train.select("label").distinct().count() < 2:
        raise ValueError("training rows hold one class only: a free intercept has no optimum")
    inputs = list(features)
    if penalise_intercept:
        both = F.explode(F.array(F.lit(1.0), F.lit(-1.0)))
        rows = rows.withColumn("_sign", both).withColumn("_weight", F.col("_weight") / 2)
        rows = rows.select(
            *[(F.col("_sign") * F.col(c)).alias(c) for c in features],
            F.col("_sign").alias("_constant"),
            F.when(F.col("_sign") > 0, F.col("label")).otherwise(1 - F.col("label")).alias("label"),
            "_weight",
        )
        inputs.append("_constant")
    total = rows.agg(F.sum("_weight")).first()[0]
    vectors = (
        VectorAssembler(inputCols=inputs, outputCol="_x")
        .transform(rows.withColumn("label", F.col("label").cast("double")))
        .select("_x", "label", "_weight")
    )
    estimator = LogisticRegression(
        featuresCol="_x", labelCol="label", weightCol="_weight", standardization=False,
        elasticNetParam=0.0, regParam=1.0 / (float(params["C"]) * total),
        fitIntercept=not penalise_intercept, maxIter=int(params["max_iter"]), tol=1e-10,
        family="binomial",
    )
    vectors.persist()
    try:
        fitted = estimator.fit(vectors)
    finally:
        vectors.unpersist()
    coefficients = [float(c) for c in fitted.coefficients]
    intercept = coefficients.pop() if penalise_intercept else float(fitted.intercept)
    return RerankerModel(
        list(features),
        [table[f]["median"] for f in features],
        [table[f]["mean"] for f in features],
        [table[f]["std"] for f in features],
        coefficients, intercept, params,
    )


def margin(model: RerankerModel):
    """Decision value as one column expression: impute, scale, weigh, sum."""
    total = F.lit(model.intercept)
    for name, median, mean, std, weight in zip(
        model.features, model.median, model.mean, model.std, model.coefficient
    ):
        total = total + (F.coalesce(F.col(name), F.lit(median)) - F.lit(mean)) / F.lit(std) * F.lit(weight)
    return total


def score_rows(model: RerankerModel, frame: DataFrame) -> DataFrame:
    """Sanitised frame + score in (0, 1); a projection, no shuffle."""
    return sanitize(frame, model.features).withColumn("score", sigmoid(margin(model)))


def coefficient_importance(model: RerankerModel, spark: SparkSession) -> DataFrame:
    """feature, coefficient, abs_coefficient, largest first."""
    rows = [(f, c, abs(c)) for f, c in zip(model.features, model.coefficient)]
    return spark.createDataFrame(
        rows, "feature string, coefficient double, abs_coefficient double"
    ).orderBy(F.desc("abs_coefficient"), "feature")
