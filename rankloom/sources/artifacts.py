"""Writers and readers of a run's results under one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import RankingConfig
from rankloom.operators.reranker import RerankerModel

REQUIRED = ("run_config", "query_split", "summary", "model_params")


def write_frame(frame: DataFrame, folder: str, name: str, fmt: str = "parquet") -> None:
    """Feature or scored frame, one sub-folder per split so that readers skip the other one."""
    writer = frame.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(f"{folder}/{name}")


def read_frame(spark: SparkSession, folder: str, name: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Read a frame back with the schema of `like` (no inference) and its column order."""
    reader = spark.read.format(fmt).schema(like.schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{folder}/{name}").select(*like.columns)


def write_json(spark: SparkSession, folder: str, name: str, payload: dict) -> None:
    """One small driver-side payload as a JSON text table."""
    text = spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def read_json(spark: SparkSession, folder: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{name}").first()["value"])


def write_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def save_model(model: RerankerModel, spark: SparkSession, folder: str) -> None:
    write_table(model.to_frame(spark).coalesce(1), folder, "model_params")
    write_json(spark, folder, "model_settings", model.params)


def load_model(spark: SparkSession, folder: str) -> RerankerModel:
    return RerankerModel.from_frame(
        read_table(spark, folder, "model_params"), read_json(spark, folder, "model_settings")
    )


def save_config(config: RankingConfig, spark: SparkSession, folder: str) -> None:
    write_json(spark, folder, "run_config", config.to_dict())


def load_config(spark: SparkSession, folder: str) -> RankingConfig:
    return RankingConfig.from_dict(read_json(spark, folder, "run_config"))


def missing_artifacts(spark: SparkSession, folder: str) -> list[str]:
    missing = []
    for name in REQUIRED:
        try:
            spark.read.format("binaryFile").load(f"{folder}/{name}").select("path").take(1)
        except Exception as error:  # an absent path is the only case that counts
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing.append(name)
    return missing


def tuning_table(spark: SparkSession, tuning: dict) -> DataFrame:
    """C, solver, fold_scores, mean_ndcg_at_10: one row per parameter set tried."""
    rows = [
        (float(r["params"]["C"]), r["params"]["solver"], r["fold_scores"], r["mean_ndcg_at_10"])
        for r in tuning["candidate_results"]
    ]
    return spark.createDataFrame(
        rows, "c double, solver string, fold_scores array<double>, mean_ndcg_at_10 double"
    )


def selection_table(spark: SparkSession, selection: dict) -> DataFrame:
    """step, features, cv_ndcg_at_10: the elimination history in order."""
    rows = [
        (i, h["step"], h["features"], h["cv_ndcg_at_10"])
        for i, h in enumerate(selection["history"])
    ]
    return spark.createDataFrame(
        rows, "position int, step string, features array<string>, cv_ndcg_at_10 double"
    ).orderBy(F.col("position"))
