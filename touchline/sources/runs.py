"""Append-only tables of training runs, published predictions and model versions."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.upsert import append_new
from touchline.plans.models import load_model

RUN_TABLES = {
    "configs": ["run_id"],
    "fold_metrics": ["run_id", "fold_id"],
    "predictions": ["run_id", "fold_id", "fixture_id"],
    "calibrators": ["run_id", "fold_id"],
    "summaries": ["run_id"],
}
PUBLISHED_KEY = ["model_name", "model_version", "fixture_id"]
REGISTRY_KEY = ["model_name", "model_version"]
COMPARISON_COLUMNS = [
    "model_name",
    "model_version",
    "dataset_version",
    "iterator_params",
    "n_folds",
    "mean_accuracy",
    "std_accuracy",
    "mean_log_loss",
    "std_log_loss",
    "mean_ece",
    "mean_mce",
    "total_n_predictions",
    "weighted_log_loss",
    "weighted_ece",
]


def run_id(dataset_version: str, iterator_params: dict, model_name: str, model_version: str, seed: int) -> str:
    """First 16 hex digits of SHA-256 over the sorted JSON of what defines a run."""
    parts = {
        "dataset_version": dataset_version,
        "iterator_params": iterator_params,
        "model_name": model_name,
        "model_version": model_version,
        "seed": seed,
    }
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table, or an empty one where nothing has been written yet; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def append_once(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key is not stored yet; returns how many were already there."""
    stored = read_or_empty(df.sparkSession, path, df)
    known = df.join(stored.select(*keys), keys, "left_semi").count()
    append_new(stored, df, keys).write.mode("append").parquet(path)
    return known


class RunStore:
    """Run tables below one folder, write-once per key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, table: str, df: DataFrame) -> int:
        return append_once(df, f"{self.root}/{table}", RUN_TABLES[table])

    def load(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")


class ModelRegistry:
    """Registry rows plus the fitted payload of each (model, version)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model, version: str, training_version: str, cutoff: str, now: str, seed: int | None, features: list[str]) -> DataFrame:
        payload = json.dumps({"hyper": model.hyper, "features": features, "model": model.name, "state": model.state()}, sort_keys=True)
        path = f"{self.root}/payloads/{model.name}/{version}"
        row = self.spark.createDataFrame(
            [(model.name, version, training_version, cutoff, now, seed, payload, hashlib.sha256(payload.encode()).hexdigest(), path)],
            "model_name string, model_version string, training_data_version string, training_cutoff string, "
            "created_at string, fitted_seed long, payload string, payload_sha256 string, payload_ref string",
        )
        known = read_or_empty(self.spark, f"{self.root}/registry", row)
        if known.join(row.select(*REGISTRY_KEY), REGISTRY_KEY, "left_semi").count():
            raise ValueError(f"{model.name} {version} is already registered")
        model.save(path)
        row.write.mode("append").parquet(f"{self.root}/registry")
        return row

    def load(self, name: str, version: str) -> dict:
        r = self.spark.read.parquet(f"{self.root}/registry").where(
            (F.col("model_name") == name) & (F.col("model_version") == version)
        ).first()
        if r is None:
            raise KeyError(f"{name} {version} is not registered")
        if hashlib.sha256(r["payload"].encode()).hexdigest() != r["payload_sha256"]:
            raise ValueError(f"payload of {name} {version} does not match its digest")
        return {**r.asDict(), **json.loads(r["payload"])}

    def load_model(self, name: str, version: str):
        """The registered model, ready to transform rows."""
        r = self.load(name, version)
        return load_model(name, r["hyper"], r["state"], r["payload_ref"])


def publish_predictions(df: DataFrame, path: str) -> int:
    """Append predictions once per (model, version, match); returns the number of repeats ignored."""
    return append_once(df, path, PUBLISHED_KEY)


def save_comparison(df: DataFrame, path: str) -> None:
    df.select(*COMPARISON_COLUMNS).coalesce(1).write.option("header", True).csv(path)
