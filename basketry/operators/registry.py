"""Model registry, prediction and feature caches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.model import MODEL_METADATA
from basketry.operators import anomaly, pricing, segments
from basketry.operators.mutations import insert_if_absent, latest_per_key, unexpired, upsert

FEATURE_KEY = ["entity_type", "entity_id", "version"]
MODELS = (pricing.NAME, segments.NAME, anomaly.NAME)


def register_model(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per model, the latest training winning."""
    return upsert(registry, runs, ["model_name"], ["trained_at"])


def model_info(registry: DataFrame, names: Sequence[str] = MODELS) -> DataFrame:
    """A row for every known model name; defaults where it was never trained."""
    spark = registry.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "model_name string")
    # One row per model name.
    latest = latest_per_key(registry, ["model_name"], ["trained_at"])
    return wanted.join(latest, "model_name", "left").select(
        "model_name",
        "trained_at",
        "accuracy",
        F.coalesce("samples_count", F.lit(0).cast("bigint")).alias("samples_count"),
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
    )


def training_runs(spark: SparkSession, at: datetime, runs: Sequence[tuple[str, float | None, int, Sequence[str]]]) -> DataFrame:
    """Registry rows of trainings (name, accuracy, samples, features) that ended at one time."""
    rows = [(name, at, accuracy, samples, list(features)) for name, accuracy, samples, features in runs]
    return spark.createDataFrame(rows, MODEL_METADATA)


def training_run(
    spark: SparkSession, name: str, at: datetime, accuracy: float | None, samples: int, features: Sequence[str]
) -> DataFrame:
    return training_runs(spark, at, [(name, accuracy, samples, features)])


def input_key(*columns: str) -> Column:
    """Hash of a request's input as JSON."""
    return X.content_hash(F.to_json(F.struct(*columns)))


def not_cached(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests (with ``key``) that no unexpired cache row answers."""
    valid = unexpired(cache, "valid_until", as_of)
    return requests.join(valid.select("key"), "key", "left_anti")


def add_to_cache(cache: DataFrame, computed: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Unexpired rows plus the new results (``key``, ``payload``) with their expiry."""
    rows = computed.select(
        "key",
        "payload",
        as_of.alias("created_at"),
        (as_of + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("valid_until"),
    )
    return insert_if_absent(unexpired(cache, "valid_until", as_of), rows, ["key"])


def feature_rows(
    df: DataFrame, entity_type: str, ident: str, features: Sequence[str], at: Column, version: str = "1.0"
) -> DataFrame:
    """Features of each entity as JSON, with the time they were computed."""
    return df.select(
        F.lit(entity_type).alias("entity_type"),
        F.col(ident).cast("bigint").alias("entity_id"),
        F.lit(version).alias("version"),
        F.to_json(F.struct(*features)).alias("features"),
        at.cast("timestamp").alias("computed_at"),
    )


def store_features(store: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per entity and version. Rows win over the store; of several rows the one computed last."""
    return upsert(store, rows, FEATURE_KEY, ["computed_at", "features"])
