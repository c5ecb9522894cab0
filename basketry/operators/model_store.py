"""Fitted models kept for later use.

A version of a model is a folder: tables, Spark ML models, and a small file that
describes it. The pointer of the model moves to the folder when all of it is
written, so a reader sees whole versions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from basketry.sources import pointer

# Fixed value: how long a trained model is used.
REUSE = timedelta(hours=1)


@dataclass
class Stored:
    """One published version of a model."""

    spark: SparkSession
    path: str
    at: datetime
    info: dict[str, Any]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def pipeline(self, name: str) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/{name}")


class ModelStore:
    """Versions of named models below ``root``, a folder that the executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/pointer"

    def save(self, name: str, at: datetime, parts: dict[str, DataFrame | PipelineModel], info: dict[str, Any]) -> Stored:
        """Write all parts, then publish. The latest to finish holds, even at equal times."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        for part, value in parts.items():
            if isinstance(value, DataFrame):
                value.write.parquet(f"{path}/{part}")
            else:
                value.save(f"{path}/{part}")
        pointer.move(self.spark, self._pointer(name), {"path": path, "at": at.isoformat(), "info": info})
        return Stored(self.spark, path, at, info)

    def latest(self, name: str) -> Stored | None:
        entry = pointer.latest(self.spark, self._pointer(name))
        if entry is None:
            return None
        kept = entry.content
        return Stored(self.spark, kept["path"], datetime.fromisoformat(kept["at"]), kept["info"])

    def fresh(self, name: str, now: datetime, ttl: timedelta = REUSE) -> Stored | None:
        """The stored version, if it was trained less than ``ttl`` ago."""
        stored = self.latest(name)
        return stored if stored and timedelta(0) <= now - stored.at < ttl else None

    def train_or_load(self, name: str, now: datetime, train: Callable[[], tuple[dict, dict] | None], ttl: timedelta = REUSE) -> Stored | None:
        """The stored version while it is fresh; otherwise ``train`` gives (parts, info) of a new one.

        None if ``train`` gives None: too little data for a model. An older version then stays stored.
        """
        stored = self.fresh(name, now, ttl)
        if stored:
            return stored
        trained = train()
        return self.save(name, now, *trained) if trained else None
