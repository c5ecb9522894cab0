"""Keyed tables in hash buckets, of which a change rewrites only those it touches.

A table is a list of buckets, each the folder that holds its rows; the list is
published by a pointer. A change reads the buckets of its keys, combines them
with its rows, writes these buckets anew and moves the pointer. Readers see the
list of before or of after, and a job that dies leaves nothing they can see.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import materialize
from basketry.sources import pointer

BUCKETS = 256
KEPT = 2  # former lists whose folders stay for readers that still use them


class Overtaken(RuntimeError):
    """Another change was published first; this one must be made again."""


class KeyedTable:
    """Rows of ``schema`` with at most one row per key, in buckets by the hash of ``keys``.

    The number of buckets is fixed when the table is first written. A bucket
    should hold what one task can sort; keys are unique, so no bucket is hot.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys = spark, root, schema, list(keys)
        self._pointer = f"{root}/pointer"
        self._buckets = buckets

    def _entry(self) -> pointer.Entry | None:
        return pointer.latest(self.spark, self._pointer)

    def _count(self, entry: pointer.Entry | None) -> int:
        return entry.content["buckets"] if entry else self._buckets

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(count)).cast("int")

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        entry = self._entry()
        return self._rows(sorted(entry.content["folders"].values()) if entry else [])

    def last_change(self) -> str | None:
        """The mark of the newest change, as given to ``change``."""
        entry = self._entry()
        return entry.content["mark"] if entry else None

    def change(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], mark: str | None = None) -> list[int]:
        """Replace the touched buckets by ``combine(their rows, batch)``; the numbers of these buckets.

        ``batch`` has the key columns; ``combine`` returns rows of the schema whose keys
        are in the touched buckets. A change whose ``mark`` is the newest one's was
        made already and does nothing, so a change may be repeated after a failure.
        """
        entry = self._entry()
        if entry and mark is not None and entry.content["mark"] == mark:
            return []
        count = self._count(entry)
        batch = materialize(batch, "change")
        # At most one number per bucket comes to the driver.
        touched = sorted(r[0] for r in batch.select(self._bucket(count)).distinct().collect())
        folders = dict(entry.content["folders"]) if entry else {}
        old = [folders.pop(str(b)) for b in touched if str(b) in folders]
        target = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = combine(self._rows(old), batch).withColumn("_bucket", self._bucket(count))
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(target)
        for name in pointer.Folder(self.spark, target).names():
            if name.startswith("_bucket="):
                folders[name.removeprefix("_bucket=")] = f"{target}/{name}"
        former = [*(entry.content["former"] if entry else []), old]
        content = {"buckets": count, "folders": folders, "mark": mark, "former": former[-KEPT:]}
        if pointer.move(self.spark, self._pointer, content, entry) is None:
            raise Overtaken(self.root)
        for gone in former[:-KEPT]:
            for folder in gone:
                pointer.Folder(self.spark, folder).drop()
        return touched

    def upsert(self, batch: DataFrame, order: Sequence[str], mark: str | None = None) -> list[int]:
        """Insert or replace rows by key; of several batch rows with one key the last in ``order`` wins."""
        from basketry.operators.mutations import upsert

        return self.change(batch, lambda old, new: upsert(old, new, self.keys, order).select(*old.columns), mark)
