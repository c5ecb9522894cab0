"""Versioned snapshots: a refresh writes new tables, then moves a pointer to them."""

from __future__ import annotations

import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from basketry.sources import pointer

# States of the audit log.
OK, FAILED = "EXITOSA", "FALLIDA"
_AUDIT = "tipo string, num_registros bigint, estado string, mensaje string, fecha_sincronizacion timestamp, duracion_ms bigint"


class EmptyExtract(RuntimeError):
    """An empty extract must not replace a filled snapshot."""


class Superseded(RuntimeError):
    """Another refresh was published in between."""


def write_table(df: DataFrame, target: str) -> int:
    """Write a table; its rows are counted from the written files, so no plan runs twice."""
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target).count()


def publish(spark: SparkSession, root: str, tables: dict[str, str], at: datetime, expected: pointer.Entry = pointer.ANY) -> pointer.Entry:
    """Let readers see ``tables`` (name: folder). With ``expected``, only if no other refresh came since."""
    entry = pointer.move(spark, f"{root}/pointer", {"at": at.isoformat(), "tables": tables}, expected)
    if entry is None:
        raise Superseded(f"{root}: entry {expected.number} no longer holds")
    return entry


def current(spark: SparkSession, root: str) -> pointer.Entry:
    entry = pointer.latest(spark, f"{root}/pointer")
    if entry is None:
        raise FileNotFoundError(f"{root}: nothing was published yet")
    return entry


def read_snapshot(spark: SparkSession, root: str, name: str, entry: pointer.Entry | None = None) -> DataFrame:
    """A table of the published snapshot, or of a given entry, so that several reads see one state."""
    return spark.read.parquet((entry or current(spark, root)).content["tables"][name])


def full_refresh(spark: SparkSession, tables: dict[str, DataFrame], root: str, at: datetime) -> tuple[pointer.Entry, dict[str, int]]:
    """Write, check, publish and log all tables.

    Nothing is published if a table is empty or cannot be written. Every table gets
    an audit row with its own rows and time; a failed one with its message.
    """
    counts, places = _write(spark, tables, root, at)
    return publish(spark, root, places, at), counts


def replace_tables(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, at: datetime, expected: pointer.Entry
) -> tuple[pointer.Entry, dict[str, int]]:
    """A second stage: some tables anew, the others as in ``expected``, which must still hold."""
    counts, places = _write(spark, tables, root, at)
    return publish(spark, root, {**expected.content["tables"], **places}, at, expected), counts


def _write(spark: SparkSession, tables: dict[str, DataFrame], root: str, at: datetime) -> tuple[dict[str, int], dict[str, str]]:
    version = uuid.uuid4().hex
    counts: dict[str, int] = {}
    places: dict[str, str] = {}
    log: list[tuple] = []
    try:
        for name, df in tables.items():
            begun = time.monotonic()
            took = lambda since=begun: int((time.monotonic() - since) * 1000)
            places[name] = f"{root}/versions/{version}/{name}"
            try:
                counts[name] = write_table(df, places[name])
            except Exception as error:
                log.append((name, 0, FAILED, f"{type(error).__name__}: {error}"[:500], at, took()))
                raise
            log.append((name, counts[name], OK, None, at, took()))
        empty = [n for n, c in counts.items() if c == 0]
        if empty:
            note = "extracto vacío: " + ", ".join(empty)
            log = [(name, rows, FAILED, note, when, ms) for name, rows, _, _, when, ms in log]
            raise EmptyExtract(note)
    finally:
        audit(spark, root, log)
    return counts, places


def audit(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, _AUDIT).coalesce(1).write.mode("append").parquet(f"{root}/audit")


def audit_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_AUDIT).parquet(f"{root}/audit")
