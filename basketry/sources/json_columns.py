"""JSON text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Replace columns by one JSON text column."""
    return df.withColumn(out, F.to_json(F.struct(*columns))).drop(*columns)


def unpack(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Replace a JSON text column by typed columns; malformed text gives nulls."""
    rest = [c for c in df.columns if c != column]
    return df.withColumn("_json", F.from_json(column, schema)).select(*rest, "_json.*")


def as_variant(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.try_parse_json(column))
