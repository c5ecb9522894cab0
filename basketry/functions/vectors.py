"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def json_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def register(spark: SparkSession) -> None:
    """Make ``cosine_similarity(json, json)`` callable from SQL.

    The body is SQL, so Catalyst inlines it into the calling plan.
    """
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(vec1 STRING, vec2 STRING) RETURNS DOUBLE
        RETURN coalesce(try_divide(
          aggregate(zip_with(from_json(vec1, 'array<double>'), from_json(vec2, 'array<double>'), (x, y) -> x * y),
                    0D, (s, v) -> s + v),
          sqrt(aggregate(from_json(vec1, 'array<double>'), 0D, (s, v) -> s + v * v))
          * sqrt(aggregate(from_json(vec2, 'array<double>'), 0D, (s, v) -> s + v * v))), 0D)
        """
    )
