"""Shared pieces of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words, as Java regex class bodies.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def others(df: DataFrame, *reserved: str) -> list[Column]:
    """Columns of ``df`` whose names do not clash with ``reserved``."""
    taken = {name.lower() for name in reserved}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def count_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words of a text, empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def digest60(*parts: Column | str) -> Column:
    """A seeded hash in [0, 2^60) that other SQL engines can repeat: the head of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
