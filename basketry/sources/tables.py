"""Typed table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """A scan with a fixed schema: nothing is inferred, unused columns are never read."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    key: str = "id",
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
    **options: str,
) -> DataFrame:
    """A JDBC scan; with ``bounds`` of the key it is read in parallel slices."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        low, high = bounds
        reader = reader.options(
            partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
        )
    return reader.load()


def check_schema(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Fail early when columns or types differ from the model."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("unexpected columns: " + ", ".join(wrong))
    return df.select(*[f.name for f in schema])
