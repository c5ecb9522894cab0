"""Numbering and running sums that never send a whole key to one task.

A plain window puts all rows of a partition key in one task, and a window
without a key puts the whole table there. Here rows are first cut into chunks
that follow the order. Totals per chunk are pre-aggregated on the map side, a
window runs over those totals only, and the second window works inside one
chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.session import materialize


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Add, per entry of ``sums``, the sum of that value over all earlier rows of the key.

    ``chunk`` must grow with ``order``; ``order`` must be unique inside a key.
    """
    names = list(sums)
    src = df.withColumns({f"__v_{n}": sums[n] for n in names})
    totals = src.groupBy(*keys, chunk).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, chunk, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names]
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = src.join(offsets, [*keys, chunk])
    return joined.withColumns(
        {n: F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in names}
    ).drop(*[f"__v_{n}" for n in names], *[f"__o_{n}" for n in names])


def number_rows(df: DataFrame, order: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """Global row numbers in ``order``, which is unique.

    Chunks are ranges of equal size, whatever the values: names with one common
    beginning or sparse positions spread like any others. Without a key the outer
    window sees one row per chunk.
    """
    chunked = range_chunks(df, order, "numbered", "__chunk")
    numbered = running_sums(chunked, [], "__chunk", order, {out: F.lit(1).cast("bigint")})
    return numbered.withColumn(out, F.col(out) + F.lit(start)).drop("__chunk")


def dense_position(distinct: DataFrame, column: str, out: str, start: int = 1) -> DataFrame:
    """Alphabetical position of each row of a frame of distinct names."""
    return number_rows(distinct, [column], out, start)


def range_chunks(df: DataFrame, order: Sequence[str], name: str, out: str = "chunk") -> DataFrame:
    """Cut a frame into evenly filled chunks that follow ``order``.

    The range partition number becomes a column; there are as many as the session
    has shuffle partitions. The frame is written, so that the bounds, which Spark
    samples, cannot change between uses.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id())
    return materialize(cut, name)
