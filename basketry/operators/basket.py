"""Products bought together.

Each unordered pair is made once per sale and mirrored at the end, which
halves the shuffle. A large sale is cut into blocks of products; a task joins
one block with another, so no task ever holds a whole large sale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
_LINES = 500_000  # mean number of lines whose pairs one task makes and counts


def baskets(detalles: DataFrame) -> DataFrame:
    """The distinct products of each sale."""
    return detalles.select("venta_id", "producto_id").distinct()


def _pairs_per_sale(detalles: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per sale and unordered pair of products (``a`` < ``b``)."""
    lines = detalles.select("venta_id", "producto_id")
    large = (
        lines.groupBy("venta_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > block)
        .select("venta_id", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    )
    # The usual sale fits in an array: one shuffle, and pairs are made in place. AQE would merge partitions
    # by the bytes of their lines; a task holds the counts of all its pairs, so the number of tasks follows the lines.
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // _LINES))
    small = (
        lines.repartition(parts, "venta_id")
        .join(large.select("venta_id"), "venta_id", "left_anti")
        .groupBy("venta_id")
        .agg(F.collect_set("producto_id").alias("_set"))
        .select("_set", F.explode("_set").alias("a"))
        .select("a", F.explode("_set").alias("b"))
        .where(F.col("a") < F.col("b"))
    )
    return small.unionByName(_block_pairs(lines.distinct().join(large, "venta_id")))


def _block_pairs(basket: DataFrame) -> DataFrame:
    """Pairs of large sales, made block by block."""
    cut = basket.withColumn("_b", F.pmod(F.xxhash64("producto_id"), F.col("_blocks")).cast("int"))
    left = cut.select(
        "venta_id",
        F.col("_b").alias("_i"),
        F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_j"),
        F.col("producto_id").alias("_p"),
    )
    right = cut.select(
        "venta_id",
        F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"),
        F.col("_b").alias("_j"),
        F.col("producto_id").alias("_q"),
    )
    once = (F.col("_i") != F.col("_j")) | (F.col("_p") < F.col("_q"))
    return left.join(right, ["venta_id", "_i", "_j"]).where(once).select(
        F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b")
    )


def pair_counts(detalles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Number of sales per unordered pair (``a`` < ``b``)."""
    return _pairs_per_sale(detalles, block).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def mirrored(pairs: DataFrame, *carried: str) -> DataFrame:
    """Both directions of each unordered pair, from one pass over the pairs."""
    ways = F.array(
        F.struct(F.col("a").alias("p1"), F.col("b").alias("p2")),
        F.struct(F.col("b").alias("p1"), F.col("a").alias("p2")),
    )
    return pairs.select(F.inline(ways), *carried)


def copurchase_pairs(detalles: DataFrame, block: int = BLOCK) -> DataFrame:
    """The set of ordered pairs of different products seen in one sale."""
    return mirrored(pair_counts(detalles, block))


def copurchase_matrix(detalles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sales per ordered pair, and that count over the sales of the first product."""
    sold = baskets(detalles).groupBy(F.col("producto_id").alias("p1")).agg(F.count(F.lit(1)).alias("_sales"))
    return (
        mirrored(pair_counts(detalles, block), "n")
        .join(sold, "p1")
        .select(
            F.col("p1").alias("product_a"),
            F.col("p2").alias("product_b"),
            F.col("n").alias("count"),
            (F.col("n") / F.col("_sales")).alias("confidence"),
        )
    )
