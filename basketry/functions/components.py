"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (a, b): the smallest node it is connected with.

    In a round every node first links its larger neighbours to the smallest node
    around it, then itself and its smaller neighbours to the smallest of these. Minima
    are summed up before the shuffle, so a hub's links are never gathered. Rounds
    grow with the logarithm of the number of nodes; each is written to the shared folder.
    """
    links = _down(edges)
    while not _stars(links):
        links = materialize(links, "links")
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(_down(large), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        links = materialize(_down(near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))), "links")
    inner = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return inner.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has one only, and that one has none."""
    chained = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
    forked = links.groupBy("a").count().where("count > 1").select("a")
    return chained.union(forked).isEmpty()
