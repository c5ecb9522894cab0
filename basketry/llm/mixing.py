"""Mix sources to target weights by hash thresholds.

Each document has a seeded 60-bit hash. A source that should give T words of
its S takes every document T // S times and the documents below a hash
threshold once more. The threshold comes from sums of sizes by source and hash
bucket: the bucket in which the sum passes the budget is the only one that is
refined, until it holds one document (or equal hashes). Nothing is sorted, and
a larger budget only adds documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import count_words, digest60, others
from basketry.session import materialize

BITS = 12  # of the hash in one level: at most 4,096 buckets of a source
LEVELS = 5  # 60 bits


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. A target stops at
    ``limit`` times the source's size; the excess goes to the others by weight.
    That fixed point is a common level: target = min(limit * size, level * weight).
    One row per source meets in one task here; sources are a dimension of the
    collection, not of its documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    capped = sizes.select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * float(limit)).alias("cap")
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    levels = capped.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    # The first source, by ratio, that its level does not fill sets the level of all after it.
    chosen = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)
    return levels.withColumn("water", chosen["level"]).select(
        "source",
        "source_size",
        F.when(F.col("water").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
        .alias("target"),
    )


def hash_cuts(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, base, cut): documents of hash < cut are taken once more.

    ``slim`` has source, size and hash. Each level reads only the rows of the
    boundary buckets and sums them by source and bucket before shuffling.
    """
    state = materialize(
        targets.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("below", F.lit(0).cast("long"))
        .withColumn("inside", F.lit(0).cast("long"))
        .withColumn("rows", F.lit(2).cast("long"))
        .withColumn("level", F.lit(0)),
        "mix-state",
    )
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        open_ = state.where("rows > 1").select(F.col("source").alias("of"), F.col("prefix"))
        bucket = F.shiftright("hash", shift)
        sums = (
            slim.join(open_, slim.source.eqNullSafe(open_.of) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
            .groupBy(F.col("of"), bucket.alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        )
        known = state.alias("s").join(sums.alias("h"), F.col("s.source").eqNullSafe(F.col("h.of")) & (F.col("s.rows") > 1))
        upto = F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
        passed = known.withColumn("upto", F.col("below") + upto).where(F.col("upto") > F.col("budget"))
        first = passed.groupBy("of").agg(F.min(F.struct("bucket", "upto", "words", "docs")).alias("b"))
        state = materialize(
            state.join(first, state.source.eqNullSafe(first.of), "left").select(
                "source", "source_size", "target", "base", "budget",
                F.coalesce("b.bucket", "prefix").alias("prefix"),
                F.coalesce(F.col("b.upto") - F.col("b.words"), F.col("below")).alias("below"),
                F.coalesce("b.words", "inside").alias("inside"),
                F.when(F.col("b").isNull(), F.lit(1)).otherwise(F.col("b.docs")).cast("long").alias("rows"),
                F.when(F.col("b").isNull(), F.col("level")).otherwise(F.lit(level)).alias("level"),
            ),
            "mix-state",
        )
        if state.where("rows > 1").isEmpty():
            break
    # What is left at the boundary is taken when that comes nearer to the budget.
    nearer = F.col("below") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("below")
    step = F.expr(f"shiftleft(1L, {BITS} * ({LEVELS} - level))")
    at = (F.col("prefix") + F.when(nearer, 1).otherwise(0)) * step
    return state.select("source", "source_size", "target", "base", F.when(F.col("level") == 0, F.lit(0)).otherwise(at).cast("long").alias("cut"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    seed: str = "mix",
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """All columns of ``docs`` plus ``size, source_size, target, copies, taken``.

    ``copies`` (0 to ``limit``) is how often the mix takes the document and
    ``taken`` the words that gives. Null text has size 0; a null source is a
    source of its own, last in order; rows with equal or null ids share a hash
    and are taken alike. A source without words has target 0 and takes nothing.
    Input columns with the name of a result column are replaced.
    """
    results = ("size", "source_size", "target", "copies", "taken")
    body = docs.select(
        F.struct(*others(docs, *results)).alias("row"),
        F.col(f"`{source}`").alias("source"),
        count_words(F.col(f"`{text}`")).alias("size"),
        digest60(seed, F.col(f"`{key}`")).alias("hash"),
    )
    slim = materialize(body.select("source", "size", "hash"), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = hash_cuts(slim, source_targets(sizes, weights, share, limit)).withColumnRenamed("source", "of")
    copies: Column = F.col("base") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    return (
        body.join(cuts, body.source.eqNullSafe(cuts.of))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.least(copies, F.lit(limit))).otherwise(0).cast("int"))
        .select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def take(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows the mix consists of: each document as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
