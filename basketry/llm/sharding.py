"""Two-pass external shuffle into shards.

Pass one scatters rows by seeded hashes: by id over the shards, then by all
columns over the memory-sized buckets of a shard. Pass two orders each bucket by
its own seeded hash and runs Spark's Fisher-Yates ``shuffle`` over it. Slots
number the buckets of a shard one after the other.

Law ``key``: a row's shard is the one whose seeded hash with the id is the
highest (rendezvous hashing). It depends on the id and the number of shards
only, and a further shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import others


def highest_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash for ``key``; equal hashes go to the higher number."""
    ballots = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("vote"), s.alias("shard")),
    )
    return F.array_max(ballots)["shard"]


def part_of(columns: list[Column], parts: int, seed: int) -> Column:
    """The bucket inside a shard, by all columns, so that the rows of one id spread."""
    return F.pmod(F.xxhash64(F.lit(seed + 1), *columns), F.lit(parts))


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = 16 << 20,
    seed: int = 20,
) -> DataFrame:
    """All columns of ``docs`` plus ``size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text (null: none) plus 16.
    ``bucket_bytes`` is the mean size of a bucket, the unit of memory of a task.
    Rows with one id, or with a null id, share one shard, as the law demands, and
    spread over its buckets by the hash of all their columns. Repeated rows stay,
    each with its own slot; rows equal in every column share a bucket. An input column with the name of a result column is replaced by it.
    An empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    total = docs.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    results = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    id_ = F.col(f"`{key}`")
    rows = docs.select(
        highest_shard(id_, shards, seed).alias("shard"),
        part_of(others(docs, *results), per_shard, seed).alias("part"),
        F.xxhash64(F.lit(seed + 2), id_, F.col(f"`{text}`")).alias("order"),
        F.struct(*others(docs, *results)).alias("row"),
        size.alias("size"),
    )
    rows = rows.withColumn("bucket", (F.col("shard") * F.lit(per_shard) + F.col("part")).cast("int"))

    # Slots start where the earlier buckets of the shard end.
    filled = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    # A bucket is a partition of its own, and its number is the partition's: Spark seeds its
    # shuffle by partition, so a bucket's order depends on its rows and the seed alone.
    gathered = (
        rows.repartitionById(int(shards * per_shard), F.col("bucket"))
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("order", "shard", "size", "row"))).alias("rows"))
        .withColumn("rows", F.shuffle("rows", F.lit(seed)))
        .select("bucket", F.posexplode("rows").alias("pos", "r"))
    )
    id_ = F.col(f"r.row.`{key}`")
    body = F.col(f"r.row.`{text}`")
    votes = F.xxhash64(F.lit(seed), id_, F.lit(shards)) >= F.xxhash64(F.lit(seed), id_, F.col("r.shard"))
    return gathered.join(starts, "bucket").select(
        "r.row.*",
        F.col("r.size").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("r.shard").cast("int").alias("shard"),
        (F.col("start") + F.col("pos")).cast("long").alias("slot"),
        F.when(votes, F.lit(shards)).otherwise(F.col("r.shard")).cast("int").alias("grown_shard"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the shards as one folder each; rows of a file follow their slots."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
