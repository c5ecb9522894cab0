"""Near duplicates by MinHash with banding, verified on full sets.

Documents with equal shingle sets form a class, named by a digest of the set;
links join classes. Each class has ``bands * rows`` minima of universal hashes. A
bucket is a band with equal minima. In every bucket each class is paired with
the bucket's smallest one and with a member drawn by hash. Classes of buckets that
are then still in several components meet once more: not all with all, but
those that share one of their rarest shingles, as every two similar sets do
(``_sharing_rare``). Pairs pass a signature test, then the exact test on
full sets. Components come from alternating large-star and small-star rounds on
tables in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.common import SPACE_CHARS, others
from basketry.session import materialize

BANDS, ROWS = 32, 5
SLACK = 0.20  # a signature below the bound by more than this (six deviations) is not tested exactly
BATCH = 512  # texts or pairs of sets that a worker holds at once
NIBBLES = 16  # minima that one long of a stored signature holds, four bits each


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    mixed = np.full(n, len(words) if n == 1 and len(words) < 4 else 0, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    return rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def signature(of: np.ndarray) -> np.ndarray:
    """The minima of all hash functions, 32 bits each."""
    a, b = _functions()
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(of), 2048):
        least = np.minimum(least, (of[at : at + 2048, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) is connected with.

    Large-star: each node links its larger neighbours to its smallest one.
    Small-star: it links itself and its smaller neighbours to the smallest. Both
    use a minimum with map-side sums and a join, so a hub is never gathered.
    No round has more links than the one before it.
    """
    rows = edges.count()
    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links", rows)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, "links", rows)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        new = materialize(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct(),
            "links",
            rows,
        )
        same = new.count() == links.count() and new.join(links, ["a", "b"], "left_anti").isEmpty()
        links = new
        if same:
            return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _name(of: np.ndarray) -> str:
    return hashlib.blake2b(of.tobytes(), digest_size=16).hexdigest()


def _packed(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, as longs."""
    low = (sig & np.uint32(15)).astype(np.uint64).reshape(-1, NIBBLES)
    return (low << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _differing(a: str, b: str) -> Column:
    """Number of minima of two stored signatures that differ in their four bits."""
    total = F.lit(0)
    for k in range(BANDS * ROWS // NIBBLES):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of few rows for what is written meanwhile: texts and full sets can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_components(docs: DataFrame, width: int = 4, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component, component_id), one row per row of ``docs``.

    ``component`` names the component, ``component_id`` is its smallest id.

    Documents without words have an empty set and are linked with nothing; so are
    rows with a null id, whose component is null. Links join texts, not ids: rows
    with one id and different texts may be in different components. Repeated rows are copies.
    """
    with small_batches(docs.sparkSession):
        return _near_components(docs, width, percent, key, text)


def _near_components(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    id_, body = F.col(f"`{key}`"), F.col(f"`{text}`")

    @F.pandas_udf("n long, set_key string, signature array<bigint>, bands array<bigint>")
    def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                s = shingles(t, width)
                sig = signature(s) if len(s) else None
                bands = [] if sig is None else [xxhash.xxh3_64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(sig.reshape(BANDS, ROWS))]
                rows.append((len(s), _name(s), [] if sig is None else _packed(sig), bands))
            yield pd.DataFrame(rows, columns=["n", "set_key", "signature", "bands"])

    drawn = docs.select(id_.alias("id"), F.xxhash64(body).alias("text_hash"), sketch(body).alias("s"))
    table = materialize(drawn.select("id", "text_hash", "s.*"), "sketches")
    real = table.where("n > 0 and id is not null")
    classes = real.groupBy("set_key").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    classes = materialize(classes, "classes")
    members = classes.select("set_key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(
        F.min("set_key").alias("low"), F.count("*").alias("m"), F.max_by("set_key", F.xxhash64("set_key", "bucket")).alias("drawn")
    ).where("m > 1")
    members = materialize(members.join(shared, "bucket").select("bucket", "set_key", "low", "drawn"), "buckets")
    pairs = (
        members.select(F.col("set_key").alias("x"), F.explode(F.array("low", "drawn")).alias("y"))
        .where("x != y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    read = _reader(docs, classes, width, key, text)
    likely = _likely(pairs, classes, percent)
    links = materialize(_verified(likely, materialize(read(likely), "full-sets"), percent), "near-links")
    joined = components(links)
    label = members.join(joined, members.set_key == joined.node, "left").select("bucket", "set_key", F.coalesce("root", "set_key").alias("root"))
    label = materialize(label, "bucket-roots")
    split = label.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
    open_ = materialize(label.join(split, "bucket").select("set_key", "root").distinct(), "open-classes")
    sets = materialize(read(open_.select(F.col("set_key").alias("a"), F.col("set_key").alias("b"))), "open-sets")
    told = sets.join(open_, "set_key").join(classes.select("set_key", "signature"), "set_key")
    rest = materialize(_sharing_rare(told, percent), "likely-pairs")
    more = materialize(_verified(rest, sets, percent), "near-links")
    roots = joined if more.isEmpty() else components(links.union(more))
    named = classes.join(roots, classes.set_key == roots.node, "left").select("set_key", "rep", F.coalesce("root", "set_key").alias("root"))
    named = materialize(named, "class-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root").select("set_key", "root", "least")
    return table.join(named, "set_key", "left").select(
        "id", "text_hash", F.col("n").alias("n_shingles"), F.col("root").alias("component"),
        F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))).alias("component_id"),
    )


def _most(percent: int) -> int:
    """Number of differing minima above which a link is out of the question."""
    return int((1 - percent / 100 + SLACK) * BANDS * ROWS)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and signatures allow a link."""
    left = classes.select(F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = classes.select(F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return materialize(near.where(_differing("sa", "sb") <= _most(percent)).select("a", "b"), "likely-pairs")


def _reader(docs: DataFrame, classes: DataFrame, width: int, key: str, text: str):
    """A function that reads the full sets (set_key, shingles) of the classes in pairs (a, b)."""

    @F.pandas_udf("set_key string, shingles array<bigint>")
    def full(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, width) for t in texts]
        return pd.DataFrame({"set_key": [_name(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    # Else a test for null keys would be moved before the join, and with it all texts would be read.
    full = full.asNondeterministic()

    def read(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        ids = classes.join(needed, "set_key", "left_semi").select(F.col("rep").alias("id")).distinct()
        near = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).join(ids, "id", "left_semi")
        # Other texts may have the same id: the name of the set tells which are meant.
        sets = near.select(full("body").alias("s")).select("s.*").join(needed, "set_key", "left_semi")
        return sets.groupBy("set_key").agg(F.first("shingles").alias("shingles"))

    return read


def _sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the given classes (set_key, shingles, root, signature) that may link and have different roots.

    In one order of all shingles, the rarest first, two sets with a similarity of
    ``percent`` share one of the first n - ceil(n * percent / 100) + 1 of each. Shingles
    of one set only come first of all and are shared by none, so they only count. At
    the first that two sets share, what is left of either must hold their whole
    overlap. Sizes, places and signatures are tested in the join, so it gives likely pairs only.
    """
    each = sets.select("set_key", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    placed = each.join(common, "shingle").groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    n = F.size("shingles")
    first = n - F.ceil(n * percent / 100) + 1 - (n - F.size("common"))
    rare = (
        sets.join(placed, "set_key")
        .withColumn("first", first.cast("int"))
        .where("first > 0")
        .select(
            "set_key", "root", "signature", n.alias("n"), F.size("common").alias("left"),
            F.posexplode(F.slice("common", F.lit(1), F.col("first"))["shingle"]).alias("at", "shingle"),
        )
        .withColumn("left", F.col("left") - F.col("at"))
    )
    rare = materialize(rare, "rare-shingles")
    x, y = rare.alias("x"), rare.alias("y")
    close = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
    alike = _differing("x.signature", "y.signature") <= _most(percent)
    other = (F.col("x.set_key") < F.col("y.set_key")) & (F.col("x.root") != F.col("y.root"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & other & close & enough & alike)
    return met.select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the test on full sets (set_key, shingles)."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    pa = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("pa"))
    pb = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("pb"))
    return pairs.join(pa, "a").join(pb, "b").where(linked("pa", "pb")).select("a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, one row of each component: the smallest id, of its texts the one with the smallest hash.

    Rows with null id and texts without words stay, each of them.
    """
    found = near_components(docs, key=key, text=text, **options).where("n_shingles > 0 and id is not null")
    rows = found.groupBy("component", "id", "text_hash").agg(F.count("*").alias("_rows"))
    first = rows.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("f"))
    chosen = rows.join(first, "component").where(F.struct("id", "text_hash") == F.col("f")).select("id", "text_hash", "_rows")
    chosen = materialize(chosen, "chosen-rows")

    id_, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    empty = id_.isNull() | (F.coalesce(F.length(F.btrim(body, F.lit(SPACE_CHARS))), F.lit(0)) == 0)
    picked = lambda of: docs.where(~empty).join(of, (id_ == of.id) & (F.xxhash64(body) == of.text_hash), "left_semi")
    # Only rows that are there more than once need counting, so few texts are shuffled for it.
    again = Window.partitionBy(key, F.xxhash64(body)).orderBy(F.xxhash64(*others(docs)))
    copies = picked(chosen.where("_rows > 1")).withColumn("_copy", F.row_number().over(again)).where("_copy = 1").select(*others(docs))
    return docs.where(empty).unionByName(picked(chosen.where("_rows = 1"))).unionByName(copies)
