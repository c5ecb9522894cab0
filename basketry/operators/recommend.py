"""Product vectors and similar-product recommendations."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import scalars as X
from basketry.functions.factors import symmetric_factors
from basketry.operators.basket import mirrored
from basketry.operators.model_store import ModelStore
from basketry.operators.similar import top_similar
from basketry.session import materialize

# Model name, vector length, rounds of training, list length, fallback scores and reasons.
NAME = "product_vectors"
EMBEDDING_DIM = 32
ITERATIONS = 30
TOP_N = 4
FALLBACK_SCORE = 0.75
PICKED_SCORE = 0.85
REASON_VECTORS = "Recomendado por Deep Learning (embeddings)"
REASON_FALLBACK = "Misma categoría (fallback)"
REASON_PICKED = "Misma categoría"
_INT_MAX = 2**31 - 1
_MAX_BLOCKS = 512


def product_vectors(pairs: DataFrame, sold: DataFrame, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """A vector of 32 non-negative numbers per sold product.

    ``pairs`` are unordered co-purchase pairs (``a``, ``b``); the binary matrix
    stays sparse and is factorised by distributed ALS (``functions/factors.py``). A sold product without
    a partner has an empty row in that matrix and gets a zero vector. With
    fewer than two sold products nothing can be similar, and there are no vectors.
    """
    both = mirrored(pairs)
    if pairs.limit(1).count() == 0:
        factors = None
    else:
        high = both.agg(F.max("p1")).first()[0]
        if high > _INT_MAX:
            raise ValueError("product ids above the int range: renumber them with number_rows first")
        # The starting factors depend on the number of blocks: one per core, up to a bound.
        blocks = min(pairs.sparkSession.sparkContext.defaultParallelism, _MAX_BLOCKS)
        als = ALS(
            rank=EMBEDDING_DIM,
            numUserBlocks=blocks,
            numItemBlocks=blocks,
            implicitPrefs=True,
            nonnegative=True,
            maxIter=iterations,
            checkpointInterval=1,
            seed=seed,
            userCol="p1",
            itemCol="p2",
            ratingCol="r",
        )
        factors = symmetric_factors(both.select(F.col("p1").cast("int"), F.col("p2").cast("int")), als)
        factors = factors.select(F.col("id").cast("bigint").alias("id"), F.col("features").alias("embedding"))
    zero = F.array(*[F.lit(0.0).cast("float")] * EMBEDDING_DIM)
    ids = sold.select(F.col("producto_id").alias("id")).distinct()
    if factors is None:
        two = ids.limit(2).count() == 2
        return ids.where(F.lit(two)).withColumn("embedding", zero)
    return ids.join(factors, "id", "left").select("id", F.coalesce("embedding", zero).alias("embedding"))


def _described(hits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Name and category of the recommended product, with defaults for an unknown one."""
    info = snapshot.select(F.col("id").alias("other"), "nombre", "categoria")
    return hits.join(info, "other", "left").select(
        "id",
        "puesto",
        F.col("other").alias("relacionado_id"),
        F.coalesce(X.filled(F.col("nombre")), X.generated_name(X.PRODUCT_PREFIX, F.col("other"))).alias("nombre"),
        F.coalesce(X.filled(F.col("categoria")), F.lit(X.UNKNOWN_CATEGORY)).alias("categoria"),
        "score",
    )


def similar_products(vectors: DataFrame, snapshot: DataFrame, n: int = TOP_N, asked: DataFrame | None = None) -> DataFrame:
    return _described(top_similar(vectors, n, asked=asked), snapshot).withColumn("razon", F.lit(REASON_VECTORS))


def same_category(snapshot: DataFrame, n: int = TOP_N) -> DataFrame:
    """The first N other products, by id, of each product's category.

    Only the first N + 1 ids of a category can appear in any such list. They
    are found by a pre-aggregating top-k, and the category is joined to that
    short list, so no pairs within a category are made.
    """
    # Salted: a category that holds most of the catalogue is ranked in parts first.
    salted = Window.partitionBy("categoria", "_salt").orderBy("id")
    first = (
        snapshot.select("categoria", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_salt"))
        .withColumn("_r", F.row_number().over(salted))
        .where(F.col("_r") <= n + 1)
        .groupBy("categoria")
        .agg(F.slice(F.sort_array(F.collect_list("id")), 1, n + 1).alias("_first"))
    )
    rest = F.slice(F.filter("_first", lambda x: x != F.col("id")), 1, n)
    return (
        snapshot.select("id", "categoria")
        .join(first, "categoria")
        .select("id", F.posexplode(rest).alias("_pos", "other"))
        .select("id", "other", (F.col("_pos") + 1).alias("puesto"))
    )


def category_recommendations(
    snapshot: DataFrame, n: int = TOP_N, score: float = PICKED_SCORE, reason: str = REASON_PICKED
) -> DataFrame:
    hits = same_category(snapshot, n).withColumn("score", F.lit(score))
    return _described(hits, snapshot).withColumn("razon", F.lit(reason))


def recommendations(vectors: DataFrame, snapshot: DataFrame, n: int = TOP_N, asked: DataFrame | None = None) -> DataFrame:
    """Similar products by vector; products without one get the category fallback.

    With ``asked``, only the products whose ``id`` is in it get a list; it is still drawn from all products.
    """
    without = snapshot.join(vectors.select("id"), "id", "left_anti").select("id")
    if asked is not None:
        without = without.join(asked, "id", "left_semi")
    fallback = category_recommendations(snapshot, n, FALLBACK_SCORE, REASON_FALLBACK).join(without, "id", "left_semi")
    return similar_products(vectors, snapshot, n, asked).unionByName(fallback)


def peers(picked: DataFrame, snapshot: DataFrame) -> DataFrame:
    """All other products of the category of each picked product."""
    mine = picked.select(F.col("id").alias("elegido"), "categoria")
    return mine.join(snapshot, "categoria").where(F.col("id") != F.col("elegido")).select(
        "elegido", "categoria", "id", "nombre"
    )


def train_vectors(pairs: DataFrame, detalles: DataFrame, **options) -> DataFrame:
    """Vectors written to the shared folder, ready for several consumers."""
    return materialize(product_vectors(pairs, detalles, **options), "vectors")


def stored_vectors(store: ModelStore, pairs: DataFrame, detalles: DataFrame, now: datetime, **options) -> DataFrame:
    """The stored vectors while they are fresh, otherwise newly trained and stored ones."""
    stored = store.train_or_load(NAME, now, lambda: ({"vectors": product_vectors(pairs, detalles, **options)}, {}))
    return stored.table("vectors")
