"""Matching of classifier labels and free text to the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import scalars as X

# Raw classes kept per image, and the two result messages.
RAW_CLASSES = 5
NOT_FOUND = "No se pudo identificar el producto. No coincide con ningún producto del inventario."
FOUND = "✅ Producto identificado: %s (%.1f%% confianza)"


def keyword_hits(classes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every keyword contained in a class name, ignoring case.

    ``classes`` holds distinct ``class_name`` values. Instead of comparing each
    name with each keyword, a name is cut into its substrings of the lengths
    that keywords have, and these meet the keywords in an equi-join. The work
    grows with the text, not with names times keywords.
    """
    words = keywords.select("producto_id", "kw_pos", F.lower("keyword").alias("keyword"))
    # One row per keyword length.
    lengths = [r[0] for r in words.select(F.length("keyword")).distinct().collect() if r[0]]
    name = F.lower("class_name")

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(name) - (size - 1))
        cut = F.transform(starts, lambda i: F.substring(name, i, F.lit(size)))
        return F.when(F.length(name) >= size, cut).otherwise(F.array().cast("array<string>"))

    grams = classes.select(
        "class_name", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in sorted(lengths)]))).alias("keyword")
    )
    return grams.join(words, "keyword").select("class_name", "keyword", "producto_id", "kw_pos")


def class_matches(classes: DataFrame, keywords: DataFrame) -> DataFrame:
    """The first product, by catalogue then keyword order, whose keyword a class name contains."""
    return (
        keyword_hits(classes, keywords)
        .groupBy("class_name")
        .agg(F.min(F.struct("producto_id", "kw_pos", "keyword")).alias("m"))
        .select("class_name", "m.producto_id", "m.kw_pos", "m.keyword")
    )


def first_matches(predictions: DataFrame, keywords: DataFrame) -> DataFrame:
    """Per image, the match of its best-ranked class that has one."""
    classes = predictions.select("class_name").distinct()
    return (
        predictions.join(class_matches(classes, keywords), "class_name")
        .groupBy("image_id")
        .agg(F.min(F.struct("rank", "producto_id", "kw_pos", "class_name", "probability")).alias("m"))
        .select("image_id", "m.*")
    )


def identify(predictions: DataFrame, keywords: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row per image: the product with its confidence, or the failure message."""
    info = snapshot.select(F.col("id").alias("producto_id"), "nombre", "categoria")
    found = first_matches(predictions, keywords).join(info, "producto_id", "left")
    return (
        predictions.select("image_id")
        .distinct()
        .join(found, "image_id", "left")
        .select(
            "image_id",
            F.col("producto_id").isNotNull().alias("success"),
            "producto_id",
            "nombre",
            "categoria",
            F.col("probability").alias("confianza"),
            F.when(
                F.col("producto_id").isNotNull(),
                F.format_string(FOUND, F.col("nombre"), F.col("probability") * 100),
            )
            .otherwise(F.lit(NOT_FOUND))
            .alias("mensaje"),
        )
    )


def raw_classes(predictions: DataFrame, n: int = RAW_CLASSES) -> DataFrame:
    return predictions.where(F.col("rank") <= n)


def search_by_name(products: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The first product, by id, whose name contains each term, ignoring case and accents.

    All terms are answered by one aggregate pass over the names.
    """
    def first(term: str) -> Column:
        hit = X.contains_plain(F.col("nombre"), F.lit(term))
        return F.struct(F.lit(term).alias("termino"), F.min(F.when(hit, F.struct("id", "nombre"))).alias("p"))

    found = products.agg(F.array(*[first(t) for t in terms]).alias("r")).select(F.inline("r"))
    return found.select("termino", F.col("p.id").alias("id"), F.col("p.nombre").alias("nombre"))
