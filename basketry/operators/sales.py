"""Sale facts: subtotals, totals, nested documents, flat snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import scalars as X
from basketry.functions.ranking import range_chunks, running_sums
from basketry.model import cents, sum_money
from basketry.session import materialize

# Lines per document part, and the order in which a sale's lines fill its parts.
DOCUMENT_LINES = 5_000
LINE_ORDER = ["linea", "producto_id", "cantidad", "precio_unitario"]


def with_subtotal(detalles: DataFrame) -> DataFrame:
    """Line subtotal rounded to cents; 0 when quantity or price is null."""
    return detalles.withColumn("subtotal", F.coalesce(cents(_product()), F.lit(0)) / F.lit(100.0))


def _product() -> Column:
    return F.col("cantidad") * F.col("precio_unitario")


def sale_facts(detalles: DataFrame) -> DataFrame:
    """Total and line count per sale that has lines."""
    return (
        detalles.groupBy(F.col("venta_id").alias("id"))
        .agg(
            F.coalesce(sum_money(_product()), F.lit(0.0)).alias("total"),
            F.count(F.lit(1)).alias("num_productos"),
        )
    )


def with_totals(ventas: DataFrame, detalles: DataFrame, few: bool = False) -> DataFrame:
    """Sales with total and line count; a sale without lines gets zeros.

    With ``few``, ``ventas`` is a small part of all sales: the lines of the
    others are dropped by a semi-join before they are summed and shuffled.
    """
    if few:
        detalles = detalles.join(ventas.select(F.col("id").alias("venta_id")), "venta_id", "left_semi")
    return ventas.join(sale_facts(detalles), "id", "left").select(
        *ventas.columns,
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce("num_productos", F.lit(0).cast("bigint")).alias("num_productos"),
    )


def product_snapshot(productos: DataFrame, categorias: DataFrame) -> DataFrame:
    """Flat products with the category name."""
    names = categorias.select(F.col("id").alias("categoria_id"), F.col("nombre").alias("categoria"))
    return productos.join(names, "categoria_id", "left").select(
        "id", "nombre", X.or_default(F.col("categoria"), X.NO_CATEGORY).alias("categoria"), "precio", "stock"
    )


def sale_snapshot(ventas: DataFrame) -> DataFrame:
    """Flat sales; a missing customer becomes 0."""
    return ventas.select(
        "id",
        X.or_default(F.col("cliente_id"), 0).cast("bigint").alias("cliente_id"),
        "fecha",
        "total",
        "num_productos",
    )


def sale_documents(
    ventas: DataFrame,
    detalles: DataFrame,
    clientes: DataFrame,
    productos: DataFrame,
    lines_per_part: int = DOCUMENT_LINES,
) -> DataFrame:
    """Nested sale documents: customer, and lines with their product and category.

    A sale is ``partes`` documents, numbered by ``parte`` from 0; all have its header. The
    lines of a sale, in the order of line, product, quantity and price, fill one part
    after the other, ``lines_per_part`` each; a sale without lines is one part.
    So no array and no task ever holds an unbounded sale. A line of an unknown
    product stays, with the id of the product only.
    """
    lines = with_subtotal(detalles)
    large = (
        detalles.groupBy("venta_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > lines_per_part)
        .select("venta_id", F.ceil(F.col("_n") / lines_per_part).cast("int").alias("partes"))
    )
    large = materialize(large, "large-sales")
    # Positions are needed in large sales only; two levels of numbering split these.
    cut = range_chunks(lines.join(large.select("venta_id"), "venta_id", "left_semi"), ["venta_id", *LINE_ORDER], "large-lines")
    placed = running_sums(cut, ["venta_id"], "chunk", LINE_ORDER, {"_place": F.lit(1).cast("bigint")})
    placed = placed.withColumn("parte", F.floor(F.col("_place") / lines_per_part).cast("int")).select(*lines.columns, "parte")
    rest = lines.join(large.select("venta_id"), "venta_id", "left_anti").withColumn("parte", F.lit(0))
    lines = rest.select(*placed.columns).unionByName(placed)
    catalog = productos.select(
        F.col("id").alias("producto_id"), F.col("nombre").alias("producto"), F.col("categoria")
    )
    nested = (
        lines.join(catalog, "producto_id", "left")
        .groupBy("venta_id", "parte")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "linea",
                        "cantidad",
                        "precio_unitario",
                        "subtotal",
                        F.struct(F.col("producto_id").alias("id"), F.col("producto").alias("nombre"), "categoria").alias(
                            "producto"
                        ),
                    )
                )
            ).alias("detalles")
        )
    )
    people = clientes.select(F.col("id").alias("cliente_id"), F.struct("id", "nombre").alias("cliente"))
    # A large sale's header is repeated per part, so the join key is the grouping
    # key and the nested lines are not shuffled again.
    heads = (
        ventas.join(people, "cliente_id", "left")
        .join(large.withColumnRenamed("venta_id", "id"), "id", "left")
        .withColumn("partes", F.coalesce("partes", F.lit(1)))
        .withColumn("parte", F.explode(F.sequence(F.lit(0), F.col("partes") - 1)))
    )
    nested = nested.withColumnRenamed("venta_id", "id")
    return (
        heads.join(nested, ["id", "parte"], "left")
        .select(
            "id",
            "parte",
            "partes",
            "fecha",
            "cliente",
            F.coalesce("detalles", F.array().cast(nested.schema["detalles"].dataType)).alias("detalles"),
        )
    )


def explode_documents(documents: DataFrame) -> DataFrame:
    """Documents back to one row per line, reached by nested paths."""
    return documents.select("id", "cliente.nombre", F.explode_outer("detalles").alias("d")).select(
        F.col("id").alias("venta_id"),
        F.col("nombre").alias("cliente"),
        F.col("d.linea").alias("linea"),
        F.col("d.producto.id").alias("producto_id"),
        F.col("d.producto.nombre").alias("producto"),
        F.col("d.producto.categoria").alias("categoria"),
        F.col("d.cantidad").alias("cantidad"),
        F.col("d.subtotal").alias("subtotal"),
    )


def stock_against_sales(productos: DataFrame, detalles: DataFrame) -> DataFrame:
    """Stock beside units sold, for every product."""
    sold = detalles.groupBy(F.col("producto_id").alias("id")).agg(F.sum("cantidad").alias("vendidas"))
    return productos.join(sold, "id", "left").select(
        "id", "nombre", "stock", F.coalesce("vendidas", F.lit(0).cast("bigint")).alias("vendidas")
    )


def customer_history(ventas: DataFrame, clientes: DataFrame) -> DataFrame:
    """Sales with their customer, ordered by customer and date.

    A range sort on all three keys splits the sales of a large customer over
    many tasks.
    """
    people = clientes.select(F.col("id").alias("cliente_id"), F.col("nombre").alias("cliente"))
    return (
        ventas.join(people, "cliente_id")
        .select(
            "cliente_id",
            "cliente",
            F.col("id").alias("venta_id"),
            "fecha",
            "total",
            "num_productos",
        )
        .orderBy("cliente_id", "fecha", "venta_id")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        for name, df in tables.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def catalogue_report(snapshot: DataFrame) -> DataFrame:
    """Per category: products, and the share of the whole list."""
    per = snapshot.groupBy("categoria").agg(F.count(F.lit(1)).alias("productos"))
    # The outer window sees one row per category.
    every = Window.partitionBy(F.lit(0))
    return per.select(
        "categoria",
        "productos",
        F.sum("productos").over(every).alias("total"),
        F.count(F.lit(1)).over(every).alias("num_categorias"),
    )


def reference_options(df: DataFrame, label: str) -> DataFrame:
    """Value and label pairs with the fallback chain of labels."""
    chain = [c for c in (label, "nombre", "correo", "email") if c in df.columns]
    return df.select(
        F.col("id").alias("value"),
        F.coalesce(*[X.filled(F.col(c)) for c in chain], X.generated_name(X.ITEM_PREFIX, F.col("id"))).alias("label"),
    )
