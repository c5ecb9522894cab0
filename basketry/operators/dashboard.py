"""Dashboard aggregates.

Lines are summed per product before they meet the catalogue, so the join sees
one row per product and a best-selling product never becomes a hot join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.model import sum_money
from basketry.operators.sales import with_totals


def _per_product(detalles: DataFrame) -> DataFrame:
    return detalles.groupBy("producto_id").agg(
        F.coalesce(sum_money(F.col("cantidad") * F.col("precio_unitario")), F.lit(0.0)).alias("ingresos"),
        F.sum(F.coalesce("cantidad", F.lit(0))).alias("unidades"),
    )


def revenue_by_category(detalles: DataFrame, catalogo: DataFrame) -> DataFrame:
    names = catalogo.select(F.col("id").alias("producto_id"), "categoria")
    return (
        _per_product(detalles)
        .join(names, "producto_id", "left")
        .groupBy(X.or_default(F.col("categoria"), X.NO_CATEGORY).alias("categoria"))
        .agg(sum_money(F.col("ingresos")).alias("ingresos"))
    )


def units_by_name(detalles: DataFrame, catalogo: DataFrame) -> DataFrame:
    """Units per product name: equal names merge, a product unknown to the catalogue keeps its id."""
    names = catalogo.select(F.col("id").alias("producto_id"), "nombre")
    return (
        _per_product(detalles)
        .join(names, "producto_id", "left")
        .groupBy(F.coalesce(X.filled(F.col("nombre")), F.col("producto_id").cast("string")).alias("nombre"))
        .agg(F.sum("unidades").alias("unidades"))
    )


def top_products(detalles: DataFrame, catalogo: DataFrame, limit: int = 10) -> DataFrame:
    return units_by_name(detalles, catalogo).orderBy(F.desc("unidades"), "nombre").limit(limit)


def revenue_by_day(ventas: DataFrame, as_of: Column) -> DataFrame:
    """Revenue per day; a sale without a date counts for ``as_of``."""
    return ventas.groupBy(F.coalesce(F.to_date("fecha"), as_of).alias("dia")).agg(
        sum_money(F.col("total")).alias("total")
    )


def last_days(ventas: DataFrame, detalles: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The last ``days`` days with gaps filled by 0.

    ``ventas`` are sale headers: the date filter comes first, and only the
    lines of recent sales are summed.
    """
    calendar = ventas.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(as_of, days - 1), as_of)).alias("dia")
    )
    kind = ventas.schema["fecha"].dataType
    begin, end = (d.cast(kind) for d in (F.date_sub(as_of, days - 1), F.date_add(as_of, 1)))
    # Plain bounds reach the scan.
    recent = ventas.where(F.col("fecha").isNull() | ((F.col("fecha") >= begin) & (F.col("fecha") < end)))
    return calendar.join(revenue_by_day(with_totals(recent, detalles, few=True), as_of), "dia", "left").select(
        F.date_format("dia", "yyyy-MM-dd").alias("dia"), F.coalesce("total", F.lit(0.0)).alias("total")
    )


def customer_scatter(ventas: DataFrame) -> DataFrame:
    return (
        ventas.where(F.col("cliente_id").isNotNull())
        .groupBy("cliente_id")
        .agg(sum_money(F.col("total")).alias("total"), F.count(F.lit(1)).alias("compras"))
    )


def kpi_row(productos: DataFrame, clientes: DataFrame, ventas: DataFrame) -> DataFrame:
    """One row of headline counts; an absent category counts as one more value."""
    # A distinct category first keeps the count free of a per-row distinct aggregate.
    groups = productos.groupBy("categoria").agg(F.count(F.lit(1)).alias("n"))
    cats = groups.agg(F.count(F.lit(1)).alias("total_categorias"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_productos"))
    people = clientes.agg(F.count(F.lit(1)).alias("total_clientes"))
    orders = ventas.agg(F.count(F.lit(1)).alias("pedidos"))
    one = F.lit(1).alias("_k")
    return (
        cats.select("*", one).join(people.select("*", one), "_k").join(orders.select("*", one), "_k").drop("_k")
    )


def today(ventas: DataFrame, detalles: DataFrame, as_of: Column) -> DataFrame:
    """Sale count and revenue of one day, from sale headers and lines."""
    sales = ventas.where(F.to_date("fecha") == as_of)
    return with_totals(sales, detalles, few=True).agg(
        F.count(F.lit(1)).alias("ventas_hoy"),
        F.coalesce(sum_money(F.col("total")), F.lit(0.0)).alias("ingresos_hoy"),
    )


def service_status(counts: DataFrame) -> DataFrame:
    """Cache sizes in one row, and whether there is data to train on."""
    def size(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("tabla") == name, F.col("filas"))), F.lit(0)).cast("bigint")

    return counts.agg(*[size(n).alias(n) for n in ("productos", "ventas", "clientes")]).withColumn(
        "models_trained", (F.col("productos") > 0) & (F.col("ventas") > 0)
    )
