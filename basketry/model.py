"""Schemas, and the mapping of the sample tables to the retail entities."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.ranking import dense_position

# ---- entities, as DDL ------------------------------------------------------

CATEGORIA = "id bigint, nombre string, descripcion string"
PRODUCTO = "id bigint, nombre string, descripcion string, imagen_url string, precio double, stock int, categoria_id bigint"
CLIENTE = "id bigint, nombre string, correo string, telefono string"
USUARIO = "id bigint, nombre string, correo string, contrasena string"
VENTA = "id bigint, cliente_id bigint, fecha timestamp_ntz, total double"
DETALLE = "id bigint, venta_id bigint, producto_id bigint, cantidad int, precio_unitario double"
VENTAS_CACHE = "id bigint, cliente_id bigint, fecha timestamp_ntz, total double, num_productos bigint"
PRODUCTOS_CACHE = "id bigint, nombre string, categoria string, precio double, stock int"
CLIENTE_METRICS = "cliente_id bigint, nombre string, total_compras double, frecuencia bigint, ticket_promedio double, segmento string"
MODEL_METADATA = "model_name string, trained_at timestamp, accuracy double, samples_count bigint, features array<string>"

# ---- sample tables --------------------------------------------------------

SOURCES = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def cents(value: Column) -> Column:
    """An amount as whole cents, halves up."""
    return F.floor(value * 100 + 0.5)


def sum_money(value: Column) -> Column:
    """The exact sum of amounts.

    Cents are added as whole numbers, so the result does not depend on the
    order of the rows, and the sum stays a plain long in the shuffle.
    """
    return F.sum(cents(value)) / F.lit(100.0)


class Retail:
    """The retail entities as lazy DataFrames over one folder of sample tables.

    Every read carries its schema, so no file is opened to infer one, and only
    the columns a query selects reach the scan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCES[name]).parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def categorias(self) -> DataFrame:
        names = self.table("part").where("p_size <> 50").select(F.col("p_type").alias("nombre")).distinct()
        return dense_position(names, "nombre", "id").select(
            "id", "nombre", F.concat(F.lit("Tipo "), F.lower("nombre")).alias("descripcion")
        )

    @cached_property
    def productos(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("nombre"),
            F.col("p_brand").alias("descripcion"),
            F.col("p_retailprice").alias("precio"),
            (F.col("p_size") * 10).alias("stock"),
            F.when(F.col("p_size") != 50, F.col("p_type")).alias("_cat"),
        )
        ids = self.categorias.select(F.col("id").alias("categoria_id"), F.col("nombre").alias("_cat"))
        return part.join(ids, "_cat", "left").select(
            "id", "nombre", "descripcion", "precio", "stock", "categoria_id"
        )

    @cached_property
    def catalogo(self) -> DataFrame:
        """Products already carrying their category name (null when they have none)."""
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("nombre"),
            F.when(F.col("p_size") != 50, F.col("p_type")).alias("categoria"),
            F.col("p_retailprice").alias("precio"),
            (F.col("p_size") * 10).alias("stock"),
        )

    @cached_property
    def clientes(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("nombre"),
            F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")).alias("correo"),
            F.col("c_mktsegment").alias("telefono"),
        )

    @cached_property
    def usuarios(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("nombre"),
            F.concat(F.lit("u"), F.col("s_suppkey"), F.lit("@example.com")).alias("correo"),
            F.sha2(F.col("s_name"), 256).alias("contrasena"),
        )

    @cached_property
    def ventas_base(self) -> DataFrame:
        """Sale headers without a total."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("cliente_id"),
            F.col("o_orderdate").alias("fecha"),
        )

    @cached_property
    def detalles(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("venta_id"),
            F.col("l_partkey").alias("producto_id"),
            F.col("l_linenumber").alias("linea"),
            F.col("l_quantity").cast("int").alias("cantidad"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_unitario"),
        )

    @cached_property
    def ventas(self) -> DataFrame:
        """Sale headers with their total and line count."""
        from basketry.operators.sales import with_totals

        return with_totals(self.ventas_base, self.detalles)

    @cached_property
    def snapshot(self) -> DataFrame:
        """The flat catalogue with the default category filled in."""
        from basketry.functions.scalars import NO_CATEGORY

        return self.catalogo.withColumn("categoria", F.coalesce("categoria", F.lit(NO_CATEGORY)))

    @cached_property
    def as_of(self) -> Column:
        """The latest sale date: one value, so it can be a literal that scans push down."""
        return F.lit(self.table("orders").agg(F.to_date(F.max("o_orderdate"))).first()[0])

    @cached_property
    def metricas(self) -> DataFrame:
        from basketry.operators.customers import customer_metrics

        return customer_metrics(self.ventas)

    @cached_property
    def serie(self) -> DataFrame:
        from basketry.operators.series import daily_quantity, demand_series

        return demand_series(daily_quantity(self.ventas_base, self.detalles))
