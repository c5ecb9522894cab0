"""Names of queries, their Spark form and their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.model import Retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The mapping of model.Retail as common table expressions.
VIEWS = """
WITH categoria AS (
  SELECT row_number() OVER (ORDER BY nombre) AS id, nombre, 'Tipo ' || lower(nombre) AS descripcion
  FROM (SELECT DISTINCT p_type AS nombre FROM part WHERE p_size <> 50) t
), producto AS (
  SELECT p_partkey AS id, p_name AS nombre, p_brand AS descripcion, p_retailprice AS precio, p_size * 10 AS stock,
         c.id AS categoria_id, CASE WHEN p_size <> 50 THEN p_type END AS categoria
  FROM part LEFT JOIN categoria c ON c.nombre = CASE WHEN p_size <> 50 THEN p_type END
), cliente AS (
  SELECT c_custkey AS id, c_name AS nombre, 'c' || c_custkey || '@example.com' AS correo, c_mktsegment AS telefono
  FROM customer
), usuario AS (
  SELECT s_suppkey AS id, s_name AS nombre, 'u' || s_suppkey || '@example.com' AS correo, sha256(s_name) AS contrasena
  FROM supplier
), detalle AS (
  SELECT l_orderkey AS venta_id, l_partkey AS producto_id, l_linenumber AS linea,
         CAST(l_quantity AS INTEGER) AS cantidad, l_extendedprice / l_quantity AS precio_unitario
  FROM lineitem
), sublinea AS (
  SELECT *, coalesce(CAST(round(cantidad * precio_unitario, 2) AS DECIMAL(18, 2)), 0) AS subtotal FROM detalle
), sumas AS (
  SELECT venta_id, sum(subtotal) AS total, count(*) AS num_productos FROM sublinea GROUP BY venta_id
), venta AS (
  SELECT o_orderkey AS id, o_custkey AS cliente_id, o_orderdate AS fecha,
         coalesce(total, 0) AS total, coalesce(num_productos, 0) AS num_productos
  FROM orders LEFT JOIN sumas ON venta_id = o_orderkey
), snapshot AS (
  SELECT id, nombre, coalesce(categoria, 'Sin categoría') AS categoria, precio, stock FROM producto
), metrica AS (
  SELECT cliente_id, 'Cliente ' || cliente_id AS nombre, CAST(sum(total) AS DOUBLE) AS total_compras,
         count(*) AS frecuencia, CAST(sum(total) AS DOUBLE) / count(*) AS ticket_promedio
  FROM venta WHERE cliente_id IS NOT NULL GROUP BY cliente_id
), diario AS (
  SELECT producto_id, CAST(fecha AS DATE) AS dia, CAST(sum(cantidad) AS BIGINT) AS cantidad
  FROM detalle JOIN venta ON venta.id = venta_id GROUP BY ALL
), serie AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY producto_id ORDER BY dia) AS INTEGER) AS seq FROM diario
), hoy AS (
  SELECT CAST(max(o_orderdate) AS DATE) AS dia FROM orders
)
"""


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a query given as a function of the retail entities.

    ``sql`` follows the view definitions; extra expressions start with a comma.
    """

    def wrap(build: Callable[[Retail], DataFrame]):
        QUERIES[name] = lambda spark, path: build(Retail(spark, path))
        if sql:
            ORACLES[name] = (VIEWS if views else "") + sql
        return build

    return wrap
