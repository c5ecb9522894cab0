"""Aggregates, series, top lists and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.model import Retail
from basketry.operators import anomaly, basket, customers, dashboard, sales, segments, series
from basketry.plans.registry import query
from basketry.session import materialize

# Thresholds for the price level of the sample tables.
RULE = {"VIP": (12, 150_000.0), "Regular": (8, 120_000.0)}
_SEGMENT = """
CASE WHEN frecuencia >= 12 AND ticket_promedio >= 150000 THEN 'VIP'
     WHEN frecuencia >= 8 AND ticket_promedio >= 120000 THEN 'Regular' ELSE 'Ocasional' END"""
_SEGMENTED = f", seg AS (SELECT *, {_SEGMENT} AS segmento FROM metrica)"


def _segmented(r: Retail) -> DataFrame:
    return customers.with_rule_segment(r.metricas, RULE)


@query("a1_line_subtotal", "SELECT venta_id, linea, producto_id, CAST(subtotal AS DOUBLE) AS subtotal FROM sublinea")
def _(r: Retail) -> DataFrame:
    return sales.with_subtotal(r.detalles).select("venta_id", "linea", "producto_id", "subtotal")


@query("a2_sale_total", "SELECT venta_id AS id, CAST(total AS DOUBLE) AS total FROM sumas")
def _(r: Retail) -> DataFrame:
    return sales.sale_facts(r.detalles).select("id", "total")


@query(
    "a3_customer_metrics",
    """
    SELECT cliente_id, nombre, total_compras, frecuencia, ticket_promedio FROM metrica
    """,
)
def _(r: Retail) -> DataFrame:
    return r.metricas


@query("a4_line_count", "SELECT id, num_productos FROM venta")
def _(r: Retail) -> DataFrame:
    return r.ventas.select("id", "num_productos")


@query(
    "a5_revenue_by_category",
    """
    SELECT coalesce(categoria, 'Sin categoría') AS categoria, CAST(sum(subtotal) AS DOUBLE) AS ingresos
    FROM sublinea LEFT JOIN producto p ON p.id = producto_id GROUP BY 1
    """,
)
def revenue_by_category(r: Retail) -> DataFrame:
    return dashboard.revenue_by_category(r.detalles, r.catalogo)


_UNITS = "SELECT nombre, CAST(sum(cantidad) AS BIGINT) AS unidades FROM detalle JOIN producto p ON p.id = producto_id GROUP BY nombre"


@query("a6_units_by_name", _UNITS)
def _(r: Retail) -> DataFrame:
    return dashboard.units_by_name(r.detalles, r.catalogo)


@query("k1_top_products", _UNITS + " ORDER BY unidades DESC, nombre LIMIT 10")
def _(r: Retail) -> DataFrame:
    return dashboard.top_products(r.detalles, r.catalogo)


@query(
    "a7_revenue_by_day",
    "SELECT coalesce(CAST(fecha AS DATE), (SELECT dia FROM hoy)) AS dia, CAST(sum(total) AS DOUBLE) AS total FROM venta GROUP BY 1",
)
def _(r: Retail) -> DataFrame:
    return dashboard.revenue_by_day(r.ventas, r.as_of)


@query(
    "a8_last_30_days",
    """
    , dias AS (SELECT hoy.dia - CAST(i AS INTEGER) AS dia FROM hoy, range(30) t(i))
    SELECT strftime(dias.dia, '%Y-%m-%d') AS dia, CAST(coalesce(sum(total), 0) AS DOUBLE) AS total
    FROM dias LEFT JOIN venta ON CAST(fecha AS DATE) = dias.dia GROUP BY dias.dia
    """,
)
def _(r: Retail) -> DataFrame:
    return dashboard.last_days(r.ventas_base, r.detalles, r.as_of)


@query(
    "a9_customer_scatter",
    "SELECT cliente_id, CAST(sum(total) AS DOUBLE) AS total, count(*) AS compras FROM venta GROUP BY cliente_id",
)
def _(r: Retail) -> DataFrame:
    return dashboard.customer_scatter(r.ventas)


@query(
    "a10_kpi_row",
    """
    SELECT (SELECT count(DISTINCT coalesce(categoria, '-')) FROM producto) AS total_categorias,
           (SELECT count(*) FROM producto) AS total_productos, (SELECT count(*) FROM customer) AS total_clientes,
           (SELECT count(*) FROM orders) AS pedidos
    """,
)
def _(r: Retail) -> DataFrame:
    return dashboard.kpi_row(r.catalogo, r.clientes, r.ventas_base)


@query(
    "a11_today",
    """
    SELECT count(*) AS ventas_hoy, CAST(coalesce(sum(total), 0) AS DOUBLE) AS ingresos_hoy
    FROM venta, hoy WHERE CAST(fecha AS DATE) = hoy.dia
    """,
)
def _(r: Retail) -> DataFrame:
    return dashboard.today(r.ventas_base, r.detalles, r.as_of)


@query(
    "a12_segment_sizes",
    _SEGMENTED
    + """
    SELECT count(*) AS total_clientes, count(*) FILTER (segmento = 'VIP') AS vip_count,
           count(*) FILTER (segmento = 'Regular') AS regular_count,
           count(*) FILTER (segmento = 'Ocasional') AS ocasional_count FROM seg
    """,
)
def _(r: Retail) -> DataFrame:
    return customers.segment_sizes(_segmented(r))


@query(
    "a13_mean_ticket_by_segment",
    _SEGMENTED
    + """
    SELECT s.segmento, round(coalesce(avg(ticket_promedio), 0), 4) AS ticket
    FROM (VALUES ('VIP'), ('Regular'), ('Ocasional')) s(segmento) LEFT JOIN seg USING (segmento) GROUP BY s.segmento
    """,
)
def _(r: Retail) -> DataFrame:
    return customers.mean_ticket_by_segment(_segmented(r)).withColumn("ticket", F.round("ticket", 4))


@query(
    "n4_rule_segments",
    _SEGMENTED + "SELECT cliente_id, segmento FROM seg",
)
def _(r: Retail) -> DataFrame:
    return _segmented(r).select("cliente_id", "segmento")


@query(
    "n7_segment_report",
    _SEGMENTED
    + """
    SELECT cliente_id, nombre, segmento, total_compras, frecuencia, ticket_promedio FROM seg
    """,
)
def _(r: Retail) -> DataFrame:
    return customers.segment_report(_segmented(r))


@query(
    "k2_top_customers",
    """
    SELECT cliente_id, nombre, total_compras, frecuencia, ticket_promedio
    FROM metrica ORDER BY total_compras DESC, cliente_id LIMIT 10
    """,
)
def _(r: Retail) -> DataFrame:
    return customers.top_customers(r.metricas)


FEATURES = """
, rasgo AS (
  SELECT id AS venta_id, CAST(total AS DOUBLE) AS total, num_productos,
         CASE WHEN num_productos = 0 THEN 0 ELSE CAST(total AS DOUBLE) / num_productos END AS ticket_promedio
  FROM venta
)
"""


@query(
    "a16_feature_quantiles",
    FEATURES
    + """
    SELECT 'total' AS feature, round(quantile_cont(total, 0.05), 7) AS q05, round(quantile_cont(total, 0.95), 7) AS q95 FROM rasgo
    UNION ALL SELECT 'num_productos', round(quantile_cont(CAST(num_productos AS DOUBLE), 0.05), 7),
      round(quantile_cont(CAST(num_productos AS DOUBLE), 0.95), 7) FROM rasgo
    UNION ALL SELECT 'ticket_promedio', round(quantile_cont(ticket_promedio, 0.05), 7),
      round(quantile_cont(ticket_promedio, 0.95), 7) FROM rasgo
    """,
)
def _(r: Retail) -> DataFrame:
    limits = anomaly.limits_row(anomaly.sale_features(r.ventas))
    return limits.select("feature", F.round("q05", 7).alias("q05"), F.round("q95", 7).alias("q95"))


@query(
    "n8_sale_features",
    FEATURES + "SELECT venta_id, total, num_productos, ticket_promedio FROM rasgo",
)
def _(r: Retail) -> DataFrame:
    return anomaly.sale_features(r.ventas).drop("fecha")


REASONS = """
, q AS (
  SELECT quantile_cont(total, 0.05) AS t05, quantile_cont(total, 0.95) AS t95,
         quantile_cont(CAST(num_productos AS DOUBLE), 0.95) AS n95, quantile_cont(ticket_promedio, 0.95) AS p95 FROM rasgo
), motivada AS (
  SELECT venta_id, coalesce(nullif(concat_ws(' | ', CASE WHEN total > t95 THEN 'Total muy alto' END,
    CASE WHEN total < t05 THEN 'Total muy bajo' END, CASE WHEN num_productos > n95 THEN 'Muchos productos' END,
    CASE WHEN num_productos = 0 THEN 'Sin productos' END,
    CASE WHEN ticket_promedio > p95 THEN 'Ticket promedio alto' END), ''), 'Patrón inusual') AS razon
  FROM rasgo, q
)
"""
_REASONS = FEATURES + REASONS + "SELECT venta_id, razon FROM motivada"


@query("n11_reasons", _REASONS)
def _(r: Retail) -> DataFrame:
    return anomaly.with_reasons(anomaly.sale_features(r.ventas)).select("venta_id", "razon")


@query("d5_reason_function", _REASONS)
def _(r: Retail) -> DataFrame:
    features = materialize(anomaly.sale_features(r.ventas), "sale-features")
    return features.select("venta_id", anomaly.reasons(anomaly.feature_limits(features)).alias("razon"))


@query(
    "a24_feature_scales",
    """
    SELECT 'total_compras' AS feature, round(avg(total_compras), 3) AS media, round(stddev_pop(total_compras), 3) AS desviacion FROM metrica
    UNION ALL SELECT 'frecuencia', round(avg(frecuencia), 3), round(stddev_pop(frecuencia), 3) FROM metrica
    UNION ALL SELECT 'ticket_promedio', round(avg(ticket_promedio), 3), round(stddev_pop(ticket_promedio), 3) FROM metrica
    """,
)
def _(r: Retail) -> DataFrame:
    scales = segments.feature_scales(r.metricas)
    return scales.select("feature", F.round("media", 3).alias("media"), F.round("desviacion", 3).alias("desviacion"))


@query(
    "a17_series_range",
    """
    SELECT producto_id, min(cantidad) AS minimo, max(cantidad) AS maximo, count(*) AS dias FROM serie GROUP BY producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    return series.series_range(r.serie)


@query("a19_daily_quantity", "SELECT producto_id, dia, cantidad FROM diario")
def _(r: Retail) -> DataFrame:
    return series.daily_quantity(r.ventas_base, r.detalles)


_PAIRS = """
, canasta AS (SELECT DISTINCT venta_id, producto_id FROM detalle)
, par AS (
  SELECT a.producto_id AS p1, b.producto_id AS p2, count(*) AS n
  FROM canasta a JOIN canasta b ON a.venta_id = b.venta_id AND a.producto_id <> b.producto_id GROUP BY 1, 2
)
"""


@query("j6_bought_together", _PAIRS + "SELECT p1, p2, n FROM par")
def _(r: Retail) -> DataFrame:
    return basket.mirrored(basket.pair_counts(r.detalles), "n")


@query("a20_copurchase_pairs", _PAIRS + "SELECT p1, p2 FROM par")
def _(r: Retail) -> DataFrame:
    return basket.copurchase_pairs(r.detalles)


@query(
    "a21_copurchase_confidence",
    _PAIRS
    + """
    SELECT p1 AS product_a, p2 AS product_b, n AS count, n / v AS confidence
    FROM par JOIN (SELECT producto_id, count(*) AS v FROM canasta GROUP BY 1) s ON s.producto_id = p1
    """,
)
def _(r: Retail) -> DataFrame:
    return basket.copurchase_matrix(r.detalles)


@query("n18_binary_matrix", _PAIRS + "SELECT p1, p2, 1.0::DOUBLE AS valor FROM par")
def _(r: Retail) -> DataFrame:
    return basket.copurchase_pairs(r.detalles).withColumn("valor", F.lit(1.0))


@query("a22_distinct_categories", "SELECT DISTINCT categoria FROM producto")
def _(r: Retail) -> DataFrame:
    return r.catalogo.select("categoria").distinct()


@query(
    "a25_stock_against_sales",
    """
    SELECT p.id, nombre, stock, CAST(coalesce(sum(cantidad), 0) AS BIGINT) AS vendidas
    FROM producto p LEFT JOIN detalle ON producto_id = p.id GROUP BY p.id, nombre, stock
    """,
)
def _(r: Retail) -> DataFrame:
    return sales.stock_against_sales(r.catalogo, r.detalles)


@query(
    "a26_customer_history",
    """
    SELECT cliente_id, c.nombre AS cliente, v.id AS venta_id, CAST(fecha AS DATE) AS fecha,
           CAST(total AS DOUBLE) AS total, num_productos
    FROM venta v JOIN cliente c ON c.id = cliente_id ORDER BY cliente_id, fecha, venta_id
    """,
)
def _(r: Retail) -> DataFrame:
    return sales.customer_history(r.ventas, r.clientes).withColumn("fecha", F.to_date("fecha"))


# ---- series ---------------------------------------------------------------


@query("w1_ordered_series", "SELECT producto_id, dia, cantidad, seq FROM serie")
def _(r: Retail) -> DataFrame:
    return r.serie


@query("n13_demand_series", "SELECT producto_id, dia, cantidad, seq FROM serie")
def _(r: Retail) -> DataFrame:
    return series.demand_series(series.daily_quantity(r.ventas_base, r.detalles))


@query(
    "w2_training_windows",
    """
    , fin AS (SELECT producto_id, max(seq) AS n FROM serie GROUP BY 1)
    SELECT s.producto_id, s.seq AS ventana, CAST(i AS INTEGER) AS pos, e.cantidad AS entrada, o.cantidad AS salida
    FROM serie s JOIN fin USING (producto_id), range(7) t(i)
    JOIN serie e ON e.producto_id = s.producto_id AND e.seq = s.seq + i
    JOIN serie o ON o.producto_id = s.producto_id AND o.seq = s.seq + 7 + i
    WHERE s.seq + 13 <= fin.n
    """,
)
def _(r: Retail) -> DataFrame:
    windows = series.training_windows(r.serie)
    both = F.arrays_zip("entrada", "salida")
    return windows.select("producto_id", "ventana", F.posexplode(both).alias("pos", "v")).select(
        "producto_id", "ventana", "pos", F.col("v.entrada").alias("entrada"), F.col("v.salida").alias("salida")
    )


_LAST = """
, ultimo AS (
  SELECT *, row_number() OVER (PARTITION BY producto_id ORDER BY seq DESC) AS atras FROM serie
)
"""


@query(
    "w3_last_points",
    _LAST + "SELECT producto_id, dia, cantidad, CAST(atras AS INTEGER) AS atras FROM ultimo WHERE atras <= 7",
)
def _(r: Retail) -> DataFrame:
    return series.last_points(r.serie).select("producto_id", "dia", "cantidad", "atras")


@query(
    "w4_min_max_scaling",
    """
    , rango AS (
      SELECT producto_id, min(cantidad) AS lo,
             CASE WHEN max(cantidad) = min(cantidad) THEN 1 ELSE max(cantidad) - min(cantidad) END AS r
      FROM serie GROUP BY 1
    )
    SELECT producto_id, seq, round((cantidad - lo) / r, 6) AS escalado,
           CAST(floor((cantidad - lo) / r * r + lo + 0.5) AS BIGINT) AS restaurado
    FROM serie JOIN rango USING (producto_id)
    """,
)
def _(r: Retail) -> DataFrame:
    return series.scaled(r.serie).select("producto_id", "seq", F.round("escalado", 6).alias("escalado"), "restaurado")


@query(
    "w5_series_trend",
    """
    SELECT producto_id, CASE WHEN arg_max(cantidad, seq) > arg_min(cantidad, seq) THEN 'creciente'
      WHEN arg_max(cantidad, seq) < arg_min(cantidad, seq) THEN 'decreciente' ELSE 'estable' END AS tendencia
    FROM serie GROUP BY producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    ends = r.serie.groupBy("producto_id").agg(
        F.min_by("cantidad", "seq").alias("a"), F.max_by("cantidad", "seq").alias("b")
    )
    return ends.select("producto_id", series.trend(F.col("a"), F.col("b")).alias("tendencia"))


_SIMPLE = (
    _LAST
    + """
    , simple AS (
      SELECT producto_id, CAST(p AS INTEGER) AS paso, greatest(1, CAST(floor(base) AS BIGINT)) AS valor
      FROM (SELECT producto_id, sum(cantidad) / 7.0::DOUBLE AS base FROM ultimo WHERE atras <= 7 GROUP BY 1) b, range(1, 8) t(p)
    )
    """
)


@query("n16_simple_forecast", _SIMPLE + "SELECT producto_id, paso, valor FROM simple")
def _(r: Retail) -> DataFrame:
    return series.simple_forecast(r.serie)


@query(
    "n17_forecast_summary",
    _SIMPLE
    + """
    SELECT producto_id, floor(avg(valor) * 10 + 0.5) / 10 AS promedio_diario,
      CASE WHEN arg_max(valor, paso) > arg_min(valor, paso) THEN 'creciente'
           WHEN arg_max(valor, paso) < arg_min(valor, paso) THEN 'decreciente' ELSE 'estable' END AS tendencia,
      0.5::DOUBLE AS confianza
    FROM simple GROUP BY producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    simple = series.simple_forecast(r.serie).withColumn("metodo", F.lit(series.SIMPLE))
    return series.forecast_summary(simple).drop("varianza")


@query(
    "n17_summary_of_varying_values",
    _LAST
    + """
    SELECT producto_id, floor(avg(cantidad) * 10 + 0.5) / 10 AS promedio_diario,
      CASE WHEN arg_max(cantidad, seq) > arg_min(cantidad, seq) THEN 'creciente'
           WHEN arg_max(cantidad, seq) < arg_min(cantidad, seq) THEN 'decreciente' ELSE 'estable' END AS tendencia,
      round(greatest(0.5, least(0.95, 1 - var_pop(cantidad) / (avg(cantidad) * avg(cantidad)))), 9) AS confianza
    FROM ultimo WHERE atras <= 7 GROUP BY producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    """The last selling days in the place of values that a network forecast."""
    last = series.last_points(r.serie).select("producto_id", F.col("seq").alias("paso"), F.col("cantidad").alias("valor"))
    out = series.forecast_summary(last.withColumn("metodo", F.lit(series.LSTM))).drop("varianza")
    return out.withColumn("confianza", F.round("confianza", 9))


_MOVES = """
SELECT producto_id, round(avg(cantidad), 4) AS promedio, round(var_pop(cantidad), 4) AS varianza
FROM ultimo WHERE atras <= 7 GROUP BY producto_id
"""


@query("a18_mean_variance", _LAST + _MOVES)
def _(r: Retail) -> DataFrame:
    last = series.last_points(r.serie).withColumnRenamed("cantidad", "valor")
    return last.groupBy("producto_id").agg(
        F.round(F.avg("valor"), 4).alias("promedio"), F.round(F.var_pop("valor"), 4).alias("varianza")
    )


# ---- set operations -------------------------------------------------------


@query(
    "u1_append",
    "SELECT id, nombre, correo FROM cliente UNION ALL SELECT id, nombre, correo FROM usuario",
)
def _(r: Retail) -> DataFrame:
    columns = ["id", "nombre", "correo"]
    return r.clientes.select(*columns).unionByName(r.usuarios.select(*columns))


@query("u2_distinct_pairs", "SELECT DISTINCT venta_id, producto_id FROM detalle")
def _(r: Retail) -> DataFrame:
    return basket.baskets(r.detalles)


@query(
    "u3_difference",
    "SELECT id, nombre FROM cliente WHERE id NOT IN (SELECT s_suppkey * 20 FROM supplier)",
)
def _(r: Retail) -> DataFrame:
    from basketry.operators.mutations import delete_rows

    gone = r.table("supplier").select((F.col("s_suppkey") * 20).alias("id"))
    return delete_rows(r.clientes, gone).select("id", "nombre")
