"""Stored models: prices, segments and anomalies by models that are kept and used again.

Models with known values stand in the store as if trained before, so SQL can
tell what a stored model gives from what a new training would.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.model import Retail
from basketry.operators import anomaly, pricing, registry, segments
from basketry.operators.customers import SEGMENTS
from basketry.operators.model_store import ModelStore
from basketry.plans.bind_models import FIT, NOW
from basketry.plans.bind_sales import FEATURES, REASONS
from basketry.plans.registry import query
from basketry.plans.sync import sync_and_train
from basketry.session import materialize, scratch_path
from basketry.sources.snapshots import audit_log, read_snapshot

SOON = NOW + timedelta(minutes=30)
LATER = NOW + timedelta(minutes=61)


def new_store(r: Retail) -> ModelStore:
    return ModelStore(r.spark, scratch_path(r.spark, "models"))


# ---- prices ---------------------------------------------------------------

# Weights of the known price model.
BASE, PER_CODE, PER_UNIT, PER_LETTER = 100.0, 2.0, 0.5, 3.0


def _known_prices(r: Retail) -> pricing.PriceModel:
    """A model fitted to prices that follow the known weights."""
    coded = r.snapshot.join(pricing.category_codes(r.snapshot), "categoria")
    price = BASE + PER_CODE * F.col("codigo") + PER_UNIT * F.col("stock") + PER_LETTER * F.length("nombre")
    return pricing.train_prices(coded.withColumn("precio", price).drop("codigo"))


@query(
    "n26_stored_prices",
    FIT
    + f"""
    SELECT id, CAST({BASE} + {PER_CODE} * codigo + {PER_UNIT} * stock + {PER_LETTER} * length(nombre) AS DOUBLE) AS guardado,
           round(w0 + wa * codigo + wb * stock + wc * length(nombre), 2) AS nuevo
    FROM snapshot JOIN codigo USING (categoria), fit
    """,
)
def _(r: Retail) -> DataFrame:
    """Prices half an hour after the known model was stored, and by the training that follows when its hour is over."""
    store = new_store(r)
    pricing.store_prices(store, _known_prices(r), NOW)
    asked = r.snapshot.select("id", "categoria", "stock", "nombre")

    def prices(at: datetime, name: str) -> DataFrame:
        return pricing.suggest_prices(pricing.price_model(store, r.snapshot, at), asked).select("id", F.col("precio_sugerido").alias(name))

    return prices(SOON, "guardado").join(prices(LATER, "nuevo"), "id")


# ---- segments -------------------------------------------------------------

# Centres one population deviation below, at, and above the mean of each feature.
_NEAREST = """
, escala AS (
  SELECT avg(total_compras) AS m1, avg(frecuencia) AS m2, avg(ticket_promedio) AS m3,
         stddev_samp(total_compras) AS s1, stddev_samp(frecuencia) AS s2, stddev_samp(ticket_promedio) AS s3,
         stddev_pop(total_compras) AS p1, stddev_pop(frecuencia) AS p2, stddev_pop(ticket_promedio) AS p3 FROM metrica
), cerca AS (
  SELECT cliente_id, any_value(ticket_promedio) AS ticket_promedio,
         arg_min(k, ((total_compras - m1 - k * p1) / s1) ** 2 + ((frecuencia - m2 - k * p2) / s2) ** 2
                  + ((ticket_promedio - m3 - k * p3) / s3) ** 2) AS k
  FROM metrica, escala, (VALUES (-1), (0), (1)) c(k) GROUP BY cliente_id
), grupo AS (
  SELECT *, CAST(row_number() OVER (ORDER BY ticket_medio DESC) AS INTEGER) AS puesto FROM (
    SELECT k, avg(ticket_promedio) AS ticket_medio, count(*) AS clientes FROM cerca GROUP BY k) t
), nombrado AS (
  SELECT cliente_id, puesto, ['VIP', 'Regular', 'Ocasional'][puesto] AS segmento FROM cerca JOIN grupo USING (k)
)
"""


def _centres(r: Retail) -> DataFrame:
    """Three rows, the centres of the known segment model."""
    moved = [
        F.struct(*[(F.avg(c) + F.lit(float(k)) * F.stddev_pop(c)).alias(c) for c in segments.FEATURES]) for k in (-1, 0, 1)
    ]
    return r.metricas.agg(F.array(*moved).alias("c")).select(F.inline("c"))


def _known_segments(r: Retail) -> segments.SegmentModel:
    """The segment model with the known centres, as read from the store half an hour later."""
    store = new_store(r)
    segments.store_segments(store, segments.train_segments(r.metricas, restarts=1, starts=_centres(r)), NOW)
    return segments.segment_model(store, r.metricas, SOON)


@query("n5_assigned_customers", _NEAREST + "SELECT cliente_id, puesto FROM nombrado")
def _(r: Retail) -> DataFrame:
    model = _known_segments(r)
    return model.assign(r.metricas).join(F.broadcast(model.labels), "cluster").select("cliente_id", "puesto")


@query("n6_named_clusters", _NEAREST + "SELECT cliente_id, segmento FROM nombrado")
def _(r: Retail) -> DataFrame:
    return _known_segments(r).label(r.metricas).select("cliente_id", "segmento")


@query("a15_cluster_means", _NEAREST + "SELECT puesto, round(ticket_medio, 6) AS ticket_medio, clientes FROM grupo")
def _(r: Retail) -> DataFrame:
    return segments.cluster_means(_known_segments(r).assign(r.metricas)).select(
        "puesto", F.round("ticket_medio", 6).alias("ticket_medio"), "clientes"
    )


@query(
    "k4_clusters_by_ticket",
    _NEAREST + "SELECT puesto, ['VIP', 'Regular', 'Ocasional'][puesto] AS segmento, round(ticket_medio, 6) AS ticket_medio FROM grupo",
)
def _(r: Retail) -> DataFrame:
    means = segments.cluster_means(_known_segments(r).assign(r.metricas))
    return means.select("puesto", "segmento", F.round("ticket_medio", 6).alias("ticket_medio"))


@query("n6_trained_clusters")
def _(r: Retail) -> DataFrame:
    """Labels of the clusters that a training finds."""
    return segments.train_segments(r.metricas).label(r.metricas).select("cliente_id", "segmento")


@query(
    "s7_published_segments",
    _NEAREST
    + """
    SELECT cliente_id, nombre, total_compras, frecuencia, ticket_promedio, segmento FROM metrica JOIN nombrado USING (cliente_id)
    """,
)
def _(r: Retail) -> DataFrame:
    """The published customers after both stages of a refresh, with the known segment model in the store."""
    store, root = new_store(r), scratch_path(r.spark, "snapshot")
    segments.store_segments(store, segments.train_segments(r.metricas, restarts=1, starts=_centres(r)), NOW)
    entry, _ = sync_and_train(r.spark, r.productos, r.categorias, r.ventas_base, r.detalles, root, store, SOON)
    return read_snapshot(r.spark, root, "clientes", entry)


@query(
    "s8_audit_of_both_stages",
    """
    SELECT 'productos' AS tipo, count(*) AS num_registros, 1::BIGINT AS veces FROM snapshot UNION ALL SELECT 'ventas', count(*), 1 FROM venta
    UNION ALL SELECT 'clientes', count(*), 2 FROM metrica
    """,
)
def _(r: Retail) -> DataFrame:
    """Audit rows of a refresh with published segments: customers are written twice, the other tables once."""
    store, root = new_store(r), scratch_path(r.spark, "snapshot")
    segments.store_segments(store, segments.train_segments(r.metricas, restarts=1, starts=_centres(r)), NOW)
    sync_and_train(r.spark, r.productos, r.categorias, r.ventas_base, r.detalles, root, store, SOON)
    return audit_log(r.spark, root).where("estado = 'EXITOSA'").groupBy("tipo", "num_registros").agg(F.count(F.lit(1)).alias("veces"))


# ---- anomalies ------------------------------------------------------------

# The known forest: for each feature four trees of one split, at these deviations
# above the mean; the right leaf is at depth 4 to 1, the left one at depth 8.
_STEPS = (0.5, 1.0, 1.5, 2.0)
_LEFT = 8.0
_NORM = float(anomaly._average_path(anomaly.SAMPLE))


def _known_forest(features: DataFrame) -> DataFrame:
    nodes = []
    for f, c in enumerate(anomaly.FEATURES):
        for j, step in enumerate(_STEPS):
            split = F.avg(c) + F.lit(step) * F.stddev_pop(c)
            tree = len(_STEPS) * f + j
            for node, feature, at, depth in ((0, f, split, 0.0), (1, -1, F.lit(0.0), _LEFT), (2, -1, F.lit(0.0), 4.0 - j)):
                nodes.append(
                    F.struct(
                        F.lit(tree).alias("tree"), F.lit(node).alias("node"), F.lit(feature).alias("feature"),
                        at.alias("split"), F.lit(depth).alias("path"),
                    )
                )
    return features.agg(F.array(*nodes).alias("n")).select(F.inline("n"))


def _depth_sql() -> str:
    """Mean depth of a sale in the known forest."""
    parts = [
        f"CASE WHEN {c} > m_{c} + {step} * d_{c} THEN {4.0 - j} ELSE {_LEFT} END"
        for c in anomaly.FEATURES
        for j, step in enumerate(_STEPS)
    ]
    return "(" + " + ".join(parts) + f") / {len(parts)}.0::DOUBLE"


# The training saw the sales with an even id.
_SCORED = (
    FEATURES
    + ", medida AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in anomaly.FEATURES)
    + f""" FROM rasgo)
, puntuada AS (
  SELECT rasgo.*, -pow(2.0::DOUBLE, -({_depth_sql()}) / {_NORM!r}::DOUBLE) AS score FROM rasgo, medida
), corte AS (
  SELECT quantile_cont(score, {anomaly.CONTAMINATION}) AS limite, avg(score) AS medio, avg(total) AS t, avg(num_productos) AS n,
         avg(ticket_promedio) AS k FROM puntuada WHERE venta_id % 2 = 0
), marcada AS (
  SELECT puntuada.*, score < limite AS es_anomalia FROM puntuada, corte
)
"""
)


def _known_detector(r: Retail) -> tuple[anomaly.Detector, DataFrame]:
    """The detector with the known forest, trained on half of the sales and read from the store; and the features of all sales."""
    features = materialize(anomaly.sale_features(r.ventas), "sale-features")
    forest = materialize(_known_forest(features), "forest")
    seen = features.where("venta_id % 2 = 0")
    store = new_store(r)
    anomaly.store_detector(store, anomaly.with_bound(forest, seen)[0], NOW)
    return anomaly.detector(store, features, SOON), features


def _flagged(r: Retail) -> DataFrame:
    model, features = _known_detector(r)
    return materialize(model.flag(features), "flagged")


@query("n10_scored_sales", _SCORED + "SELECT venta_id, round(score, 9) AS score, es_anomalia FROM marcada")
def _(r: Retail) -> DataFrame:
    return _flagged(r).select("venta_id", F.round("score", 9).alias("score"), "es_anomalia")


@query("n10_trained_scores")
def _(r: Retail) -> DataFrame:
    """Scores by a forest grown on the sales."""
    return anomaly.detect_anomalies(anomaly.sale_features(r.ventas)).select("venta_id", "score", "es_anomalia")


@query(
    "n10_drift",
    _SCORED
    + """
    SELECT count(*) AS ventas, round(count_if(es_anomalia) / count(*), 9) AS proporcion, round(avg(score), 9) AS score_medio,
           0.1::DOUBLE AS proporcion_entrenamiento, round(any_value(medio), 9) AS score_entrenamiento,
           round(any_value(t), 4) AS total_entrenamiento, round(avg(total), 4) AS total_medio
    FROM marcada, corte WHERE venta_id % 2 = 1
    """,
)
def _(r: Retail) -> DataFrame:
    """Sales that the training did not see, against those it saw."""
    model, features = _known_detector(r)
    report = anomaly.drift_report(model, model.flag(features.where("venta_id % 2 = 1")))
    rounded = {"proporcion": 9, "score_medio": 9, "score_entrenamiento": 9, "total_entrenamiento": 4, "total_medio": 4}
    return report.select("ventas", "proporcion_entrenamiento", *[F.round(c, n).alias(c) for c, n in rounded.items()])


@query("f5_anomalous_sales", _SCORED + "SELECT venta_id, total, num_productos FROM marcada WHERE es_anomalia")
def _(r: Retail) -> DataFrame:
    return _flagged(r).where("es_anomalia").select("venta_id", "total", "num_productos")


@query("k3_anomalies_by_score", _SCORED + "SELECT venta_id, round(score, 9) AS score_anomalia FROM marcada WHERE es_anomalia")
def _(r: Retail) -> DataFrame:
    return anomaly.anomaly_list(_flagged(r)).select("venta_id", F.round("score_anomalia", 9).alias("score_anomalia"))


@query("a14_anomaly_rate", _SCORED + "SELECT round(100 * count_if(es_anomalia) / count(*), 9) AS porcentaje FROM marcada")
def _(r: Retail) -> DataFrame:
    return anomaly.anomaly_counts(_flagged(r)).select(F.round("porcentaje", 9).alias("porcentaje"))


@query(
    "n12_anomaly_report",
    _SCORED
    + REASONS
    + f"""
    SELECT venta_id, CAST(v.fecha AS DATE) AS fecha, marcada.total, round(score, 9) AS score_anomalia, razon,
           CASE WHEN score < {anomaly.ERROR_SCORE} THEN 'error' ELSE 'warning' END AS gravedad,
           (SELECT count(*) FROM marcada) AS total_ventas_analizadas,
           (SELECT count(*) FROM marcada WHERE es_anomalia) AS anomalias_detectadas
    FROM marcada JOIN motivada USING (venta_id) JOIN venta v ON v.id = venta_id WHERE es_anomalia
    """,
)
def _(r: Retail) -> DataFrame:
    flagged = _flagged(r)
    one = F.lit(1).alias("_k")
    counts = anomaly.anomaly_counts(flagged).select("total_ventas_analizadas", "anomalias_detectadas", one)
    rows = anomaly.anomaly_list(flagged).withColumn("score_anomalia", F.round("score_anomalia", 9)).select("*", one)
    return rows.join(F.broadcast(counts), "_k").drop("_k")


# ---- both -----------------------------------------------------------------


@query(
    "n25_trained_models",
    FIT
    + """
    SELECT 'price_predictor' AS model_name, round(r2, 6) AS accuracy, n AS samples_count FROM fit
    UNION ALL SELECT 'customer_segmentation', NULL, count(*) FROM metrica
    UNION ALL SELECT 'anomaly_detector', NULL, count(*) FROM venta
    """,
)
def _(r: Retail) -> DataFrame:
    root = scratch_path(r.spark, "snapshot")
    _, models = sync_and_train(r.spark, r.productos, r.categorias, r.ventas_base, r.detalles, root, new_store(r), NOW)
    info = registry.model_info(models.runs(r.spark, NOW))
    return info.select("model_name", F.round("accuracy", 6).alias("accuracy"), "samples_count")


@query(
    "n25_segment_sizes",
    """
    SELECT count(*) AS clientes, 3::BIGINT AS segmentos FROM metrica
    """,
)
def _(r: Retail) -> DataFrame:
    """Customers and segments of a snapshot published after a training: every customer has one of the three."""
    root = scratch_path(r.spark, "snapshot")
    entry, _ = sync_and_train(r.spark, r.productos, r.categorias, r.ventas_base, r.detalles, root, new_store(r), NOW)
    named = read_snapshot(r.spark, root, "clientes", entry).where(F.col("segmento").isin(*SEGMENTS))
    return named.agg(F.count(F.lit(1)).alias("clientes"), F.count_distinct("segmento").alias("segmentos"))
