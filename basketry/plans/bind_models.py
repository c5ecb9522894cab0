"""Models, recommendations, matching, caches and the incremental refresh."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.model import SOURCES, Retail
from basketry.operators import anomaly, basket, forecast, matching, pricing, recommend, registry, segments, series
from basketry.operators.model_store import ModelStore
from basketry.operators.similar import top_similar
from basketry.plans.bind_changes import _AS_OF, AS_OF, at
from basketry.plans.identify import identified_products
from basketry.plans.registry import query
from basketry.plans.sync import sync
from basketry.session import materialize, scratch_path
from basketry.sources.snapshots import audit_log
from basketry.streaming import refresh

NOW = datetime(2024, 1, 25)

# ---- prices ---------------------------------------------------------------

_CODES = """
, codigo AS (SELECT categoria, row_number() OVER (ORDER BY categoria) - 1 AS codigo FROM (SELECT DISTINCT categoria FROM snapshot) t)
"""


@query("w7_category_codes", _CODES + "SELECT categoria, codigo FROM codigo")
def _(r: Retail) -> DataFrame:
    return pricing.category_codes(r.snapshot)


# Centred sums and Cramer's rule for three features.
FIT = (
    _CODES
    + """
, x AS (
  SELECT CAST(codigo AS DOUBLE) AS a, CAST(stock AS DOUBLE) AS b, CAST(length(nombre) AS DOUBLE) AS c, precio AS y
  FROM snapshot JOIN codigo USING (categoria)
), s AS (
  SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc,
         covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(c, y) AS cy, covar_pop(y, y) AS yy,
         avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, count(*) AS n FROM x
), d AS (
  SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s
), w AS (
  SELECT *,
    (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / det AS wa,
    (aa * (byy * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / det AS wb,
    (aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / det AS wc
  FROM d
), fit AS (
  SELECT my - wa * ma - wb * mb - wc * mc AS w0, wa, wb, wc, (wa * ay + wb * byy + wc * cy) / yy AS r2, n FROM w
)
"""
)


@query(
    "n1_price_model",
    FIT
    + """
    SELECT round(w0, 4) AS intercepto, round(wa, 4) AS w_codigo, round(wb, 4) AS w_stock, round(wc, 4) AS w_len_nombre,
           n AS muestras FROM fit
    """,
)
def _(r: Retail) -> DataFrame:
    fit = pricing.train_prices(r.snapshot).coefficients()
    names = ["intercepto", "w_codigo", "w_stock", "w_len_nombre"]
    return fit.select(*[F.round(n, 4).alias(n) for n in names], "muestras")


@query("n2_price_r2", FIT + "SELECT round(r2, 6) AS r2 FROM fit")
def _(r: Retail) -> DataFrame:
    return pricing.train_prices(r.snapshot).coefficients().select(F.round("r2", 6).alias("r2"))


@query(
    "n3_price_suggestion",
    FIT
    + """
    SELECT p.id, round(w0 + wa * coalesce(k.codigo, (SELECT count(*) FROM codigo) // 2) + wb * stock + wc * length(nombre), 2)
           AS precio_sugerido, 0.85::DOUBLE AS confianza
    FROM producto p LEFT JOIN codigo k ON k.categoria = coalesce(p.categoria, p.descripcion), fit
    """,
)
def _(r: Retail) -> DataFrame:
    asked = r.table("part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") != 50, F.col("p_type")).otherwise(F.col("p_brand")).alias("categoria"),
        (F.col("p_size") * 10).alias("stock"),
        F.col("p_name").alias("nombre"),
    )
    model = pricing.train_prices(r.snapshot)
    return pricing.suggest_prices(model, asked).select("id", "precio_sugerido", "confianza")


# ---- clusters and anomalies -----------------------------------------------


@query("n5_cluster_customers")
def _(r: Retail) -> DataFrame:
    return segments.cluster_customers(r.metricas).select("cliente_id", "cluster")


@query("n9_isolation_forest")
def _(r: Retail) -> DataFrame:
    features = materialize(anomaly.sale_features(r.ventas), "sale-features")
    return anomaly.train_forest(features)


# ---- forecasts ------------------------------------------------------------


def _series(r: Retail) -> DataFrame:
    return materialize(r.serie, "series")


@query("n14_lstm_forecast")
def _(r: Retail) -> DataFrame:
    return forecast.lstm_forecast(_series(r))


@query("n15_forecast")
def _(r: Retail) -> DataFrame:
    values = materialize(forecast.forecast(_series(r)), "forecast")
    return values.join(series.forecast_summary(values), "producto_id")


# ---- recommendations ------------------------------------------------------


def _vectors(r: Retail) -> DataFrame:
    return r.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")


_SIMILAR = """
, parecido AS (
  SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS puesto FROM (
    SELECT a.vec_id AS id, b.vec_id AS other,
           round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 9) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) t
)
"""


@query(
    "j7_nearest_vector",
    _SIMILAR + "SELECT id, other, round(score, 6) AS score FROM parecido WHERE puesto = 1",
)
def _(r: Retail) -> DataFrame:
    return top_similar(_vectors(r), 1).select("id", "other", F.round("score", 6).alias("score"))


@query(
    "w8_top_n_similar",
    _SIMILAR + "SELECT id, CAST(puesto AS INTEGER) AS puesto, other, round(score, 6) AS score FROM parecido WHERE puesto <= 10",
)
def _(r: Retail) -> DataFrame:
    return top_similar(_vectors(r), 10).select("id", "puesto", "other", F.round("score", 6).alias("score"))


@query(
    "k6_top_four_related",
    _SIMILAR + "SELECT id, CAST(puesto AS INTEGER) AS puesto, other FROM parecido WHERE puesto <= 4",
)
def _(r: Retail) -> DataFrame:
    return top_similar(_vectors(r), recommend.TOP_N).select("id", "puesto", "other")


_RELATED = """
SELECT id, CAST(puesto AS INTEGER) AS puesto, other AS relacionado_id, coalesce(s.nombre, 'Producto ' || other) AS nombre,
       coalesce(s.categoria, 'Desconocida') AS categoria, round(score, 6) AS score,
       'Recomendado por Deep Learning (embeddings)' AS razon
FROM parecido LEFT JOIN (SELECT id AS sid, nombre, categoria FROM snapshot) s ON sid = other WHERE puesto <= 4
"""


@query("n20_similar_products", _SIMILAR + _RELATED)
def _(r: Retail) -> DataFrame:
    return recommend.similar_products(_vectors(r), r.snapshot).withColumn("score", F.round("score", 6))


_SAME = """
, mismo AS (
  SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS puesto, b.nombre, b.categoria
  FROM snapshot a JOIN snapshot b ON a.categoria = b.categoria AND a.id <> b.id
)
"""


@query("w9_first_of_category", _SAME + "SELECT id, other, CAST(puesto AS INTEGER) AS puesto FROM mismo WHERE puesto <= 4")
def _(r: Retail) -> DataFrame:
    return recommend.same_category(r.snapshot)


@query(
    "n22_picked_product",
    _SAME
    + """
    SELECT id, CAST(puesto AS INTEGER) AS puesto, other AS relacionado_id, nombre, categoria, 0.85::DOUBLE AS score,
           'Misma categoría' AS razon FROM mismo WHERE puesto <= 4
    """,
)
def _(r: Retail) -> DataFrame:
    return recommend.category_recommendations(r.snapshot)


@query(
    "n21_with_fallback",
    _SIMILAR
    + _SAME
    + _RELATED
    + """
    UNION ALL
    SELECT id, CAST(puesto AS INTEGER), other, nombre, categoria, 0.75, 'Misma categoría (fallback)'
    FROM mismo WHERE puesto <= 4 AND id NOT IN (SELECT vec_id FROM embeddings)
    """,
)
def _(r: Retail) -> DataFrame:
    return recommend.recommendations(_vectors(r), r.snapshot).withColumn("score", F.round("score", 6))


def _product_vectors(r: Retail) -> DataFrame:
    pairs = materialize(basket.pair_counts(r.detalles), "pairs")
    return recommend.train_vectors(pairs, r.detalles)


@query(
    "n19_stored_vectors",
    "SELECT DISTINCT producto_id AS id, 32 AS largo, TRUE AS positivo, TRUE AS guardado FROM detalle",
)
def _(r: Retail) -> DataFrame:
    """Vectors of all sold products, trained once and read from the store half an hour later."""
    store = ModelStore(r.spark, scratch_path(r.spark, "models"))
    pairs = materialize(basket.pair_counts(r.detalles), "pairs")
    first = recommend.stored_vectors(store, pairs, r.detalles, NOW)
    again = recommend.stored_vectors(store, pairs.limit(0), r.detalles.limit(0), NOW + timedelta(minutes=30))
    both = again.join(first.select("id", F.col("embedding").alias("_first")), "id")
    return both.select(
        "id", F.size("embedding").alias("largo"), F.forall("embedding", lambda x: x >= 0).alias("positivo"),
        (F.col("embedding") == F.col("_first")).alias("guardado"),
    )


@query("n19_product_vectors")
def _(r: Retail) -> DataFrame:
    return _product_vectors(r)


# ---- matching -------------------------------------------------------------


def _predictions(r: Retail) -> DataFrame:
    """Documents as images: their ten most frequent words are the ranked classes."""
    words = (
        r.table("documents")
        .select(F.col("doc_id").alias("image_id"), F.explode(F.split(F.lower("text"), r"\s+")).alias("class_name"))
        .where(F.col("class_name") != "")
    )
    counts = words.groupBy("image_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    # A document's own distinct words; the text itself is one row.
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "class_name")
    whole = Window.partitionBy("image_id")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .withColumn("probability", F.round(F.col("n") / F.sum("n").over(whole), 6))
        .where(F.col("rank") <= 10)
        .select("image_id", "rank", "class_name", "probability")
    )


def _stored_predictions(r: Retail) -> DataFrame:
    """Matching reads the predictions several times, so they are written once."""
    return materialize(_predictions(r), "predictions")


def _keywords(r: Retail) -> DataFrame:
    """Parts of the words of product names, kept with the first product that has them."""
    words = r.catalogo.select(F.col("id").alias("producto_id"), F.posexplode(F.split("nombre", " ")).alias("kw_pos", "word"))
    return (
        words.groupBy(F.substring("word", 1, 3).alias("keyword"))
        .agg(F.min(F.struct("producto_id", "kw_pos")).alias("m"))
        .select("m.producto_id", "m.kw_pos", "keyword")
    )


_PRED = r"""
, palabra AS (
  SELECT doc_id AS image_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS class_name FROM documents
), conteo AS (
  SELECT image_id, class_name, count(*) AS n FROM palabra WHERE class_name <> '' GROUP BY ALL
), prediccion AS (
  SELECT image_id, CAST(rank AS INTEGER) AS rank, class_name, probability FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, class_name) AS rank,
           round(n / sum(n) OVER (PARTITION BY image_id), 6) AS probability FROM conteo) t WHERE rank <= 10
), trozo AS (
  SELECT id AS producto_id, unnest(string_split(nombre, ' ')) AS word, unnest(range(len(string_split(nombre, ' ')))) AS kw_pos FROM producto
), clave AS (
  SELECT keyword, CAST(m // 100 AS BIGINT) AS producto_id, CAST(m % 100 AS INTEGER) AS kw_pos FROM (
    SELECT word[1:3] AS keyword, min(producto_id * 100 + kw_pos) AS m FROM trozo GROUP BY 1) t
), acierto AS (
  SELECT c.class_name, k.keyword, k.producto_id, k.kw_pos
  FROM (SELECT DISTINCT class_name FROM prediccion) c JOIN clave k ON contains(c.class_name, k.keyword)
), primero AS (
  SELECT image_id, rank, p.class_name, probability, producto_id, kw_pos FROM (
    SELECT p.*, a.producto_id, a.kw_pos, row_number() OVER (
      PARTITION BY image_id ORDER BY rank, a.producto_id, a.kw_pos) AS n
    FROM prediccion p JOIN acierto a USING (class_name)) p WHERE n = 1
)
"""


@query("j8_keyword_hits", _PRED + "SELECT class_name, keyword, producto_id, kw_pos FROM acierto")
def _(r: Retail) -> DataFrame:
    return matching.keyword_hits(_stored_predictions(r).select("class_name").distinct(), _keywords(r))


@query("w6_first_match", _PRED + "SELECT image_id, rank, class_name, probability, producto_id, kw_pos FROM primero")
def _(r: Retail) -> DataFrame:
    return matching.first_matches(_stored_predictions(r), _keywords(r))


@query("k5_raw_classes", _PRED + "SELECT image_id, rank, class_name, probability FROM prediccion WHERE rank <= 5")
def _(r: Retail) -> DataFrame:
    return matching.raw_classes(_predictions(r))


@query(
    "n23_identify",
    _PRED
    + """
    SELECT i.image_id, f.producto_id IS NOT NULL AS success, f.producto_id, s.nombre, s.categoria, f.probability AS confianza
    FROM (SELECT DISTINCT image_id FROM prediccion) i LEFT JOIN primero f USING (image_id)
    LEFT JOIN snapshot s ON s.id = f.producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    return matching.identify(_stored_predictions(r), _keywords(r), r.snapshot).drop("mensaje")


_METHODS = """
, metodo AS (
  SELECT producto_id, CASE WHEN count(*) >= 18 THEN 'LSTM' ELSE 'Simulado' END AS metodo FROM serie GROUP BY producto_id
)
"""


@query(
    "n15_forecast_bounds",
    _METHODS
    + """
    SELECT producto_id, metodo, 7::BIGINT AS dias, TRUE AS dentro, CASE metodo WHEN 'Simulado' THEN 0.5::DOUBLE END AS confianza
    FROM metodo
    """,
)
def _(r: Retail) -> DataFrame:
    """Method and days of each forecast; simple ones vary by at most 15 % around the mean of the last seven points."""
    series_ = _series(r)
    values = materialize(forecast.forecast(series_, epochs=2), "forecast")
    base = series.last_points(series_).groupBy("producto_id").agg((F.sum("cantidad") / F.lit(7)).alias("base"))
    low, high = (F.greatest(F.lit(1), F.floor(F.col("base") * share)) for share in (0.85, 1.15))
    inside = (F.col("metodo") == series.LSTM) | F.col("valor").between(low, high)
    checked = values.join(base, "producto_id").groupBy("producto_id").agg(
        F.first("metodo").alias("metodo"), F.count(F.lit(1)).alias("dias"), F.bool_and(inside).alias("dentro")
    )
    summary = series.forecast_summary(values).select("producto_id", F.col("confianza").alias("_c"))
    return checked.join(summary, "producto_id").select(
        "producto_id", "metodo", "dias", "dentro", F.when(F.col("metodo") == series.SIMPLE, F.col("_c")).alias("confianza")
    )


# A sold product has a vector, and so as many related products as there are others, up to four;
# a product never sold has the first of its category.
_IDENTIFIED = (
    _PRED
    + """
, metodo AS (
  SELECT producto_id, CASE WHEN count(*) >= 18 THEN 'LSTM' ELSE 'Simulado' END AS metodo FROM serie GROUP BY producto_id
), vendido AS (
  SELECT DISTINCT producto_id FROM detalle
), cuenta AS (
  SELECT s.id AS producto_id, CAST(least(4, CASE WHEN v.producto_id IS NOT NULL AND (SELECT count(*) FROM vendido) > 1
           THEN (SELECT count(*) FROM vendido) - 1 ELSE count(*) OVER (PARTITION BY s.categoria) - 1 END) AS INTEGER) AS relacionados
  FROM snapshot s LEFT JOIN vendido v ON v.producto_id = s.id
), imagen AS (
  SELECT image_id, CAST(least(5, count(*)) AS INTEGER) AS clases FROM prediccion GROUP BY image_id
)
"""
)


@query(
    "n24_identified_products",
    _IDENTIFIED
    + f"""
    SELECT image_id, f.producto_id IS NOT NULL AS success, f.producto_id, metodo, coalesce(relacionados, 0) AS relacionados, clases,
           CASE WHEN f.producto_id IS NULL THEN '{matching.NOT_FOUND}'
                ELSE format('{matching.FOUND.replace("%%", "%").replace("%s", "{}").replace("%.1f", "{:.1f}").replace("%.2f", "{:.2f}")}', s.nombre, round(f.probability * 100, 1)) END AS mensaje
    FROM imagen LEFT JOIN primero f USING (image_id) LEFT JOIN snapshot s ON s.id = f.producto_id
    LEFT JOIN metodo m ON m.producto_id = f.producto_id LEFT JOIN cuenta c ON c.producto_id = f.producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    """Forecasts and lists are made for the products that some image shows; the vectors are those of all products."""
    predictions = _stored_predictions(r)
    shown = matching.first_matches(predictions, _keywords(r)).select("producto_id").distinct()
    shown = materialize(shown, "shown")
    values = materialize(forecast.forecast(_series(r).join(shown, "producto_id", "left_semi")), "forecast")
    asked = shown.select(F.col("producto_id").alias("id"))
    related = materialize(recommend.recommendations(_product_vectors(r), r.snapshot, asked=asked), "related")
    out = identified_products(predictions, _keywords(r), r.snapshot, values, related)
    return out.select(
        "image_id",
        "success",
        F.col("producto.producto_id").alias("producto_id"),
        F.col("prediccion_ventas.metodo").alias("metodo"),
        F.size("productos_relacionados").alias("relacionados"),
        F.size("predicciones_raw").alias("clases"),
        "mensaje",
    )


# ---- registry and caches --------------------------------------------------


def _runs(r: Retail) -> DataFrame:
    """Events as training runs of three models, one of them never trained."""
    name = F.when(F.col("event_type") == "view", registry.MODELS[0]).when(F.col("event_type") == "click", registry.MODELS[1])
    return r.table("events").where(name.isNotNull()).select(
        name.alias("model_name"),
        F.col("ts").alias("trained_at"),
        F.round("value", 2).alias("accuracy"),
        F.col("event_id").alias("samples_count"),
        F.array(F.lit("stock")).alias("features"),
    )


@query(
    "n25_model_registry",
    """
    WITH run AS (
      SELECT CASE event_type WHEN 'view' THEN 'price_predictor' WHEN 'click' THEN 'customer_segmentation' END AS model_name,
             ts, round(value, 2) AS accuracy, event_id FROM events WHERE event_type IN ('view', 'click')
    ), last AS (
      SELECT model_name, arg_max(accuracy, ts) AS accuracy, arg_max(event_id, ts) AS samples_count,
             CAST(max(ts) AS DATE) AS trained_on FROM run GROUP BY 1
    )
    SELECT m.model_name, trained_on, accuracy, coalesce(samples_count, 0) AS samples_count,
           CASE WHEN accuracy IS NULL THEN '' ELSE 'stock' END AS features
    FROM (VALUES ('price_predictor'), ('customer_segmentation'), ('anomaly_detector')) m(model_name) LEFT JOIN last USING (model_name)
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return registry.model_info(registry.register_model(_runs(r).limit(0), _runs(r))).select(
        "model_name",
        F.to_date("trained_at").alias("trained_on"),
        "accuracy",
        "samples_count",
        F.concat_ws(",", "features").alias("features"),
    )


@query("n26_reused_result", """
    , ultimo AS (SELECT *, row_number() OVER (PARTITION BY producto_id ORDER BY seq DESC) AS atras FROM serie)
    SELECT producto_id, CAST(p AS INTEGER) AS paso, greatest(1, CAST(floor(base) AS BIGINT)) AS valor
    FROM (SELECT producto_id, sum(cantidad) / 7.0::DOUBLE AS base FROM ultimo WHERE atras <= 7 GROUP BY 1) b, range(1, 8) t(p)
    """)
def _(r: Retail) -> DataFrame:
    store = ModelStore(r.spark, scratch_path(r.spark, "reuse"))

    def train():
        return {"valores": series.simple_forecast(r.serie)}, {}

    store.train_or_load("forecast", NOW, train)
    # Half an hour later the stored result is read, not computed.
    return store.train_or_load("forecast", NOW + timedelta(minutes=30), train).table("valores")


def _requests(r: Retail) -> DataFrame:
    asked = r.table("events").select("event_id", "user_id", "event_type")
    return asked.withColumn("key", registry.input_key("user_id", "event_type"))


def _answers(r: Retail) -> DataFrame:
    """Answers cached for purchases, each valid for its value in hours."""
    hours = F.make_dt_interval(F.lit(0), F.col("value").cast("int"))
    rows = r.table("events").where("event_type = 'purchase'")
    return (
        rows.select(
            registry.input_key("user_id", "event_type").alias("key"),
            F.col("props").alias("payload"),
            F.col("ts").alias("created_at"),
            (F.col("ts") + hours).alias("valid_until"),
        )
        .groupBy("key")
        .agg(F.max_by(F.struct("payload", "created_at", "valid_until"), "valid_until").alias("c"))
        .select("key", "c.*")
    )


@query(
    "n27_not_cached",
    f"""
    WITH guardado AS (
      SELECT user_id, event_type, max(ts + to_hours(CAST(trunc(value) AS BIGINT))) AS valid_until
      FROM events WHERE event_type = 'purchase' GROUP BY 1, 2
    )
    SELECT event_id, sha256('{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}') AS key FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM guardado g WHERE g.user_id = e.user_id AND g.event_type = e.event_type
                      AND g.valid_until >= {_AS_OF})
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return registry.not_cached(_requests(r), _answers(r), at(AS_OF)).select("event_id", "key")


@query(
    "n27_cache_after",
    f"""
    WITH pedido AS (
      SELECT DISTINCT user_id, event_type, sha256('{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}') AS key FROM events
    ), guardado AS (
      SELECT user_id, event_type, max(ts + to_hours(CAST(trunc(value) AS BIGINT))) AS valid_until
      FROM events WHERE event_type = 'purchase' GROUP BY 1, 2
    )
    SELECT key, coalesce(valid_until >= {_AS_OF}, false) AS antigua FROM pedido LEFT JOIN guardado USING (user_id, event_type)
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    cache = _answers(r)
    missing = registry.not_cached(_requests(r), cache, at(AS_OF))
    computed = missing.groupBy("key").agg(F.max("event_type").alias("payload"))
    after = registry.add_to_cache(cache, computed, at(AS_OF))
    return after.select("key", F.col("payload").startswith("{").alias("antigua"))


@query(
    "n28_feature_store",
    """
    , viejo AS (
      SELECT 'cliente' AS entity_type, c_custkey AS entity_id, '1.0' AS version,
             '{"segmento":"' || c_mktsegment || '"}' AS features FROM customer
    ), nuevo AS (
      SELECT 'cliente', cliente_id, '1.0', '{"frecuencia":' || frecuencia || ',"nombre":"' || nombre || '"}' FROM metrica
    )
    SELECT * FROM nuevo AS n(entity_type, entity_id, version, features)
    UNION ALL SELECT * FROM viejo WHERE entity_id NOT IN (SELECT cliente_id FROM metrica)
    """,
)
def _(r: Retail) -> DataFrame:
    old = registry.feature_rows(r.table("customer").withColumnRenamed("c_mktsegment", "segmento"), "cliente", "c_custkey", ["segmento"], F.lit(NOW))
    new = registry.feature_rows(r.metricas, "cliente", "cliente_id", ["frecuencia", "nombre"], F.lit(NOW))
    return registry.store_features(old, new).drop("computed_at")


# ---- refresh --------------------------------------------------------------


def _synced(r: Retail) -> str:
    root = scratch_path(r.spark, "snapshot")
    sync(r.spark, r.productos, r.categorias, r.ventas_base, r.detalles, root, NOW)
    return root


@query(
    "s7_full_refresh",
    """
    SELECT 'productos' AS tipo, count(*) AS num_registros FROM snapshot UNION ALL SELECT 'ventas', count(*) FROM venta
    UNION ALL SELECT 'clientes', count(*) FROM metrica
    """,
)
def _(r: Retail) -> DataFrame:
    return audit_log(r.spark, _synced(r)).select("tipo", "num_registros")


@query(
    "s8_sync_audit",
    """
    SELECT 'productos' AS tipo, count(*) AS num_registros, 'EXITOSA' AS estado, DATE '2024-01-25' AS dia FROM snapshot
    UNION ALL SELECT 'ventas', count(*), 'EXITOSA', DATE '2024-01-25' FROM venta
    UNION ALL SELECT 'clientes', count(*), 'EXITOSA', DATE '2024-01-25' FROM metrica
    """,
)
def _(r: Retail) -> DataFrame:
    log = audit_log(r.spark, _synced(r))
    return log.select("tipo", "num_registros", "estado", F.to_date("fecha_sincronizacion").alias("dia"))


_PURCHASES = """
SELECT user_id AS cliente_id, 'Cliente ' || user_id AS nombre,
       CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total_compras, count(*) AS frecuencia,
       CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS ticket_promedio
FROM events WHERE event_type = 'purchase' GROUP BY user_id
"""


@query("t1_incremental_refresh", _PURCHASES, views=False)
def _(r: Retail) -> DataFrame:
    """Events arrive as several files, each a micro-batch of its own."""
    root = scratch_path(r.spark, "refresh")
    r.table("events").repartitionByRange(4, "event_id").write.parquet(f"{root}/arrived")
    stream = refresh.purchase_stream(r.spark, f"{root}/arrived", SOURCES["events"], "*.parquet", files_per_batch=1)
    refresh.start_refresh(stream, root, buckets=32).awaitTermination()
    return refresh.refreshed_metrics(r.spark, root)
