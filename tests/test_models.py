"""Forecasts, anomalies, clusters, prices, matching, registry and refresh."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.model import SOURCES
from basketry.operators import anomaly, forecast, matching, pricing, registry, segments, series
from basketry.session import materialize, scratch_path
from basketry.plans import bind_models  # noqa: F401
from basketry.plans.registry import QUERIES
from basketry.sources import images, snapshots
from basketry.streaming import refresh


def _daily(spark, sizes):
    rows = [
        (p, date.fromordinal(730_000 + i), 20 + round(10 * np.sin(i / 2)) + p % 3)
        for p, n in sizes.items()
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "producto_id bigint, dia date, cantidad bigint")
    return materialize(series.demand_series(df), "series")


def test_forecast_regimes(spark):
    got = forecast.forecast(_daily(spark, {1: 1, 2: 13, 3: 14, 4: 17, 5: 18, 6: 40}), epochs=2)
    methods = {r["producto_id"]: (r["metodo"], r["n"]) for r in got.groupBy("producto_id", "metodo").agg(F.count("*").alias("n")).collect()}
    assert methods == {p: (series.SIMPLE if p < 5 else series.LSTM, 7) for p in range(1, 7)}


def test_identified_products_train_no_others(spark, small, monkeypatch):
    """Of all products sold, only those some image shows are forecast; each has its list."""
    given, train = [], forecast.forecast
    monkeypatch.setattr(forecast, "forecast", lambda s: given.append({r[0] for r in s.select("producto_id").distinct().collect()}) or train(s, epochs=1))
    out = QUERIES["n24_identified_products"](spark, small).collect()
    shown = {r["producto_id"] for r in out if r["success"]}
    assert shown and given[0] <= shown
    assert all(r["relacionados"] > 0 for r in out if r["success"])


def test_forecast_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    values = [rng.integers(1, 50, size=n).astype(float) for n in (18, 25, 40)]
    ids = np.array([7, 8, 9])
    together = forecast._train_group(ids, values, 3)
    alone = np.concatenate([forecast._train_group(ids[k : k + 1], values[k : k + 1], 3) for k in range(3)])
    assert (together == alone).all()


def test_forecast_learns_a_cycle():
    wave = np.round(50 + 30 * np.sin(np.arange(120) * 2 * np.pi / 7))
    got = forecast._train_group(np.array([1]), [wave[:113]], 150)[0]
    assert np.abs(got - wave[113:]).mean() < 8


def test_gradients_match_differences():
    ids = np.array([3, 4])
    w = forecast._start(ids)
    rng = np.random.default_rng(0)
    x, y = rng.uniform(size=(2, 5, 7)), rng.uniform(size=(2, 5, 16))

    def loss():
        h, _ = forecast._forward(w, x)
        return ((h - y) ** 2).sum(axis=(1, 2))

    h, trace = forecast._forward(w, x)
    grads = forecast._backward(w, x, trace, 2 * (h - y))
    for name in ("wx", "wh", "b"):
        at = (slice(None), *(s // 2 for s in w[name].shape[1:]))
        w[name][at] += 1e-6
        up = loss()
        w[name][at] -= 2e-6
        down = loss()
        w[name][at] += 1e-6
        assert grads[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def _sales(spark, n=600):
    rng = np.random.default_rng(2)
    rows = [(i, date(2025, 1, 1), float(rng.normal(100, 10)), int(rng.integers(2, 6))) for i in range(n)]
    rows += [(9001, date(2025, 1, 2), 5000.0, 60), (9002, date(2025, 1, 2), 5.0, 0)]
    df = spark.createDataFrame(rows, "id bigint, fecha date, total double, num_productos bigint")
    return anomaly.sale_features(df)


def test_planted_outliers_come_first(spark):
    flagged = anomaly.detect_anomalies(_sales(spark))
    report = anomaly.anomaly_list(flagged).collect()
    assert {r["venta_id"] for r in report[:2]} == {9001, 9002}
    by = {r["venta_id"]: r for r in report}
    assert by[9001]["razon"] == "Total muy alto | Muchos productos | Ticket promedio alto"
    assert by[9002]["razon"] == "Total muy bajo | Sin productos"
    assert all(-1 <= r["score_anomalia"] < 0 and r["gravedad"] == "error" for r in report)
    counts = anomaly.anomaly_counts(flagged).first()
    assert 5 <= counts["porcentaje"] <= 20 and counts["total_ventas_analizadas"] == 602
    again = {r["venta_id"]: r["score"] for r in anomaly.detect_anomalies(_sales(spark)).collect()}
    assert again == {r["venta_id"]: r["score"] for r in flagged.collect()}


def test_sample_is_bounded(spark):
    features = materialize(_sales(spark, 3000), "f")
    sizes = [r["count"] for r in anomaly._sampled(features, 3002, 20, 1).groupBy("tree").count().collect()]
    assert sizes == [256] * 20


def test_too_few_sales(spark):
    assert anomaly.detect_anomalies(_sales(spark, 10)) is None


def test_clusters_are_named_by_ticket(spark):
    rows = [(i, f"c{i}", t * n, n, t) for i, (t, n) in enumerate([(5.0, 1)] * 30 + [(20.0, 3)] * 20 + [(90.0, 9)] * 10)]
    metrics = spark.createDataFrame(
        rows, "cliente_id bigint, nombre string, total_compras double, frecuencia bigint, ticket_promedio double"
    )
    clustered = segments.cluster_customers(metrics, restarts=3)
    named = segments.name_clusters(clustered)
    got = {r["segmento"]: (r["n"], r["t"]) for r in named.groupBy("segmento").agg(F.count("*").alias("n"), F.avg("ticket_promedio").alias("t")).collect()}
    assert got == {"VIP": (10, 90.0), "Regular": (20, 20.0), "Ocasional": (30, 5.0)}
    assert segments.cluster_customers(metrics.limit(4)) is None


def test_price_model(spark):
    rows = [(i, "n" * (3 + i % 5), c, 1.0 + 2 * k + 0.5 * (i % 11) + 3 * (3 + i % 5), i % 11) for i in range(60) for k, c in [(i % 3, "abc"[i % 3])]]
    snapshot = spark.createDataFrame(rows, "id bigint, nombre string, categoria string, precio double, stock int")
    model = pricing.train_prices(snapshot)
    assert model.r2 == pytest.approx(1.0)
    asked = spark.createDataFrame([("c", 4, "pan"), ("zz", 4, "pan")], "categoria string, stock int, nombre string")
    got = {r["categoria"]: (r["precio_sugerido"], r["confianza"]) for r in pricing.suggest_prices(model, asked).collect()}
    assert got == {"c": (16.0, 0.85), "zz": (14.0, 0.85)}
    assert pricing.train_prices(snapshot.limit(9)) is None


def test_request_without_stock_stays_unpriced(spark):
    rows = [(i, "n" * (3 + i % 5), "abc"[i % 3], 1.0 + i % 11, i % 11) for i in range(60)]
    model = pricing.train_prices(spark.createDataFrame(rows, "id bigint, nombre string, categoria string, precio double, stock int"))
    asked = spark.createDataFrame([(1, "c", 4, "pan"), (2, "c", None, "pan")], "id bigint, categoria string, stock int, nombre string")
    got = {r["id"]: (r["precio_sugerido"], r["confianza"]) for r in pricing.suggest_prices(model, asked).collect()}
    assert set(got) == {1, 2} and got[1][0] is not None and got[2] == (None, None)


KEYWORDS = [(24, 0, "apple"), (24, 1, "Granny Smith"), (25, 0, "banana"), (29, 0, "pineapple"), (8, 0, "can")]


@pytest.mark.parametrize(
    ("labels", "product", "confidence"),
    [
        ([("banana", 0.988)], 25, 0.988),
        ([("pineapple", 0.7)], 24, 0.7),
        ([("volcano", 0.9)], 8, 0.9),  # "can" is a part of it
        ([("obelisk", 0.9), ("fountain", 0.1)], None, None),
        ([("Volcanic rock", 0.9), ("BANANA", 0.05)], 8, 0.9),
        ([("desk", 0.9), ("granny smith apple", 0.05)], 24, 0.05),
        ([("desk", 0.9)], None, None),
    ],
)
def test_label_matching(spark, labels, product, confidence):
    predictions = spark.createDataFrame(
        [("i", k + 1, c, p) for k, (c, p) in enumerate(labels)], "image_id string, rank int, class_name string, probability double"
    )
    keywords = spark.createDataFrame(KEYWORDS, "producto_id bigint, kw_pos int, keyword string")
    names = spark.createDataFrame([(p, f"p{p}", "c") for p in (8, 24, 25, 29)], "id bigint, nombre string, categoria string")
    row = matching.identify(predictions, keywords, names).first()
    assert (row["producto_id"], row["confianza"], row["success"]) == (product, confidence, product is not None)
    if product is None:
        assert row["mensaje"] == matching.NOT_FOUND
    else:
        assert row["mensaje"] == f"✅ Producto identificado: p{product} ({confidence * 100:.1f}% confianza)"


def test_name_search(spark):
    names = spark.createDataFrame([(3, "Plátano kg"), (1, "Leche"), (9, "PLATANO verde")], "id bigint, nombre string")
    got = {r["termino"]: r["id"] for r in matching.search_by_name(names, ["platano", " LÉCHE ", "pan"]).collect()}
    assert got == {"platano": 3, " LÉCHE ": 1, "pan": None}


def test_registry_and_reuse(spark):
    at = datetime(2025, 1, 1, 12)
    runs = registry.training_run(spark, "price_predictor", at, 0.9, 46, ["stock"]).unionByName(
        registry.training_run(spark, "price_predictor", at + timedelta(hours=1), 0.8, 47, ["stock"])
    )
    info = {r["model_name"]: (r["accuracy"], r["samples_count"], r["features"]) for r in registry.model_info(runs).collect()}
    assert info == {
        "price_predictor": (0.8, 47, ["stock"]),
        "customer_segmentation": (None, 0, []),
        "anomaly_detector": (None, 0, []),
    }


def test_images(spark, tmp_path):
    for name, data in {"a.JPG": b"x", "b.png": b"x", "c.gif": b"yy", "d.pdf": b"x", "e.webp": b"z" * 50}.items():
        (tmp_path / name).write_bytes(data)
    files = images.accepted(images.read_images(spark, str(tmp_path)), limit=10)
    assert sorted(r["path"][-5:] for r in files.collect()) == ["a.JPG", "b.png", "c.gif"]
    unique = images.first_of_each(files, "path").collect()
    assert sorted(r["copias"] for r in unique) == [1, 2]


def test_incremental_refresh_equals_batch(spark, tmp_path):
    folder, root = tmp_path / "in", scratch_path(spark, "refresh")
    folder.mkdir()
    schema = SOURCES["events"]

    def arrive(name, users):
        pdf = pd.DataFrame(
            {
                "event_id": range(len(users)),
                "ts": pd.Timestamp("2025-01-01"),
                "user_id": users,
                "event_type": ["purchase"] * (len(users) - 1) + ["view"],
                "value": [1.25 * (i + 1) for i in range(len(users))],
                "props": "{}",
            }
        )
        pdf["ts"] = pdf["ts"].astype("datetime64[us]")
        pdf.to_parquet(folder / f"{name}.parquet")

    for step, users in enumerate([[1, 2, 2, 3], [2, 4, 1], [1] * 9]):
        arrive(f"f{step}", users)
        stream = refresh.purchase_stream(spark, str(folder), schema, "*.parquet")
        refresh.start_refresh(stream, root).awaitTermination()
        sales = refresh.purchases(spark.read.schema(schema).parquet(str(folder)))
        want = refresh.metrics_of(refresh.batch_state(sales))
        got = refresh.refreshed_metrics(spark, root)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert X.CUSTOMER_PREFIX + "1" in {r["nombre"] for r in got.collect()}


def test_lstm_gradient_in_reused_arrays():
    """The gradient of the cell, also where gates are at their bounds, against differences; arrays are used twice."""
    rng = np.random.default_rng(3)
    ids = np.arange(3)
    for scale in (1.0, 9.0):
        cell = forecast._start(ids)["cell"] * scale
        run, x = forecast._Cell(3, 5), rng.random((3, 5, forecast.SEQUENCE_LENGTH))
        run.forward(cell, x[::-1])
        pull = rng.random((3, forecast.UNITS, 5))
        run.forward(cell, x)
        assert all(run.open) == (scale == 1.0)
        grads = np.empty_like(cell)
        run.backward(cell, pull, grads)
        for unit, taken in [(0, 0), (17, 4), (40, 17), (60, 9)]:
            ends = []
            for step in (1e-6, -1e-6):
                moved = cell.copy()
                moved[:, unit, taken] += step
                ends.append((run.forward(moved, x)[:, :-1] * pull).sum(axis=(1, 2)))
            assert np.allclose((ends[0] - ends[1]) / 2e-6, grads[:, unit, taken], atol=1e-6)
