"""Pointers, snapshots, stored models, and keyed tables in buckets."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketry.functions.quantiles import exact_quantiles
from basketry.operators import anomaly, mutations, pricing, registry, segments
from basketry.operators.model_store import ModelStore
from basketry.plans import sync
from basketry.session import materialize, scratch_path
from basketry.sources import pointer, snapshots
from basketry.sources.buckets import KeyedTable, Overtaken
from basketry.streaming import refresh

AT = datetime(2025, 1, 1)


def test_pointer_moves_only_forward(spark):
    path = scratch_path(spark, "pointer")
    assert pointer.latest(spark, path) is None
    first = pointer.move(spark, path, {"v": "ä"}, None)
    assert pointer.latest(spark, path) == first and first.content == {"v": "ä"}
    assert pointer.move(spark, path, {"v": 2}, None) is None
    second = pointer.move(spark, path, {"v": 2}, first)
    assert pointer.move(spark, path, {"v": 3}, first) is None
    assert pointer.latest(spark, path) == second
    # A writer that died leaves an unfinished file: it takes a number, but does not hold.
    pointer.Folder(spark, path).create(f"{second.number + 1:012d}", '{"v"')
    assert pointer.latest(spark, path) == second
    third = pointer.move(spark, path, {"v": 4}, second)
    assert third.number == second.number + 2 and pointer.latest(spark, path) == third
    assert not pointer.Folder(spark, path).create(f"{third.number:012d}", "{}\n")


def test_snapshot_refuses_an_empty_extract(spark):
    root = scratch_path(spark, "snap")
    _, counts = snapshots.full_refresh(spark, {"a": spark.range(3)}, root, AT)
    assert counts == {"a": 3}
    with pytest.raises(snapshots.EmptyExtract):
        snapshots.full_refresh(spark, {"a": spark.range(0)}, root, AT)
    assert snapshots.read_snapshot(spark, root, "a").count() == 3
    snapshots.full_refresh(spark, {"a": spark.range(5)}, root, AT)  # at the same time: the later one holds
    assert snapshots.read_snapshot(spark, root, "a").count() == 5
    assert sorted(r["estado"] for r in snapshots.audit_log(spark, root).collect()) == [snapshots.OK, snapshots.OK, snapshots.FAILED]


def test_failed_table_is_audited(spark):
    root = scratch_path(spark, "snap")
    snapshots.full_refresh(spark, {"a": spark.range(3), "b": spark.range(4)}, root, AT)
    broken = spark.range(4).select(F.raise_error(F.lit("disk gone")).cast("long").alias("id"))
    with pytest.raises(Exception, match="disk gone"):
        snapshots.full_refresh(spark, {"a": spark.range(7), "b": broken}, root, AT + timedelta(days=1))
    rows = snapshots.audit_log(spark, root).where(F.col("fecha_sincronizacion") > F.lit(AT)).collect()
    got = {r["tipo"]: (r["num_registros"], r["estado"]) for r in rows}
    assert got == {"a": (7, snapshots.OK), "b": (0, snapshots.FAILED)}
    assert all(r["duracion_ms"] >= 0 for r in rows) and any("disk gone" in (r["mensaje"] or "") for r in rows)
    assert snapshots.read_snapshot(spark, root, "a").count() == 3


def test_second_stage_needs_its_first(spark):
    root = scratch_path(spark, "snap")
    entry, _ = snapshots.full_refresh(spark, {"a": spark.range(3), "b": spark.range(4)}, root, AT)
    staged, _ = snapshots.replace_tables(spark, {"a": spark.range(9)}, root, AT, entry)
    assert [snapshots.read_snapshot(spark, root, n).count() for n in "ab"] == [9, 4]
    assert snapshots.read_snapshot(spark, root, "a", entry).count() == 3
    with pytest.raises(snapshots.Superseded):
        snapshots.replace_tables(spark, {"a": spark.range(1)}, root, AT, entry)
    assert snapshots.current(spark, root) == staged


def test_model_is_reused_for_an_hour(spark):
    store, calls = ModelStore(spark, scratch_path(spark, "models")), []

    def train():
        calls.append(1)
        return {"t": spark.range(len(calls))}, {"n": len(calls)}

    got = [store.train_or_load("m", AT + timedelta(minutes=m), train) for m in (0, 59, 61)]
    assert [(g.table("t").count(), g.info["n"]) for g in got] == [(1, 1), (1, 1), (2, 2)]
    assert store.fresh("m", AT) is None  # trained later than that
    assert store.train_or_load("none", AT, lambda: None) is None
    store.save("m", AT + timedelta(minutes=61), {"t": spark.range(8)}, {"n": 0})
    assert store.latest("m").table("t").count() == 8


def _snapshot(spark, weight):
    rows = [(i, "n" * (3 + i % 5), "abc"[i % 3], 1.0 + weight * (i % 3) + 0.5 * (i % 11) + 3 * (3 + i % 5), i % 11) for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, nombre string, categoria string, precio double, stock int")


def test_stored_prices_are_those_of_the_stored_model(spark):
    store = ModelStore(spark, scratch_path(spark, "models"))
    asked = spark.createDataFrame([("c", 4, "pan"), ("zz", 4, "pan"), ("c", None, "pan")], "categoria string, stock int, nombre string")

    def prices(weight, at):
        model = pricing.price_model(store, _snapshot(spark, weight), at)
        return [r["precio_sugerido"] for r in pricing.suggest_prices(model, asked).orderBy("categoria", F.asc_nulls_last("stock")).collect()]

    assert prices(2, AT) == [16.0, None, 14.0]
    assert prices(7, AT + timedelta(minutes=30)) == [16.0, None, 14.0]
    assert prices(7, AT + timedelta(hours=2)) == [26.0, None, 19.0]


def test_training_reports_skipped_products(spark):
    gaps = spark.createDataFrame([(100, "x", "a", None, 1), (101, None, "a", 2.0, 1), (102, "x", None, 2.0, 1), (103, "x", "a", 2.0, None)], _snapshot(spark, 2).schema)
    model = pricing.train_prices(_snapshot(spark, 2).union(gaps))
    assert (model.samples, model.skipped) == (60, 4) and model.r2 == pytest.approx(1.0)


METRICS = "cliente_id bigint, nombre string, total_compras double, frecuencia bigint, ticket_promedio double"


def _customers(spark):
    rows = [(i, f"c{i}", t * n, n, t) for i, (t, n) in enumerate([(5.0, 1)] * 30 + [(20.0, 3)] * 20 + [(90.0, 9)] * 10)]
    return spark.createDataFrame(rows, METRICS)


def test_stored_segments_label_new_customers(spark):
    store = ModelStore(spark, scratch_path(spark, "models"))
    segments.segment_model(store, _customers(spark), AT, restarts=3)
    model = segments.segment_model(store, _customers(spark).limit(0), AT + timedelta(minutes=5))
    fresh = spark.createDataFrame([(900, "x", 80.0 * 9, 9, 80.0), (901, "y", 6.0, 1, 6.0)], METRICS)
    assert {r["cliente_id"]: r["segmento"] for r in model.label(fresh).collect()} == {900: "VIP", 901: "Ocasional"}
    assert segments.train_segments(_customers(spark).limit(4)) is None


def test_rounds_of_kmeans_are_a_parameter(spark):
    one = segments.train_segments(_customers(spark), restarts=1, rounds=1).pipeline.stages[-1]
    many = segments.train_segments(_customers(spark), restarts=1).pipeline.stages[-1]
    assert one.getMaxIter() == 1 and many.getMaxIter() == segments.ROUNDS == 300


def _sales(spark, n, level):
    rows = [(i, level + (i * 37 % 101) / 10, 2 + i % 4) for i in range(n)]
    return anomaly.sale_features(spark.createDataFrame(rows, "id bigint, total double, num_productos bigint").withColumn("fecha", F.lit("2025-01-01")))


def test_stored_bound_does_not_force_a_share(spark):
    store = ModelStore(spark, scratch_path(spark, "models"))
    seen = materialize(_sales(spark, 400, 100.0), "f")
    model = anomaly.detector(store, seen, AT, trees=30)
    share = model.flag(seen).agg(F.avg(F.col("es_anomalia").cast("int"))).first()[0]
    assert 0.05 <= share <= 0.1
    again = anomaly.detector(store, seen.limit(0), AT + timedelta(minutes=10))
    assert again.training == model.training
    odd = again.flag(_sales(spark, 100, 900.0))
    assert odd.where("es_anomalia").count() == 100
    report = anomaly.drift_report(again, odd).first()
    assert (report["ventas"], report["proporcion"], report["proporcion_entrenamiento"]) == (100, 1.0, 0.1)
    assert report["total_entrenamiento"] < 120 < 800 < report["total_medio"]
    assert anomaly.detector(ModelStore(spark, scratch_path(spark, "models")), seen.limit(10), AT) is None


def test_refresh_publishes_clusters_only_over_its_own_snapshot(spark):
    productos = spark.createDataFrame(
        [(i, f"p{i}", "d", 1.0 + i % 7, i % 5, 1 + i % 2) for i in range(12)], "id bigint, nombre string, descripcion string, precio double, stock int, categoria_id bigint"
    )
    categorias = spark.createDataFrame([(1, "a", ""), (2, "b", "")], "id bigint, nombre string, descripcion string")
    ventas = spark.createDataFrame([(i, i % 9) for i in range(40)], "id bigint, cliente_id bigint").withColumn("fecha", F.lit(AT).cast("timestamp_ntz"))
    detalles = spark.createDataFrame(
        [(i, i % 12, 1, 1 + i % 9, 1.0 + (i % 9) ** 2) for i in range(40)], "venta_id bigint, producto_id bigint, linea int, cantidad int, precio_unitario double"
    )
    root, store = scratch_path(spark, "snap"), ModelStore(spark, scratch_path(spark, "models"))
    entry, models = sync.sync_and_train(spark, productos, categorias, ventas, detalles, root, store, AT, restarts=2)
    named = {r["cliente_id"]: r["segmento"] for r in snapshots.read_snapshot(spark, root, "clientes").collect()}
    want = {r["cliente_id"]: r["segmento"] for r in models.segments.label(snapshots.read_snapshot(spark, root, "clientes")).collect()}
    assert named == want and set(named.values()) == {"VIP", "Regular", "Ocasional"}
    info = {r["model_name"]: r["samples_count"] for r in registry.model_info(models.runs(spark, AT)).collect()}
    assert info == {"price_predictor": 12, "customer_segmentation": 9, "anomaly_detector": 40}
    first, _ = sync.sync(spark, productos, categorias, ventas, detalles, root, AT)
    sync.sync(spark, productos, categorias, ventas, detalles, root, AT)
    with pytest.raises(snapshots.Superseded):
        sync.publish_segments(spark, root, models.segments, AT, first)


def test_keyed_table_rewrites_touched_buckets_only(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), "k bigint, v string", ["k"], buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k bigint, v string, o int")
    assert table.read().count() == 0 and table.last_change() is None
    table.upsert(rows(*[(i, "a", 0) for i in range(100)], (None, "n", 0)), ["o"], "1")
    before = table._entry().content["folders"]
    touched = table.upsert(rows((7, "b", 1), (7, "c", 2), (None, "m", 0)), ["o"], "2")
    after = table._entry().content["folders"]
    assert 1 <= len(touched) <= 2
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 101 == table.read().count() and got[7] == "c" and got[None] == "m" and got[8] == "a"
    assert table.upsert(rows((7, "z", 9)), ["o"], "2") == []  # the same change again
    assert table.read().where("v = 'z'").count() == 0
    for n in range(3, 7):
        table.upsert(rows((7, f"n{n}", 1)), ["o"], str(n))
    assert table.read().where("k = 7").first()["v"] == "n6" and table.read().count() == 101


def test_keyed_table_refuses_an_overtaken_change(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), "k bigint, v string", ["k"], buckets=4)
    rows = lambda v: spark.createDataFrame([(1, v)], "k bigint, v string")
    table.upsert(rows("a"), ["v"])

    def slow(old, new):
        table.upsert(rows("other"), ["v"])
        return new

    with pytest.raises(Overtaken):
        table.change(rows("late"), slow)
    assert [r["v"] for r in table.read().collect()] == ["other"]


def test_refresh_in_micro_batches_and_replay(spark, tmp_path):
    folder, root = str(tmp_path / "in"), scratch_path(spark, "refresh")
    events = spark.range(300).select(
        F.col("id").alias("event_id"), F.lit(AT).cast("timestamp_ntz").alias("ts"), (F.col("id") % 17).alias("user_id"),
        F.when(F.col("id") % 5 == 0, "view").otherwise("purchase").alias("event_type"), (F.col("id") * 1.25).alias("value"), F.lit("{}").alias("props"),
    )
    events.repartitionByRange(5, "event_id").write.parquet(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = refresh.purchase_stream(spark, folder, schema, "*.parquet", files_per_batch=1)
    query = refresh.start_refresh(stream, root, buckets=4)
    query.awaitTermination()
    table = refresh.state_table(spark, root)
    assert table.last_change() == "4"
    sales = refresh.purchases(events)
    want = sorted(map(tuple, refresh.batch_state(sales).collect()))
    assert sorted(map(tuple, table.read().collect())) == want
    # The last batch runs again after a failure: nothing is counted twice.
    assert table.change(refresh.batch_state(sales), refresh.merge_state, "4") == []
    assert sorted(map(tuple, table.read().collect())) == want


def test_upsert_does_not_sort_the_table(spark):
    table = materialize(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")), "t")
    batch = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (2000, "z", 1), (None, "n", 1)], "k bigint, v string, o int")
    out = mutations.upsert(table, batch, ["k"], ["o"])
    got = {r["k"]: r["v"] for r in out.collect()}
    assert len(got) == out.count() == 1002 and (got[3], got[2000], got[None], got[4]) == ("y", "z", "n", "old")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan


def test_later_features_win(spark):
    row = spark.createDataFrame([(1, 9), (1, 10)], "id bigint, n int")
    rows = registry.feature_rows(row, "c", "id", ["n"], F.lit(AT) + F.make_dt_interval(F.col("n")))
    stored = registry.store_features(rows.limit(0), rows).collect()
    assert [r["features"] for r in stored] == ['{"n":10}']  # as text, 9 would be larger


def test_quantiles_over_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    values = [-inf] * 3 + [float(i) for i in range(5000)] + [1.7e308, -1.7e308] + [inf] * 4 + [nan] * 2 + [None] * 5
    df = spark.createDataFrame([(v, 1.0) for v in values], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.0, 0.5, 0.9, 1.0])
    order = sorted((v for v in values if v is not None and v == v)) + [nan, nan]
    at = 0.5 * (len(order) - 1)
    assert got["x"][0] == -inf and got["x"][3] != got["x"][3]
    assert got["x"][1] == pytest.approx((order[int(at)] + order[-int(-at // 1)]) / 2) and got["y"] == [1.0] * 4
    assert exact_quantiles(df.where("x = double('Infinity')"), ["x"], [0.3]) == {"x": [inf]}
    assert all(v != v for v in exact_quantiles(df.limit(0), ["x"], [0.3])["x"])
