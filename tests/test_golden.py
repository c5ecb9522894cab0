"""Literal rows: totals, mutations, checks, segments and series."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.operators import customers, dashboard, mutations, quality, sales, series

LINE = "venta_id bigint, producto_id bigint, linea int, cantidad int, precio_unitario double"
SALE = "id bigint, cliente_id bigint, fecha timestamp_ntz"


@pytest.mark.parametrize(
    ("lines", "total"),
    [([(5, 10.50)], 52.50), ([(2, 5.0), (3, 3.0)], 19.0), ([(7, 3.25)], 22.75), ([(None, 3.0), (1, None), (2, 1.5)], 3.0)],
)
def test_sale_total(spark, lines, total):
    df = spark.createDataFrame([(1, 1, n, q, p) for n, (q, p) in enumerate(lines)], LINE)
    assert float(sales.sale_facts(df).first()["total"]) == total


def test_sale_without_lines_keeps_zeros(spark):
    heads = spark.createDataFrame([(1, 1, None), (2, None, None)], SALE)
    lines = spark.createDataFrame([(1, 1, 1, 2, 2.0)], LINE)
    got = {r["id"]: (float(r["total"]), r["num_productos"]) for r in sales.with_totals(heads, lines).collect()}
    assert got == {1: (4.0, 1), 2: (0.0, 0)}
    snapshot = sales.sale_snapshot(sales.with_totals(heads, lines))
    assert {r["id"]: r["cliente_id"] for r in snapshot.collect()} == {1: 1, 2: 0}


def test_large_sale_is_cut_into_parts(spark):
    heads = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, None)], SALE)
    lines = [(1, p, p, 1, 1.0) for p in range(200)] + [(2, 5, 1, 1, 1.0)]
    detalles = spark.createDataFrame(lines, LINE)
    people = spark.createDataFrame([(1, "Ana")], "id bigint, nombre string")
    products = spark.createDataFrame([(p, f"p{p}", "c") for p in range(200)], "id bigint, nombre string, categoria string")
    docs = sales.sale_documents(heads, detalles, people, products, lines_per_part=30).cache()
    parts = [(r["parte"], r["partes"], [d.linea for d in r["detalles"]]) for r in docs.where("id = 1").orderBy("parte").collect()]
    assert parts == [(k, 7, list(range(200))[30 * k : 30 * k + 30]) for k in range(7)]
    assert sorted(tuple(r) for r in docs.where("id <> 1").select("id", "parte", "partes").collect()) == [(2, 0, 1), (3, 0, 1)]
    # A limit above all sales gives the same lines in one part each.
    whole = sales.sale_documents(heads, detalles, people, products)
    assert whole.count() == 3 and whole.columns == docs.columns
    assert sales.explode_documents(docs).where("linea is not null").count() == 201


def test_line_of_unknown_product_stays_in_its_document(spark):
    heads = spark.createDataFrame([(1, 1, None)], SALE)
    detalles = spark.createDataFrame([(1, 7, 1, 1, 1.0), (1, 99, 2, 3, 2.0)], LINE)
    people = spark.createDataFrame([(1, "Ana")], "id bigint, nombre string")
    products = spark.createDataFrame([(7, "pan", "c")], "id bigint, nombre string, categoria string")
    doc = sales.sale_documents(heads, detalles, people, products).first()
    assert {(d.producto.id, d.producto.nombre, d.cantidad) for d in doc.detalles} == {(7, "pan", 1), (99, None, 3)}


def test_null_stock_and_missing_category(spark):
    products = spark.createDataFrame(
        [(1, "a", 0.01, 1, 7), (2, "b", 999.99, 9999, None), (3, "c", 5.5, None, 9)],
        "id bigint, nombre string, precio double, stock int, categoria_id bigint",
    )
    cats = spark.createDataFrame([(7, "Bebidas")], "id bigint, nombre string")
    got = {r["id"]: (r["categoria"], r["precio"], r["stock"]) for r in sales.product_snapshot(products, cats).collect()}
    assert got == {1: ("Bebidas", 0.01, 1), 2: (X.NO_CATEGORY, 999.99, 9999), 3: (X.NO_CATEGORY, 5.5, None)}


def test_top_products_merge_equal_names(spark):
    lines = spark.createDataFrame([(1, 1, 1, 2, 1.0), (1, 2, 2, 3, 1.0), (2, 3, 1, 5, 1.0), (2, 9, 2, 1, 1.0)], LINE)
    names = spark.createDataFrame([(1, "pan", "x"), (2, "pan", None), (3, "agua", "x")], "id bigint, nombre string, categoria string")
    assert [tuple(r) for r in dashboard.top_products(lines, names).collect()] == [("agua", 5), ("pan", 5), ("9", 1)]
    by = {r["categoria"]: r["ingresos"] for r in dashboard.revenue_by_category(lines, names).collect()}
    assert by == {"x": 7.0, X.NO_CATEGORY: 4.0}


def test_last_days_fill_gaps_and_null_dates(spark):
    heads = spark.createDataFrame(
        [(1, 1, datetime(2025, 3, 1, 8)), (2, 1, None), (3, 1, datetime(2025, 1, 1))], SALE
    )
    lines = spark.createDataFrame([(v, 1, 1, 1, 2.5) for v in (1, 2, 3)], LINE)
    got = {r["dia"]: r["total"] for r in dashboard.last_days(heads, lines, F.lit(date(2025, 3, 2))).collect()}
    assert len(got) == 30 and got["2025-03-01"] == 2.5 and got["2025-03-02"] == 2.5 and sum(got.values()) == 5.0


@pytest.mark.parametrize(
    ("count", "ticket", "label"),
    [(4, 25.0, "VIP"), (4, 24.9, "Regular"), (3, 99.0, "Regular"), (2, 12.0, "Regular"), (2, 11.9, "Ocasional"), (1, 500.0, "Ocasional")],
)
def test_rule_segments(spark, count, ticket, label):
    row = spark.range(1).select(customers.rule_segment(F.lit(count), F.lit(ticket)).alias("s")).first()
    assert row["s"] == label


def test_metrics_skip_customers_without_sales(spark):
    heads = spark.createDataFrame([(1, 5, None), (2, 5, None), (3, None, None)], SALE).withColumn("total", F.lit(10.0))
    got = [tuple(r) for r in customers.customer_metrics(heads).collect()]
    assert got == [(5, "Cliente 5", 20.0, 2, 10.0)]


def test_mutations(spark, rows):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id bigint, nombre string, correo string")
    batch = spark.createDataFrame([(2, None, "z"), (9, "n", "n")], table.schema)
    assert rows(mutations.update_rows(table, batch)) == [(1, "a", "x"), (2, None, "z")]
    assert rows(mutations.merge_rows(table, batch)) == [(1, "a", "x"), (2, "b", "z")]
    assert rows(mutations.unmatched(batch, table, "id", "no"))[0] == (9, "n", "n", "no")
    assert rows(mutations.insert_if_absent(table, batch, ["id"])) == [(1, "a", "x"), (2, "b", "y"), (9, "n", "n")]
    assert rows(mutations.delete_rows(table, batch)) == [(1, "a", "x")]
    fresh = spark.createDataFrame([(1_048_580, "late"), (3, "early")], "pos bigint, nombre string").withColumn("correo", F.lit("-"))
    new = mutations.insert_with_ids(table, fresh, "pos")
    assert rows(new)[2:] == [(3, "early", "-"), (4, "late", "-")]
    empty = mutations.insert_with_ids(table.limit(0), fresh, "pos")
    assert [r[0] for r in rows(empty)] == [1, 2]


def test_upsert_keeps_the_latest(spark, rows):
    table = spark.createDataFrame([("m", 1, 5.0)], "k string, at int, v double")
    batch = spark.createDataFrame([("m", 3, None), ("m", 2, 7.0), ("n", 1, 1.0)], table.schema)
    assert rows(mutations.upsert(table, batch, ["k"], ["at"])) == [("m", 3, None), ("n", 1, 1.0)]


def test_purge_restores_stock_and_empties(spark):
    products = spark.createDataFrame([(1, 5), (2, None)], "id bigint, stock int")
    lines = spark.createDataFrame([(1, 1, 1, 3, 1.0), (1, 2, 2, 4, 1.0)], LINE)
    heads = spark.createDataFrame([(1, 1, None)], SALE)
    left = mutations.purge(products, heads, heads, lines)
    assert {r["id"]: r["stock"] for r in left["restaurados"].collect()} == {1: 8, 2: None}
    assert all(left[n].count() == 0 for n in ("ventas", "detalles", "clientes", "productos"))


def test_checks(spark):
    df = spark.createDataFrame([(1.0, 1), (-1.0, -2), (None, None)], "precio double, stock int")
    good, bad = quality.split_by_rules(df, quality.product_rules())
    assert good.count() == 2
    assert bad.first()["violaciones"] == ["precio_no_negativo", "stock_no_negativo"]
    twice = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "n string")
    assert [tuple(r) for r in quality.duplicates(twice, ["n"]).collect()] == [("a", 2)]


@pytest.mark.parametrize(
    ("text", "number"), [(" 12.5 kg", 12.5), ("-3", -3.0), ("1e2x", 100.0), (".5", 0.5), ("kg 3", None), ("", None), ("7.", 7.0)]
)
def test_leading_number(spark, text, number):
    assert spark.range(1).select(X.leading_number(F.lit(text)).alias("n")).first()["n"] == number


def test_round_half_up_below_zero(spark):
    row = spark.range(1).select(X.round_half_up(F.lit(-0.5)).alias("a"), X.round_half_up(F.lit(2.25), 1).alias("b")).first()
    assert (row["a"], row["b"]) == (0.0, 2.3)


def test_parse_day(spark):
    now = F.lit("2025-10-24 09:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(
        X.parse_day(F.lit("2025-10-23"), now).alias("a"), X.parse_day(F.lit(None).cast("string"), now).alias("b")
    ).first()
    assert (row["a"], row["b"]) == (datetime(2025, 10, 23), datetime(2025, 10, 24, 9))


def _series(spark, values, product=1):
    rows = [(product, date.fromordinal(730_000 + i), v) for i, v in enumerate(values)]
    return series.demand_series(spark.createDataFrame(rows, "producto_id bigint, dia date, cantidad bigint"))


def test_windows_match_a_loop(spark):
    values = [(7 * i) % 23 for i in range(31)]
    got = {
        r["ventana"]: (r["entrada"], r["salida"]) for r in series.training_windows(_series(spark, values)).collect()
    }
    assert got == {i + 1: (values[i : i + 7], values[i + 7 : i + 14]) for i in range(31 - 13)}


@pytest.mark.parametrize(("values", "each"), [([70], 10), ([1, 1], 1), ([100] + [7] * 7, 7), ([5] * 13, 5)])
def test_simple_forecast_divides_by_seven(spark, values, each):
    got = [r["valor"] for r in series.simple_forecast(_series(spark, values)).collect()]
    assert got == [each] * 7


def test_jitter_stays_within_its_share(spark):
    got = [r["valor"] for r in series.simple_forecast(_series(spark, [1000] * 9), jitter=0.15).collect()]
    assert len(set(got)) > 1 and all(850 <= v <= 1150 for v in got)


def test_constant_series_scales_by_one(spark):
    got = series.scaled(_series(spark, [4, 4, 4])).select("escalado", "restaurado").distinct().collect()
    assert [tuple(r) for r in got] == [(0.0, 4)]


def test_confidence_of_zero_mean(spark):
    zero = spark.createDataFrame([(1, i, 0) for i in range(1, 8)], "producto_id bigint, paso int, valor bigint")
    row = series.forecast_summary(zero).first()
    assert (row["confianza"], row["tendencia"]) == (0.5, series.FLAT)
