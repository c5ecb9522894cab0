"""The sale log against a plain loop."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.functions.components import components
from basketry.operators import inventory as inv
from basketry.session import _application_dir

REQUEST = "request_id bigint, op string, venta_id bigint, cliente_id bigint, fecha timestamp_ntz"
LINE = "request_id bigint, linea int, producto_id bigint, cantidad int, precio_unitario double"
OLD = "venta_id bigint, producto_id bigint, linea int, cantidad int, precio_unitario double"
SALE = "id bigint, cliente_id bigint, fecha timestamp_ntz, total double"
DAY = datetime(2025, 1, 1)


def loop(requests, lines, customers, products, sales, old):
    """One request after the other, as a shop would."""
    stock = {p: s for p, _, s in products}
    names = {p: n for p, n, _ in products}
    book = {v: [(p, q) for s, p, _, q, _ in old if s == v] for v, *_ in sales}
    out = {}
    for rid, op, sale, customer, _ in sorted(requests, key=lambda r: (r[4], r[0])):
        mine = sorted(line for line in lines if line[0] == rid)
        held = dict(stock)
        error = None
        if op != inv.CREATE and sale not in book:
            error = inv.NO_SALE
        elif op != inv.DELETE and customer not in customers:
            error = inv.NO_CUSTOMER
        else:
            if op != inv.CREATE:
                for p, q in book[sale]:
                    if held.get(p) is not None:
                        held[p] += q
            for _, _, p, q, _ in mine if op != inv.DELETE else []:
                if p not in held:
                    error = inv.NO_PRODUCT
                elif held[p] is None:
                    error = inv.NO_STOCK_SET % names[p]
                elif held[p] < q:
                    error = inv.SHORT % (names[p], held[p], q)
                if error:
                    break
                held[p] -= q
        out[rid] = error
        if error is None:
            stock = held
            if op == inv.DELETE:
                del book[sale]
            else:
                book[sale] = [(p, q) for _, _, p, q, _ in mine]
    return out, stock, book


def run(spark, requests, lines, customers, products, sales=(), old=(), **options):
    def frame(data, schema):
        return spark.createDataFrame(list(data), schema)

    return inv.apply_log(
        frame(requests, REQUEST),
        frame(lines, LINE),
        frame([(c,) for c in customers], "id bigint"),
        frame(products, "id bigint, nombre string, stock int"),
        frame(sales, SALE),
        frame(old, OLD),
        **options,
    )


def compare(spark, case, **options):
    result = run(spark, *case, **options)
    errors, stock, book = loop(*case)
    assert {r["request_id"]: r["motivo"] for r in result.decisions.collect()} == errors
    assert {r["id"]: r["stock"] for r in result.productos.collect()} == stock
    got = {}
    for r in result.detalles.collect():
        got.setdefault(r["venta_id"], []).append((r["producto_id"], r["cantidad"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in book.items() if v}
    assert {r["id"] for r in result.ventas.collect()} == set(book)
    return result


def random_case(seed, requests, products, tight):
    rng = random.Random(seed)
    catalog = [(p, f"p{p}", None if rng.random() < 0.03 else rng.randint(0, tight)) for p in range(products)]
    customers = list(range(20))
    sales = [(v, rng.randrange(20), DAY, 0.0) for v in range(1000, 1000 + requests // 4)]
    old = [(v, rng.randrange(products), n, rng.randint(1, 9), 1.0) for v, *_ in sales for n in range(rng.randint(0, 3))]
    targets = [v for v, *_ in sales]
    rng.shuffle(targets)
    heads, lines = [], []
    for rid in range(requests):
        op = rng.choice([inv.CREATE, inv.CREATE, inv.CREATE, inv.UPDATE, inv.DELETE]) if targets else inv.CREATE
        sale = rid if op == inv.CREATE else (targets.pop() if rng.random() < 0.95 else 9_000 + rid)
        heads.append((rid, op, sale, rng.randrange(21), DAY + timedelta(days=rng.randrange(5))))
        if op != inv.DELETE:
            for n in range(rng.randint(0, 4)):
                lines.append((rid, n, rng.randrange(products + (rng.random() < 0.05)), rng.randint(1, 9), 1.5))
    return heads, lines, customers, catalog, sales, old


@pytest.mark.parametrize(("seed", "size"), [(1, 0), (2, 15), (3, 20_000)])
def test_random_logs(spark, seed, size):
    compare(spark, random_case(seed, 200, 12, 60), group_rows=size)


def test_hot_product_in_every_sale(spark):
    heads = [(i, inv.CREATE, i, 1, DAY) for i in range(300)]
    lines = [(i, 0, 0, 1 + i % 7, 1.0) for i in range(300)] + [(i, 1, 1 + i % 3, 1, 1.0) for i in range(300)]
    compare(spark, (heads, lines, [1], [(0, "hot", 350), (1, "a", 40), (2, "b", 900), (3, "c", 20)], [], []), group_rows=5)


def test_long_chain_ends_through_groups(spark):
    """Each sale shares one unit with the next, so bounds alone decide one per round."""
    n = 60
    heads = [(i, inv.CREATE, i, 1, DAY) for i in range(n)]
    lines = [(i, k, i + k, 1, 1.0) for i in range(n) for k in (0, 1)]
    case = (heads, lines, [1], [(p, f"p{p}", 1) for p in range(n + 1)], [], [])
    result = compare(spark, case, group_rows=50)
    assert result.rounds < 10


def test_components_are_decided_side_by_side(spark):
    """Many chains that share nothing: rounds do not grow with their number, and each fits in a small group."""
    chains, n = 40, 12
    heads = [(c * 100 + i, inv.CREATE, c * 100 + i, 1, DAY + timedelta(minutes=i)) for c in range(chains) for i in range(n)]
    lines = [(c * 100 + i, k, c * 100 + i + k, 1, 1.0) for c in range(chains) for i in range(n) for k in (0, 1)]
    products = [(c * 100 + p, f"p{p}", 1) for c in range(chains) for p in range(n + 1)]
    result = compare(spark, (heads, lines, [1], products, [], []), group_rows=2 * n)
    assert result.rounds == 1


def test_components_of_random_links(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in got} == {x: root[x] for x in linked} and len(got) == len(linked)


@pytest.mark.parametrize(
    ("stock", "asked", "left", "reason"),
    [(10, 3, 7, None), (7, 15, 7, "Stock insuficiente para producto 'pan'. Disponible: 7, Solicitado: 15"),
     (None, 1, None, "Producto 'pan' no tiene stock configurado")],
)
def test_create_golden(spark, stock, asked, left, reason):
    result = run(spark, [(1, inv.CREATE, 1, 1, DAY)], [(1, 0, 5, asked, 10.5)], [1], [(5, "pan", stock)])
    assert result.productos.first()["stock"] == left
    assert result.decisions.first()["motivo"] == reason


def test_update_gives_back_first_and_delete_restores(spark):
    sales, old = [(1, 1, DAY, 31.5)], [(1, 5, 0, 3, 10.5)]
    result = run(spark, [(7, inv.UPDATE, 1, 1, DAY)], [(7, 0, 5, 5, 10.5)], [1], [(5, "pan", 7)], sales, old)
    assert result.productos.first()["stock"] == 5
    assert result.ventas.first()["total"] == 52.5
    result = run(spark, [(7, inv.DELETE, 1, None, DAY)], [], [1], [(5, "pan", 5)], sales, [(1, 5, 0, 5, 10.5)])
    assert result.productos.first()["stock"] == 10
    assert result.ventas.count() == 0 and result.detalles.count() == 0


def test_requests_with_arrays(spark):
    schema = (
        "request_id bigint, op string, venta_id bigint, cliente_id string, fecha string, "
        "lines array<struct<producto_id string, cantidad int, precio_unitario double>>"
    )
    df = spark.createDataFrame([(1, "create", 1, "4", "2025-10-23", [("5", 2, 1.5), ("x", 1, 1.0)])], schema)
    heads, lines = inv.explode_requests(df)
    assert tuple(heads.first()) == (1, "create", 1, 4, datetime(2025, 10, 23))
    assert [tuple(r) for r in lines.orderBy("linea").collect()] == [(1, 0, 5, 2, 1.5), (1, 1, None, 1, 1.0)]
    assert lines.where(F.col("producto_id").isNull()).count() == 1


def test_one_large_request_and_unreadable_products(spark, monkeypatch):
    monkeypatch.setattr(inv, "_LINES", 7)
    heads = [(1, inv.CREATE, 1, 1, DAY), (2, inv.CREATE, 2, 1, DAY), (3, inv.CREATE, 3, 1, DAY)]
    lines = [(1, n, 0, 1, 1.0) for n in range(60)] + [(2, 0, 0, 1, 1.0), (2, 1, None, 1, 1.0), (3, 0, 0, 40, 1.0)]
    result = run(spark, heads, lines, [1], [(0, "pan", 45)])
    assert {r["request_id"]: r["motivo"] for r in result.decisions.collect()} == {
        1: inv.SHORT % ("pan", 0, 1),
        2: inv.NO_PRODUCT,
        3: None,
    }


def test_bounds_go_on_alone_while_they_decide_enough(spark, monkeypatch):
    """Random sales share products in one giant component, yet each round decides a good share of them."""
    monkeypatch.setattr(inv, "_by_component", None)
    rng = random.Random(5)
    heads = [(i, inv.CREATE, i, 1, DAY + timedelta(minutes=i)) for i in range(300)]
    lines = [(i, k, p, rng.randint(1, 9), 1.0) for i in range(300) for k, p in enumerate(rng.sample(range(60), 3))]
    products = [(p, f"p{p}", rng.randint(20, 60)) for p in range(60)]
    result = compare(spark, (heads, lines, [1], products, [], []), group_rows=150)
    assert 0 < result.rounds < 12


def test_hot_products_and_a_last_group(spark, monkeypatch):
    monkeypatch.setattr(inv, "_HOT", 30)
    compare(spark, random_case(4, 120, 9, 60), group_rows=40)


def test_a_group_takes_null_dates_first_and_null_quantities_as_nothing():
    day = pd.Timestamp(DAY)
    rows = pd.DataFrame(
        [(1, day, 5, 3.0, 4, 0, 1), (2, pd.NaT, 5, 2.0, 4, 0, 1), (3, day, 5, None, 4, 0, 1), (4, day, 5, 2.0, 4, 0, 1)],
        columns=["request_id", "fecha", "producto_id", "delta", "stock", "taken", "_rows"],
    )
    assert dict(inv._in_order(rows).to_numpy().tolist()) == {2: True, 1: False, 3: True, 4: True}


def test_files_of_past_rounds_are_removed(spark, monkeypatch):
    """While a log is decided, a round finds no files of rounds before the last; at the end none are left, nor are reasons looked for."""
    before = set(Path(_application_dir(spark)).glob("*"))
    names = lambda: sorted(p.name.rpartition("-")[0] for p in set(Path(_application_dir(spark)).glob("*")) - before)
    seen = []
    step = inv._round
    monkeypatch.setattr(inv, "_round", lambda *how: seen.append(names()) or step(*how))
    case = random_case(11, 60, 5, True)
    result = run(spark, *case, group_rows=4)
    assert result.rounds > 2
    kept = {"log", "checked", "net", "changes", "hot-products", "verdicts", "decided", "checkpoints"}
    for at, found in enumerate(seen):
        own = [n for n in found if n not in kept and n != "links"]
        assert len(own) == min(at, 1) and set(own) <= {f"round{at}", f"components{at}"}
    assert not [n for n in names() if n.startswith(("bounds", "round", "components", "contested", "open-changes", "requests", "changes"))]
    assert "asked" not in names()
    want = loop(*case)[0]
    assert {r["request_id"]: r["motivo"] for r in result.decisions.collect()} == want
    assert "asks" not in names()
