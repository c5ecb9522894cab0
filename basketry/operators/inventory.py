"""Sales against stock: creates, updates and deletes decided in log order.

A request is taken whole or not at all, and depends on every earlier accepted
request that shares a product. The log is decided in rounds. In a round each
undecided change gets two bounds on the stock taken before it: *high* counts
every earlier undecided change that takes stock, *low* every earlier undecided
change that gives stock back. A request whose changes all fit under high is
accepted; one with a change that does not fit even under low is rejected; the
rest go to the next round. The earliest undecided request is always decided.

Most undecided requests do not depend on each other, so a round usually decides
a good share of them, and the number of rounds grows with the logarithm of the
log. Where a round decides little, requests wait for each other in long chains.
A product is contested if some undecided change on it does not fit under high.
Contested products and the undecided requests on them form components, and each
component is decided in order in a group of its own. Of a giant component the
earliest changes, at most ``GROUP_ROWS``, are decided so; nothing undecided comes
before them. The rest goes to the next round, where fewer products are contested.
The last ``GROUP_ROWS`` undecided changes are one such group.

The running sums of a product with many changes are cut into chunks of the log
(see ``ranking``), so a product that is in every sale is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.components import components
from basketry.functions.ranking import range_chunks, running_sums
from basketry.operators.sales import sale_facts
from basketry.session import discard, drop_past_shuffles, materialize, scratch_path

GROUP_ROWS = 20_000  # changes of one component that one task decides in a round
GOOD_ROUND = 8  # bounds go on alone while a round decides one in so many of the open changes

# Operations and reject messages.
CREATE, UPDATE, DELETE = "create", "update", "delete"
NO_SALE = "Venta no encontrada"
NO_CUSTOMER = "Cliente no encontrado"
NO_PRODUCT = "Producto no encontrado"
NO_STOCK_SET = "Producto '%s' no tiene stock configurado"
SHORT = "Stock insuficiente para producto '%s'. Disponible: %d, Solicitado: %d"

_LINES = 4096  # lines of one request and product per chunk of a running sum

_HOT = 10_000  # changes of a product that one window adds up

_CHANGE = ["request_id", "fecha", "chunk", "producto_id", "delta", "stock", "taken", "hot"]


@dataclass
class LogResult:
    explain: Callable[[], DataFrame]
    ventas: DataFrame  # id, cliente_id, fecha, total
    detalles: DataFrame  # venta_id, producto_id, linea, cantidad, precio_unitario
    productos: DataFrame  # the products with their new stock
    rounds: int

    @cached_property
    def decisions(self) -> DataFrame:
        """request_id, op, venta_id, cliente_id, fecha, accepted, motivo; reasons are looked for when first asked."""
        return self.explain()


def explode_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a ``lines`` array, as request rows and line rows."""
    heads = requests.select(
        "request_id",
        "op",
        "venta_id",
        F.col("cliente_id").try_cast("bigint").alias("cliente_id"),
        F.to_timestamp_ntz("fecha", F.lit("yyyy-MM-dd")).alias("fecha"),
    )
    lines = requests.select("request_id", F.posexplode("lines").alias("linea", "l")).select(
        "request_id",
        "linea",
        F.col("l.producto_id").try_cast("bigint").alias("producto_id"),
        F.col("l.cantidad").alias("cantidad"),
        F.col("l.precio_unitario").alias("precio_unitario"),
    )
    return heads, lines


def apply_log(
    requests: DataFrame,
    lines: DataFrame,
    clientes: DataFrame,
    productos: DataFrame,
    ventas: DataFrame,
    detalles: DataFrame,
    group_rows: int = GROUP_ROWS,
) -> LogResult:
    """Decide a log of sale requests in the order of ``(fecha, request_id)``.

    ``requests``: request_id, op, venta_id, cliente_id, fecha; ``venta_id`` names
    the sale to create, update or delete, at most once per log. ``lines``:
    request_id, linea, producto_id, cantidad, precio_unitario. Quantities are
    above zero, which the quality rules check.
    """
    heads = range_chunks(requests, ["fecha", "request_id"], "log")
    # Lines that a request would undo: those of the sale it changes.
    old = (
        heads.where(F.col("op") != CREATE)
        .select("request_id", "venta_id")
        .join(detalles.select("venta_id", "producto_id", "cantidad"), "venta_id")
        .select("request_id", "producto_id", "cantidad")
    )
    sale = ventas.select(F.col("id").alias("venta_id"), F.lit(True).alias("_sale"))
    person = clientes.select(F.col("id").alias("cliente_id"), F.lit(True).alias("_person"))
    checked = (
        heads.join(sale, "venta_id", "left")
        .join(person, "cliente_id", "left")
        .withColumn(
            "_head_error",
            F.when((F.col("op") != CREATE) & F.col("_sale").isNull(), F.lit(NO_SALE)).when(
                (F.col("op") != DELETE) & F.col("_person").isNull(), F.lit(NO_CUSTOMER)
            ),
        )
        .drop("_sale", "_person")
    )
    checked = materialize(checked, "checked")
    stock = productos.select(
        F.col("id").alias("producto_id"), F.col("nombre").alias("_nombre"), F.col("stock").alias("stock"), F.lit(True).alias("_known")
    )
    new = lines.join(checked.select("request_id", "op"), "request_id").where(F.col("op") != DELETE)
    new_known = new.join(stock, "producto_id", "left")
    bad_line = new_known.where(F.col("_known").isNull() | F.col("stock").isNull()).select("request_id").distinct()
    open_heads = checked.where(F.col("_head_error").isNull()).join(bad_line, "request_id", "left_anti")

    # Net change per request and product: positive takes stock.
    moved = new.select("request_id", "producto_id", F.col("cantidad").cast("bigint").alias("d")).unionByName(
        old.select("request_id", "producto_id", (-F.col("cantidad")).cast("bigint").alias("d"))
    )
    net = materialize(moved.groupBy("request_id", "producto_id").agg(F.sum("d").alias("delta")), "net")
    changes = (
        net.join(open_heads.select("request_id", "fecha", "chunk"), "request_id")
        .join(stock.select("producto_id", "stock"), "producto_id")
        .where(F.col("stock").isNotNull())
        .withColumn("taken", F.lit(0).cast("bigint"))
    )
    changes = written = materialize(changes, "changes")
    many = changes.groupBy("producto_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _HOT)
    many = materialize(many.select("producto_id", F.lit(True).alias("hot")), "hot-products")
    changes = changes.join(many, "producto_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).select(*_CHANGE)
    verdicts, rounds = _decide(changes, group_rows)
    discard(written)

    # A request without any stock change (such as a sale without lines) is fine.
    decided = (
        checked.join(bad_line.withColumn("_bad", F.lit(True)), "request_id", "left")
        .join(verdicts, "request_id", "left")
        .withColumn(
            "accepted",
            F.col("_head_error").isNull() & F.col("_bad").isNull() & F.coalesce("accepted", F.lit(True)),
        )
        .drop("_bad")
    )
    decided = materialize(decided, "decided")
    drop_past_shuffles(decided.sparkSession)
    ok = decided.where("accepted").select("request_id", "op", "venta_id", "cliente_id", "fecha", "chunk")

    final = net.join(ok.select("request_id", "fecha", "chunk"), "request_id")

    def explain() -> DataFrame:
        motives = _motives(decided, checked, lines, stock, old, final)
        return decided.join(motives, "request_id", "left").select(
            "request_id",
            "op",
            "venta_id",
            "cliente_id",
            "fecha",
            "accepted",
            F.when(~F.col("accepted"), F.coalesce("_head_error", "_line_error")).alias("motivo"),
        )

    change = final.groupBy(F.col("producto_id").alias("id")).agg(F.sum("delta").alias("_out"))
    after = productos.join(change, "id", "left").select(
        *[
            (F.col("stock") - F.coalesce("_out", F.lit(0))).cast("bigint").alias("stock") if c == "stock" else F.col(c)
            for c in productos.columns
        ]
    )
    ended = ok.where(F.col("op") != CREATE).select("venta_id")
    fresh = ok.where(F.col("op") != DELETE).select("request_id", "venta_id", "cliente_id", "fecha")
    columns = ["venta_id", "producto_id", "linea", "cantidad", "precio_unitario"]
    new_lines = lines.join(fresh.select("request_id", "venta_id"), "request_id").select(*columns)
    totals = sale_facts(new_lines).select(F.col("id").alias("venta_id"), "total")
    new_sales = fresh.join(totals, "venta_id", "left").select(
        F.col("venta_id").alias("id"), "cliente_id", "fecha", F.coalesce("total", F.lit(0.0)).alias("total")
    )
    kept_sales = ventas.join(ended.select(F.col("venta_id").alias("id")), "id", "left_anti")
    kept_lines = detalles.join(ended, "venta_id", "left_anti")
    return LogResult(
        explain=explain,
        ventas=kept_sales.select("id", "cliente_id", "fecha", F.col("total").cast("double").alias("total")).unionByName(
            new_sales
        ),
        detalles=kept_lines.select(*columns).unionByName(new_lines),
        productos=after,
        rounds=rounds,
    )


def _decide(changes: DataFrame, group_rows: int) -> tuple[DataFrame, int]:
    """``request_id, accepted`` for every request in ``changes``. Each round appends its verdicts to one table.

    The files of a round go when the next has read them.
    """
    spark = changes.sparkSession
    path = scratch_path(spark, "verdicts")
    todo, fresh, past = changes, None, []
    left = todo.count()
    rounds = 0
    changes.select("request_id", F.lit(True).alias("accepted")).limit(0).write.parquet(path)
    while left > group_rows:
        rounds += 1
        before = left
        drop_past_shuffles(spark)
        state = _round(todo, fresh, f"round{rounds}")
        discard(*past)
        left = state.where(F.col("accepted").isNull()).count()
        if group_rows and left > group_rows and (before - left) * GOOD_ROUND < before:
            state = _by_component(state, group_rows, f"components{rounds}")
            left = state.where(F.col("accepted").isNull()).count()
        state.where(F.col("accepted").isNotNull()).select("request_id", "accepted").distinct().write.mode("append").parquet(path)
        past = [state]
        fresh = state.where(F.col("accepted")).select(*_CHANGE)
        todo = state.where(F.col("accepted").isNull()).select(*_CHANGE)
    if left:
        _rest(todo, fresh).write.mode("append").parquet(path)
    discard(*past)
    drop_past_shuffles(spark)
    return spark.read.schema("request_id bigint, accepted boolean").parquet(path), rounds


def _ahead(todo: DataFrame, fresh: DataFrame | None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``todo`` with the changes of ``fresh`` before each added to ``taken``, and ``sums`` over those of ``todo`` before it."""
    rows = todo.withColumn("_new", F.lit(False))
    if fresh is not None:
        rows = rows.unionByName(fresh.withColumn("_new", F.lit(True)))
    zero, order = F.lit(0).cast("bigint"), ["fecha", "request_id"]
    values = {"_acc": F.when(F.col("_new"), F.col("delta")).otherwise(zero)}
    values |= {name: F.when(~F.col("_new"), value).otherwise(zero) for name, value in (sums or {}).items()}
    earlier = Window.partitionBy("producto_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    few = rows.where(~F.col("hot")).withColumns({n: F.coalesce(F.sum(v).over(earlier), zero) for n, v in values.items()})
    summed = few.unionByName(running_sums(rows.where("hot"), ["producto_id"], "chunk", order, values))
    return summed.where(~F.col("_new")).withColumn("taken", F.col("taken") + F.col("_acc")).drop("_new", "_acc")


def _round(todo: DataFrame, fresh: DataFrame | None, name: str) -> DataFrame:
    """One round of bounds, written as ``name``. ``fresh`` are the changes accepted since the last round.

    ``taken`` carries the earlier accepted changes, so rows that are decided
    leave the working set.
    """
    delta, zero = F.col("delta"), F.lit(0).cast("bigint")
    room = F.col("stock") - F.col("taken")
    tested = (
        _ahead(todo, fresh, {"_up": F.greatest(delta, zero), "_down": F.least(delta, zero)})
        .withColumn("_high", F.coalesce((delta <= 0) | (room - F.col("_up") >= delta), F.lit(True)))
        .withColumn("_low", F.coalesce((delta <= 0) | (room - F.col("_down") >= delta), F.lit(True)))
        .select(*_CHANGE, "_high", "_low")
    )
    # Read twice below, so the running sums are written once.
    tested = materialize(tested, "bounds")
    votes = tested.groupBy("request_id").agg(F.min("_high").alias("_all_high"), F.min("_low").alias("_all_low"))
    accepted = F.when(F.col("_all_high"), F.lit(True)).when(~F.col("_all_low"), F.lit(False))
    state = materialize(tested.join(votes, "request_id").select(*_CHANGE, "_high", accepted.alias("accepted")), name)
    discard(tested)
    return state


def _by_component(state: DataFrame, group_rows: int, name: str) -> DataFrame:
    """Decide the undecided requests of each component in order, up to ``group_rows`` changes of it; written as ``name``.

    A change that fits under high can be left out: it fits whatever the others do.
    """
    open_ = state.where(F.col("accepted").isNull())
    contested = open_.where(~F.col("_high")).select("producto_id").distinct()
    contested = materialize(contested, "contested")
    # Changes accepted in this very round are not in ``taken`` yet.
    pending = state.where(F.col("accepted")).join(contested, "producto_id", "left_semi")
    mine = materialize(open_.join(contested, "producto_id", "left_semi").select(*_CHANGE), "open-changes")
    ahead = _ahead(mine, pending.select(*_CHANGE))

    # Two products are linked if a request has both: each to the request's smallest.
    least = mine.groupBy("request_id").agg(F.min("producto_id").alias("b"), F.count(F.lit(1)).alias("_rows"))
    least = materialize(least, "requests")
    roots = components(mine.join(least, "request_id").select(F.col("producto_id").alias("a"), "b"))
    placed = ahead.join(roots, F.col("producto_id") == F.col("node"), "left").withColumn("_part", F.coalesce("root", "producto_id"))
    order = ["fecha", "request_id", "producto_id"]
    first = running_sums(placed.select(*_CHANGE, "_part"), ["_part"], "chunk", order, {"_place": F.lit(1).cast("bigint")})
    complete = first.where(F.col("_place") < group_rows).join(least.select("request_id", "_rows"), "request_id")
    solved = complete.groupBy("_part").applyInPandas(_in_order, "request_id bigint, _ok boolean")
    after = state.join(solved, "request_id", "left").select(*_CHANGE, F.coalesce("accepted", "_ok").alias("accepted"))
    after = materialize(after, name)
    discard(state, contested, mine, least)
    return after


def _rest(todo: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """Decide the last undecided changes, no more than one group takes, in order."""
    sizes = todo.groupBy("request_id").agg(F.count(F.lit(1)).alias("_rows"))
    rows = _ahead(todo, fresh).join(sizes, "request_id").withColumn("_part", F.lit(0))
    return rows.groupBy("_part").applyInPandas(_in_order, "request_id bigint, _ok boolean").withColumnRenamed("_ok", "accepted")


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Decide the first requests of a component one after the other."""
    used: dict[int, int] = {}
    out = []
    rows = rows.sort_values(["fecha", "request_id"], na_position="first")
    for (_, request), part in rows.groupby(["fecha", "request_id"], sort=False, dropna=False):
        if len(part) < part["_rows"].iloc[0]:
            break  # cut by the limit: it and all later ones wait
        part = part[part["delta"].notna()]  # an unknown quantity takes nothing
        need = list(zip(part["producto_id"], part["delta"], part["stock"], part["taken"], strict=True))
        ok = all(d <= 0 or s - t - used.get(p, 0) >= d for p, d, s, t in need)
        if ok:
            for p, d, _, _ in need:
                used[p] = used.get(p, 0) + d
        out.append((request, ok))
    return pd.DataFrame(out, columns=["request_id", "_ok"])


def _motives(
    decided: DataFrame, checked: DataFrame, lines: DataFrame, stock: DataFrame, old: DataFrame, final: DataFrame
) -> DataFrame:
    """The reason of the first failing line of each rejected request.

    The stock a line saw is the starting stock, less accepted changes of
    earlier requests, plus what its own request gave back, less the earlier
    lines of its request. Only lines of rejected requests meet the products.
    """
    rejected = decided.where(~F.col("accepted") & F.col("_head_error").isNull()).select("request_id", "fecha", "chunk")
    asked = (
        lines.select("request_id", "linea", "producto_id", "cantidad")
        .join(rejected, "request_id")
        .join(checked.where(F.col("op") != DELETE).select("request_id"), "request_id")
    )
    # A line without a readable product id is an unknown product like any other.
    asked = asked.join(stock, "producto_id", "left").withColumn("producto_id", F.coalesce("producto_id", F.lit(-1)))
    lines = materialize(asked.withColumn("_part", F.floor(F.col("linea") / _LINES)), "asked")
    asks = lines.groupBy("request_id", "fecha", "chunk", "producto_id").agg(F.lit(0).cast("bigint").alias("delta"))
    log = asks.withColumn("_ask", F.lit(True)).unionByName(
        final.select("request_id", "fecha", "chunk", "producto_id", "delta").withColumn("_ask", F.lit(False))
    )
    log = materialize(log, "asks")
    drop_past_shuffles(log.sparkSession)
    many = log.groupBy("producto_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _HOT).select("producto_id")
    many = materialize(many, "hot-asked")
    order = ["fecha", "request_id"]
    earlier = Window.partitionBy("producto_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    few = log.join(many, "producto_id", "left_anti").drop("chunk")
    few = few.withColumn("_before", F.coalesce(F.sum("delta").over(earlier), F.lit(0)))
    hot = running_sums(log.join(many, "producto_id", "left_semi"), ["producto_id"], "chunk", order, {"_before": F.col("delta")})
    before = few.unionByName(hot.drop("chunk")).where("_ask").select("request_id", "producto_id", "_before")
    before = materialize(before, "before")
    discard(log, many)
    drop_past_shuffles(log.sparkSession)
    back = (
        old.join(rejected.select("request_id"), "request_id", "left_semi")
        .groupBy("request_id", "producto_id")
        .agg(F.sum("cantidad").alias("_back"))
    )
    free = F.col("stock") - F.col("_before") + F.coalesce("_back", F.lit(0)) - F.col("_earlier")
    lines = running_sums(
        lines, ["request_id", "producto_id"], "_part", ["linea"], {"_earlier": F.col("cantidad").cast("bigint")}
    )
    tested = (
        lines.join(before, ["request_id", "producto_id"], "left")
        .join(back, ["request_id", "producto_id"], "left")
        .withColumn("_free", free)
        .withColumn(
            "_error",
            F.when(F.col("_known").isNull(), F.lit(NO_PRODUCT))
            .when(F.col("stock").isNull(), F.format_string(NO_STOCK_SET, F.col("_nombre")))
            .when(
                F.col("_free") < F.col("cantidad"),
                F.format_string(SHORT, F.col("_nombre"), F.col("_free"), F.col("cantidad")),
            ),
        )
    )
    return (
        tested.where(F.col("_error").isNotNull())
        .groupBy("request_id")
        .agg(F.min_by("_error", "linea").alias("_line_error"))
    )
