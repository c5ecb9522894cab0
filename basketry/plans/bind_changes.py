"""Batch changes and data-quality checks.

Change batches come from the supplier and event tables, whose keys are spread
over the customers and products so that some match and some do not.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.model import Retail
from basketry.operators import inventory, mutations, quality
from basketry.plans.registry import query


def _customer_batch(r: Retail) -> DataFrame:
    """Changed customers: every 20th id, more than there are customers; some fields null."""
    s = r.table("supplier")
    return s.select(
        (F.col("s_suppkey") * 20).alias("id"),
        F.when(F.col("s_acctbal") >= 3000, F.col("s_name")).alias("nombre"),
        F.concat(F.lit("n"), F.col("s_nationkey"), F.lit("@example.org")).alias("correo"),
        F.when(F.col("s_nationkey") < 12, F.lit("000")).alias("telefono"),
    )


_BATCH = """
, lote AS (
  SELECT s_suppkey * 20 AS id, CASE WHEN s_acctbal >= 3000 THEN s_name END AS nombre,
         'n' || s_nationkey || '@example.org' AS correo, CASE WHEN s_nationkey < 12 THEN '000' END AS telefono
  FROM supplier
)
"""


@query(
    "m1_insert_with_ids",
    """
    SELECT id, nombre, correo, telefono FROM cliente
    UNION ALL
    SELECT (SELECT max(id) FROM cliente) + row_number() OVER (ORDER BY s_suppkey), s_name,
           'n' || s_nationkey || '@example.org', NULL FROM supplier
    """,
)
def _(r: Retail) -> DataFrame:
    batch = r.table("supplier").select(
        F.col("s_suppkey").alias("pos"),
        F.col("s_name").alias("nombre"),
        F.concat(F.lit("n"), F.col("s_nationkey"), F.lit("@example.org")).alias("correo"),
        F.lit(None).cast("string").alias("telefono"),
    )
    return mutations.insert_with_ids(r.clientes, batch, "pos")


@query(
    "m2_overwriting_update",
    _BATCH
    + """
    SELECT c.id, CASE WHEN l.id IS NULL THEN c.nombre ELSE l.nombre END AS nombre,
           CASE WHEN l.id IS NULL THEN c.correo ELSE l.correo END AS correo,
           CASE WHEN l.id IS NULL THEN c.telefono ELSE l.telefono END AS telefono
    FROM cliente c LEFT JOIN lote l ON l.id = c.id
    """,
)
def _(r: Retail) -> DataFrame:
    return mutations.update_rows(r.clientes, _customer_batch(r))


@query(
    "m2_unmatched_updates",
    _BATCH
    + "SELECT id, nombre, correo, telefono, 'Cliente no encontrado' AS motivo FROM lote WHERE id NOT IN (SELECT id FROM cliente)",
)
def _(r: Retail) -> DataFrame:
    return mutations.unmatched(_customer_batch(r), r.clientes, "id", inventory.NO_CUSTOMER)


@query(
    "m3_partial_update",
    _BATCH
    + """
    SELECT c.id, coalesce(l.nombre, c.nombre) AS nombre, coalesce(l.correo, c.correo) AS correo,
           coalesce(l.telefono, c.telefono) AS telefono
    FROM cliente c LEFT JOIN lote l ON l.id = c.id
    """,
)
def _(r: Retail) -> DataFrame:
    return mutations.merge_rows(r.clientes, _customer_batch(r))


@query(
    "m4_product_update",
    """
    , lote AS (
      SELECT s_suppkey * 25 AS id, s_name AS nombre, CASE WHEN s_nationkey < 12 THEN 1 END AS categoria_id FROM supplier
    )
    SELECT p.id, CASE WHEN l.id IS NULL THEN p.nombre ELSE l.nombre END AS nombre, descripcion, precio, stock,
           CAST(coalesce(l.categoria_id, p.categoria_id) AS BIGINT) AS categoria_id
    FROM producto p LEFT JOIN lote l ON l.id = p.id
    """,
)
def _(r: Retail) -> DataFrame:
    batch = r.table("supplier").select(
        (F.col("s_suppkey") * 25).alias("id"),
        F.col("s_name").alias("nombre"),
        F.when(F.col("s_nationkey") < 12, F.lit(1).cast("bigint")).alias("categoria_id"),
    )
    return mutations.update_rows(r.productos, batch, keep_null=["categoria_id"])


@query(
    "m5_delete",
    _BATCH + "SELECT id, nombre FROM cliente WHERE id NOT IN (SELECT id FROM lote)",
)
def _(r: Retail) -> DataFrame:
    return mutations.delete_rows(r.clientes, _customer_batch(r)).select("id", "nombre")


@query(
    "m6_missing_keys",
    """
    SELECT event_id, user_id * 20 AS cliente_id, 'Cliente no encontrado' AS motivo FROM events
    WHERE user_id * 20 NOT IN (SELECT id FROM cliente)
    """,
)
def _(r: Retail) -> DataFrame:
    asked = r.table("events").select("event_id", (F.col("user_id") * 20).alias("cliente_id"))
    return mutations.unmatched(asked, r.clientes, "cliente_id", inventory.NO_CUSTOMER).select(
        "event_id", "cliente_id", "motivo"
    )


@query(
    "m7_insert_if_absent",
    _BATCH
    + """
    SELECT id, nombre, correo, telefono FROM cliente
    UNION ALL SELECT id, nombre, correo, telefono FROM lote WHERE id NOT IN (SELECT id FROM cliente)
    """,
)
def _(r: Retail) -> DataFrame:
    return mutations.insert_if_absent(r.clientes, _customer_batch(r), ["id"])


@query(
    "m8_upsert",
    """
    , filas AS (
      SELECT c_custkey AS clave, 0 AS fuente, 0 AS orden, c_name AS valor FROM customer
      UNION ALL SELECT user_id, 1, event_id, event_type FROM events
    )
    SELECT clave, arg_max(valor, (fuente, orden)) AS valor, CAST(arg_max(orden, (fuente, orden)) AS BIGINT) AS orden
    FROM filas GROUP BY clave
    """,
)
def _(r: Retail) -> DataFrame:
    table = r.clientes.select(F.col("id").alias("clave"), F.col("nombre").alias("valor"), F.lit(0).cast("bigint").alias("orden"))
    batch = r.table("events").select(
        F.col("user_id").alias("clave"), F.col("event_type").alias("valor"), F.col("event_id").alias("orden")
    )
    return mutations.upsert(table, batch, ["clave"], ["orden"])


def _deleted_customers(r: Retail) -> DataFrame:
    return _customer_batch(r).select("id")


@query(
    "m9_cascade",
    _BATCH + "SELECT id, cliente_id FROM venta WHERE cliente_id NOT IN (SELECT id FROM lote)",
)
def _(r: Retail) -> DataFrame:
    return mutations.cascade(r.ventas_base, _deleted_customers(r), "cliente_id").select("id", "cliente_id")


@query(
    "m9_set_null",
    _BATCH
    + "SELECT id, CASE WHEN cliente_id IN (SELECT id FROM lote) THEN NULL ELSE cliente_id END AS cliente_id FROM venta",
)
def _(r: Retail) -> DataFrame:
    return mutations.set_null(r.ventas_base, _deleted_customers(r), "cliente_id").select("id", "cliente_id")


@query(
    "m9_restrict",
    _BATCH + "SELECT id FROM lote WHERE id IN (SELECT cliente_id FROM venta)",
)
def _(r: Retail) -> DataFrame:
    return mutations.restricted(_deleted_customers(r), r.ventas_base, "cliente_id")


def _deleted_sales(r: Retail) -> DataFrame:
    return r.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))


_DELETED = ", borrada AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P')"


@query(
    "m10_orphan_removal",
    _DELETED
    + """
    SELECT venta_id, linea, producto_id, cantidad FROM detalle WHERE venta_id NOT IN (SELECT id FROM borrada)
    """,
)
def _(r: Retail) -> DataFrame:
    return mutations.cascade(r.detalles, _deleted_sales(r), "venta_id").select("venta_id", "linea", "producto_id", "cantidad")


@query(
    "m14_delete_sales",
    _DELETED
    + """
    SELECT p.id, p.nombre, CAST(p.stock + coalesce(sum(cantidad), 0) AS BIGINT) AS stock
    FROM producto p LEFT JOIN (SELECT * FROM detalle WHERE venta_id IN (SELECT id FROM borrada)) d ON d.producto_id = p.id
    GROUP BY p.id, p.nombre, p.stock
    """,
)
def _(r: Retail) -> DataFrame:
    return mutations.restore_stock(r.catalogo, r.detalles, _deleted_sales(r)).select("id", "nombre", "stock")


# ---- the sale log ---------------------------------------------------------


def _create_requests(r: Retail) -> tuple[DataFrame, DataFrame]:
    heads = r.ventas_base.select(
        F.col("id").alias("request_id"),
        F.lit(inventory.CREATE).alias("op"),
        F.col("id").alias("venta_id"),
        "cliente_id",
        "fecha",
    )
    # The line number of the sample repeats, so a line is placed by its product.
    lines = (
        r.detalles.groupBy(F.col("venta_id").alias("request_id"), "producto_id")
        .agg(F.sum("cantidad").cast("int").alias("cantidad"), F.min("precio_unitario").alias("precio_unitario"))
        .select("request_id", F.col("producto_id").alias("linea"), "producto_id", "cantidad", "precio_unitario")
    )
    return heads, lines


# One request after the other: a fold over the requests in order, with the stock of all products as its state.
# ``linea_pedido`` has request, time, product, asked quantity and quantity given back; ``f.r`` gets each
# request's verdict: its first line that does not fit, if any, and what was free then.
_FOLD = """
, articulo AS (
  SELECT id, nombre, stock, row_number() OVER (ORDER BY id) AS i FROM producto
), pedido AS (
  SELECT rid, fecha, list(i ORDER BY i) AS p, list(q ORDER BY i) AS q, list(b ORDER BY i) AS b
  FROM linea_pedido JOIN articulo ON id = producto_id GROUP BY rid, fecha
), pliegue AS (
  SELECT list_reduce(
    (SELECT list(struct_pack(t := []::BIGINT[], r := []::STRUCT(rid BIGINT, i BIGINT, libre BIGINT, q BIGINT)[],
                             rid := rid::BIGINT, p := p::BIGINT[], q := q::BIGINT[], b := b::BIGINT[]) ORDER BY fecha, rid) FROM pedido),
    lambda a, x: CASE
      WHEN list_bool_and(list_transform(x.p, lambda i, k: x.q[k] = 0 OR a.t[i] + x.b[k] >= x.q[k]))
      THEN struct_pack(
        t := list_transform(a.t, lambda s, i: s + coalesce(x.b[list_position(x.p, i)] - x.q[list_position(x.p, i)], 0)),
        r := list_append(a.r, struct_pack(rid := x.rid, i := NULL::BIGINT, libre := NULL::BIGINT, q := NULL::BIGINT)),
        rid := a.rid, p := a.p, q := a.q, b := a.b)
      ELSE struct_pack(
        t := a.t,
        r := list_append(a.r, list_filter(
          list_transform(x.p, lambda i, k: struct_pack(rid := x.rid, i := i, libre := a.t[i] + x.b[k], q := x.q[k])),
          lambda l: l.q > 0 AND l.libre < l.q)[1]),
        rid := a.rid, p := a.p, q := a.q, b := a.b)
      END,
    struct_pack(t := (SELECT list(stock ORDER BY i)::BIGINT[] FROM articulo), r := []::STRUCT(rid BIGINT, i BIGINT, libre BIGINT, q BIGINT)[],
                rid := 0::BIGINT, p := []::BIGINT[], q := []::BIGINT[], b := []::BIGINT[])) AS f
), veredicto AS (
  SELECT v.rid, v.i, v.libre, v.q FROM (SELECT unnest(f.r) AS v FROM pliegue) t
)
"""
_VERDICTS = f"""
SELECT cabecera.id AS request_id, cliente_conocido AND v.i IS NULL AS accepted,
       CASE WHEN NOT cliente_conocido THEN '{inventory.NO_CUSTOMER}'
            WHEN v.i IS NOT NULL THEN format('Stock insuficiente para producto ''{{}}''. Disponible: {{}}, Solicitado: {{}}', nombre, libre, q)
       END AS motivo
FROM cabecera LEFT JOIN veredicto v ON v.rid = cabecera.id LEFT JOIN articulo a ON a.i = v.i
"""
_CREATED = (
    """
, cabecera AS (
  SELECT id, fecha, cliente_id IN (SELECT id FROM cliente) AS cliente_conocido FROM venta
), linea_pedido AS (
  SELECT venta_id AS rid, fecha, producto_id, sum(cantidad) AS q, 0 AS b FROM detalle JOIN cabecera ON id = venta_id
  WHERE cliente_conocido GROUP BY ALL
)
"""
    + _FOLD
)
_UPDATED = (
    """
, cabecera AS (
  SELECT id, fecha, cliente_id IN (SELECT id FROM cliente) AS cliente_conocido FROM venta
  WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
), movida AS (
  SELECT venta_id AS rid, producto_id, 0 AS q, cantidad AS b FROM detalle
  UNION ALL
  SELECT l_orderkey, l_partkey, CAST(sum(l_quantity + 25) AS INTEGER), 0 FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL
), linea_pedido AS (
  SELECT rid, fecha, producto_id, sum(q) AS q, sum(b) AS b FROM movida JOIN cabecera ON id = rid WHERE cliente_conocido GROUP BY ALL
)
"""
    + _FOLD
)


def _created(r: Retail) -> inventory.LogResult:
    heads, lines = _create_requests(r)
    return inventory.apply_log(
        heads,
        lines,
        r.clientes,
        r.catalogo,
        r.ventas_base.withColumn("total", F.lit(0.0)).limit(0),
        r.detalles.limit(0),
    )


@query("m11_create_sales", _CREATED + "SELECT a.id, a.nombre, f.t[a.i] AS stock FROM articulo a, pliegue")
def _(r: Retail) -> DataFrame:
    return _created(r).productos.select("id", "nombre", "stock")


@query("m12_reject_reasons", _CREATED + _VERDICTS)
def _(r: Retail) -> DataFrame:
    return _created(r).decisions.select("request_id", "accepted", "motivo")


def _update_requests(r: Retail) -> tuple[DataFrame, DataFrame]:
    """Every sale with returned lines is rewritten without them, and with more of the rest."""
    returned = r.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    heads = r.ventas_base.join(returned, "id", "left_semi").select(
        F.col("id").alias("request_id"),
        F.lit(inventory.UPDATE).alias("op"),
        F.col("id").alias("venta_id"),
        "cliente_id",
        "fecha",
    )
    kept = r.table("lineitem").where("l_returnflag <> 'R'")
    lines = (
        kept.groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("producto_id"))
        .agg(
            F.sum(F.col("l_quantity") + 25).cast("int").alias("cantidad"),
            F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_unitario"),
        )
        .join(heads.select("request_id"), "request_id", "left_semi")
        .select("request_id", F.col("producto_id").alias("linea"), "producto_id", "cantidad", "precio_unitario")
    )
    return heads, lines


@query("m13_update_sales", _UPDATED + _VERDICTS)
def _(r: Retail) -> DataFrame:
    heads, lines = _update_requests(r)
    result = inventory.apply_log(
        heads, lines, r.clientes, r.catalogo, r.ventas_base.withColumn("total", F.lit(0.0)), r.detalles
    )
    return result.decisions.select("request_id", "accepted", "motivo")


# ---- expiry ---------------------------------------------------------------

AS_OF = datetime(2024, 1, 25)
_AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"


def at(moment: datetime) -> Column:
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")


def _cached(r: Retail) -> DataFrame:
    """Events as cached rows: their value is the life in hours, sign-ups never expire."""
    hours = F.make_dt_interval(F.lit(0), F.col("value").cast("int"))
    return r.table("events").select(
        "event_id",
        "ts",
        F.when(F.col("event_type") != "signup", F.col("ts") + hours).alias("valid_until"),
    )


_CACHED = """
WITH guardado AS (
  SELECT event_id, ts, CASE WHEN event_type <> 'signup' THEN ts + to_hours(CAST(trunc(value) AS BIGINT)) END AS valid_until FROM events
)
"""


@query(
    "m15_expire_rows",
    _CACHED + f"SELECT event_id FROM guardado WHERE valid_until IS NULL OR valid_until >= {_AS_OF}",
    views=False,
)
def _(r: Retail) -> DataFrame:
    return mutations.unexpired(_cached(r), "valid_until", at(AS_OF)).select("event_id")


@query(
    "d2_expired_count",
    _CACHED + f"SELECT count(*) AS deleted FROM guardado WHERE valid_until < {_AS_OF}",
    views=False,
)
def _(r: Retail) -> DataFrame:
    return mutations.expired_count(_cached(r), "valid_until", at(AS_OF))


LATER = datetime(2024, 2, 15)
_LATER = "TIMESTAMP '2024-02-15 00:00:00'"


@query(
    "m16_age_out",
    f"SELECT event_id FROM events WHERE ts >= {_LATER} - INTERVAL 30 DAYS",
    views=False,
)
def _(r: Retail) -> DataFrame:
    return mutations.younger_than(r.table("events"), "ts", at(LATER)).select("event_id")


@query(
    "d3_cleanup",
    _CACHED
    + f"""
    SELECT (SELECT count(*) FROM guardado WHERE valid_until < {_LATER}) AS predictions_deleted,
           (SELECT count(*) FROM events WHERE ts < {_LATER} - INTERVAL 30 DAYS) AS old_identifications_deleted
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return mutations.cleanup_counts(_cached(r), "valid_until", r.table("events"), "ts", at(LATER))


_TOUCHED = (
    _BATCH
    + """
    SELECT c.id, CASE WHEN l.id IS NULL THEN c.nombre ELSE l.nombre END AS nombre,
           CASE WHEN l.id IS NULL THEN DATE '2020-01-01' ELSE DATE '2024-01-25' END AS updated_at
    FROM cliente c LEFT JOIN lote l ON l.id = c.id
    """
)


def _touched(r: Retail) -> DataFrame:
    table = r.clientes.select("id", "nombre", F.to_date(F.lit("2020-01-01")).alias("updated_at"))
    batch = _customer_batch(r).select("id", "nombre")
    return mutations.update_rows(table, batch, touch=("updated_at", F.to_date(at(AS_OF))))


query("m17_touch_updated_at", _TOUCHED)(_touched)
query("d4_updated_at_rule", _TOUCHED)(_touched)


# ---- quality --------------------------------------------------------------


@query(
    "m18_check_constraints",
    """
    SELECT e.event_id, concat_ws(',', CASE WHEN e.value - 5 < 0 THEN 'precio_no_negativo' END,
                                   CASE WHEN CAST(json_extract(e.props, '$.k') AS BIGINT) - 10 < 0 THEN 'stock_no_negativo' END) AS violaciones
    FROM events e WHERE e.value - 5 < 0 OR CAST(json_extract(e.props, '$.k') AS BIGINT) - 10 < 0
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    rows = r.table("events").select(
        "event_id",
        (F.col("value") - 5).alias("precio"),
        (F.get_json_object("props", "$.k").cast("bigint") - 10).alias("stock"),
    )
    _, rejected = quality.split_by_rules(rows, quality.product_rules())
    return rejected.select("event_id", F.concat_ws(",", "violaciones").alias("violaciones"))


@query(
    "m18_line_constraints",
    """
    SELECT venta_id, linea, producto_id FROM detalle WHERE cantidad - 1 > 0 AND precio_unitario >= 0
    """,
)
def _(r: Retail) -> DataFrame:
    rows = r.detalles.withColumn("cantidad", F.col("cantidad") - 1)
    good, _ = quality.split_by_rules(rows, quality.line_rules())
    return good.select("venta_id", "linea", "producto_id")


@query(
    "m19_uniqueness",
    "SELECT nombre, count(*) AS veces FROM producto GROUP BY nombre HAVING count(*) > 1",
)
def _(r: Retail) -> DataFrame:
    return quality.duplicates(r.catalogo, ["nombre"])


@query(
    "m20_purge",
    """
    SELECT p.id, CAST(p.stock + coalesce(sum(cantidad), 0) AS BIGINT) AS stock
    FROM producto p LEFT JOIN detalle d ON d.producto_id = p.id GROUP BY p.id, p.stock
    """,
)
def _(r: Retail) -> DataFrame:
    left = mutations.purge(r.catalogo, r.clientes, r.ventas_base.select("id"), r.detalles)
    return left["restaurados"].select("id", "stock")


@query(
    "m20_purged_tables",
    """
    SELECT tabla, 0::BIGINT AS filas, columnas FROM (VALUES ('detalles', 5::BIGINT), ('ventas', 1), ('clientes', 4), ('productos', 5)) t(tabla, columnas)
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    """Rows and columns that the four purged tables have left."""
    left = mutations.purge(r.catalogo, r.clientes, r.ventas_base.select("id"), r.detalles)
    rows = [
        left[name].agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("filas"), F.lit(len(left[name].columns)).cast("bigint").alias("columnas"))
        for name in ("detalles", "ventas", "clientes", "productos")
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


@query(
    "m21_form_validation",
    rf"""
    , forma AS (
      SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS nombre,
             CASE WHEN event_type = 'click' THEN 'n/a' ELSE props[7:] END AS precio,
             CASE WHEN event_type = 'view' THEN '?' ELSE props[7:] END AS stock
      FROM events
    ), leida AS (
      SELECT *, TRY_CAST(regexp_extract(precio, '{_NUMBER}', 1) AS DOUBLE) AS p,
             TRY_CAST(regexp_extract(stock, '{_NUMBER}', 1) AS DOUBLE) AS s FROM forma
    )
    SELECT id, p AS precio, s AS stock,
           CASE WHEN trim(nombre) = '' OR trim(precio) = '' THEN 'Campos requeridos: ' ||
                  concat_ws(', ', CASE WHEN trim(nombre) = '' THEN 'nombre' END, CASE WHEN trim(precio) = '' THEN 'precio' END)
                WHEN p IS NULL THEN 'precio debe ser un número válido' END AS error
    FROM leida
    """,
)
def _(r: Retail) -> DataFrame:
    number = F.expr("substr(props, 7)")
    form = r.table("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("event_type")).alias("nombre"),
        F.when(F.col("event_type") == "click", F.lit("n/a")).otherwise(number).alias("precio"),
        F.when(F.col("event_type") == "view", F.lit("?")).otherwise(number).alias("stock"),
    )
    return quality.validate_form(form, ["nombre", "precio"], ["precio", "stock"]).drop("nombre")


@query(
    "m22_sale_validation",
    """
    SELECT id, num_productos AS lineas, CASE WHEN num_productos = 0 OR cliente_id < 100
      THEN 'Debe seleccionar un cliente y agregar al menos un producto' END AS error FROM venta
    """,
)
def _(r: Retail) -> DataFrame:
    sales = r.ventas_base.withColumn("cliente_id", F.when(F.col("cliente_id") >= 100, F.col("cliente_id")))
    return quality.validate_sales(sales, r.detalles).select("id", "lineas", "error")


@query(
    "m22_prefilled_prices",
    """
    SELECT venta_id, linea, producto_id, CASE WHEN linea = 1 THEN precio ELSE precio_unitario END AS precio_unitario
    FROM detalle LEFT JOIN producto p ON p.id = producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    lines = r.detalles.withColumn("precio_unitario", F.when(F.col("linea") != 1, F.col("precio_unitario")))
    return quality.prefill_prices(lines, r.catalogo).select(
        "venta_id", "linea", "producto_id", "precio_unitario"
    )
