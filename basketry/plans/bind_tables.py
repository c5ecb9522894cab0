"""Scans, projections, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.functions import vectors
from basketry.model import Retail
from basketry.operators import dashboard, matching, sales
from basketry.operators.recommend import peers
from basketry.plans.registry import query
from basketry.session import scratch_path
from basketry.sources import images, json_columns

# ---- scans ----------------------------------------------------------------


@query("s1_scan_categories", "SELECT id, nombre, descripcion FROM categoria")
def _(r: Retail) -> DataFrame:
    return r.categorias


@query("s1_scan_products", "SELECT id, nombre, descripcion, precio, stock, categoria_id FROM producto")
def _(r: Retail) -> DataFrame:
    return r.productos


@query("s1_scan_customers", "SELECT id, nombre, correo, telefono FROM cliente")
def _(r: Retail) -> DataFrame:
    return r.clientes


@query("s1_scan_users", "SELECT id, nombre, correo, contrasena FROM usuario")
def _(r: Retail) -> DataFrame:
    return r.usuarios


@query(
    "s2_scan_sale_lines",
    "SELECT venta_id, producto_id, linea, cantidad, precio_unitario FROM detalle",
)
def _(r: Retail) -> DataFrame:
    return r.detalles


@query(
    "s3_sale_documents",
    """
    SELECT v.id AS venta_id, c.nombre AS cliente, d.linea, d.producto_id, p.nombre AS producto, p.categoria,
           d.cantidad, CAST(d.subtotal AS DOUBLE) AS subtotal
    FROM venta v LEFT JOIN cliente c ON c.id = v.cliente_id LEFT JOIN sublinea d ON d.venta_id = v.id
    LEFT JOIN producto p ON p.id = d.producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    docs = sales.sale_documents(r.ventas_base, r.detalles, r.clientes, r.catalogo)
    return sales.explode_documents(docs)


_PARTS = """
, colocada AS (
  SELECT *, (row_number() OVER (PARTITION BY venta_id ORDER BY linea, producto_id, cantidad, precio_unitario) - 1) // 3 AS parte FROM detalle
), parte AS (
  SELECT venta_id, parte, count(*) AS lineas, CAST(sum(cantidad) AS BIGINT) AS unidades, min(producto_id) AS menor, max(producto_id) AS mayor
  FROM colocada GROUP BY ALL
)
"""


@query(
    "s3_document_parts",
    _PARTS
    + """
    SELECT v.id, CAST(coalesce(parte, 0) AS INTEGER) AS parte, CAST(greatest(1, ceil(num_productos / 3)) AS INTEGER) AS partes,
           c.nombre AS cliente, coalesce(lineas, 0) AS lineas, unidades, menor, mayor
    FROM venta v LEFT JOIN cliente c ON c.id = cliente_id LEFT JOIN parte p ON p.venta_id = v.id
    """,
)
def _(r: Retail) -> DataFrame:
    """Documents of at most three lines a part: what each part holds."""
    docs = sales.sale_documents(r.ventas_base, r.detalles, r.clientes, r.catalogo, lines_per_part=3)
    ids = F.transform("detalles", lambda d: d["producto"]["id"])
    units = F.aggregate("detalles", F.lit(0).cast("bigint"), lambda s, d: s + d["cantidad"])
    return docs.select(
        "id", "parte", "partes", F.col("cliente.nombre").alias("cliente"), F.size("detalles").cast("bigint").alias("lineas"),
        F.when(F.size("detalles") > 0, units).alias("unidades"), F.array_min(ids).alias("menor"), F.array_max(ids).alias("mayor"),
    )


@query(
    "s4_sale_fields",
    "SELECT v.id, v.cliente_id, CAST(v.total AS DOUBLE) AS total, CAST(v.fecha AS DATE) AS fecha FROM venta v",
)
def _(r: Retail) -> DataFrame:
    return r.ventas.select("id", "cliente_id", "total", F.to_date("fecha").alias("fecha"))


@query("s4_product_fields", "SELECT id, nombre, precio FROM producto")
def _(r: Retail) -> DataFrame:
    return r.catalogo.select("id", "nombre", "precio")


@query("s5_product_snapshot", "SELECT id, nombre, categoria, precio, stock FROM snapshot")
def _(r: Retail) -> DataFrame:
    return sales.product_snapshot(r.productos, r.categorias)


@query(
    "s6_sale_snapshot",
    """
    SELECT id, coalesce(cliente_id, 0) AS cliente_id, CAST(fecha AS DATE) AS fecha, CAST(total AS DOUBLE) AS total,
           num_productos FROM venta
    """,
)
def _(r: Retail) -> DataFrame:
    return sales.sale_snapshot(r.ventas).withColumn("fecha", F.to_date("fecha"))


@query(
    "s9_json_columns",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    views=False,
)
def _(r: Retail) -> DataFrame:
    events = r.table("events").select("event_id", "event_type", "props")
    typed = json_columns.unpack(events, "props", "k bigint")
    # Written to one JSON column and read back.
    return json_columns.unpack(json_columns.pack(typed, ["k"], "props"), "props", "k bigint")


def _page_files(r: Retail) -> DataFrame:
    """Raw pages as files: every fifth kind of extension is a refused one."""
    kind = F.element_at(
        F.array(*[F.lit(e) for e in ("jpg", "PNG", "pdf", "webp", "gif")]), (F.col("page_id") % 5 + 1).cast("int")
    )
    return r.table("pages").select(
        "page_id",
        F.concat(F.lit("uploads/"), F.col("page_id"), F.lit("."), kind).alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.encode("html", "UTF-8").alias("content"),
    )


_FILES = """
WITH files AS (
  SELECT page_id, 'uploads/' || page_id || '.' ||
         (CASE page_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'pdf' WHEN 3 THEN 'webp' ELSE 'gif' END) AS path,
         CAST(strlen(html) AS BIGINT) AS length
  FROM pages
)
"""


@query(
    "s10_image_intake",
    _FILES
    + r"""
    SELECT page_id, path, length FROM files
    WHERE lower(regexp_extract(path, '(\.[^./?#]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.gif', '.webp')
      AND length <= 10485760
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return images.accepted(_page_files(r)).select("page_id", "path", "length")


_READ_FILES = _FILES.replace("FROM pages", ", coalesce(html, '') AS html FROM pages")


def _read_files(r: Retail) -> DataFrame:
    """Pages written out as files, and those of an accepted kind read back."""
    folder = scratch_path(r.spark, "uploads")
    content = F.coalesce("content", F.lit(b""))
    images.write_files(_page_files(r).select(F.substring_index("path", "/", -1).alias("name"), content.alias("content")), folder)
    return images.accepted(images.read_images(r.spark, folder)).withColumn("name", F.substring_index("path", "/", -1))


@query(
    "s10_files_read",
    _READ_FILES
    + r"""
    SELECT path[9:] AS name, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS image_hash FROM files
    WHERE lower(regexp_extract(path, '(\.[^./?#]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.gif', '.webp') AND strlen(html) <= 10485760
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return images.with_hash(_read_files(r)).select("name", "length", "image_hash")


@query(
    "s11_first_of_each_file",
    _READ_FILES
    + r"""
    SELECT sha256(html) AS image_hash, min(path[9:]) AS name, count(*) AS copias FROM files
    WHERE lower(regexp_extract(path, '(\.[^./?#]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.gif', '.webp') AND strlen(html) <= 10485760
    GROUP BY 1
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return images.first_of_each(_read_files(r), "name")


@query(
    "s11_image_hash",
    "SELECT sha256(text) AS image_hash, min(doc_id) AS doc_id, count(*) AS copias FROM documents GROUP BY 1",
    views=False,
)
def _(r: Retail) -> DataFrame:
    files = r.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return images.first_of_each(files, "doc_id")


@query(
    "s12_catalogue",
    """
    SELECT categoria, count(*) AS productos, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
           count(*) OVER () AS num_categorias
    FROM snapshot GROUP BY categoria
    """,
)
def _(r: Retail) -> DataFrame:
    return sales.catalogue_report(r.snapshot)


@query(
    "s13_reference_options",
    """
    SELECT id AS value, coalesce(nullif(categoria, ''), nullif(nombre, ''), 'Item ' || id) AS label FROM producto
    UNION ALL
    SELECT user_id AS value, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'Item ' || user_id) AS label
    FROM events
    """,
)
def _(r: Retail) -> DataFrame:
    users = r.table("events").select(
        F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("nombre")
    )
    return sales.reference_options(r.catalogo, "categoria").unionByName(sales.reference_options(users, "nombre"))


@query(
    "s14_table_counts",
    """
    SELECT 'categorias' AS tabla, count(*) AS filas FROM categoria UNION ALL SELECT 'productos', count(*) FROM part
    UNION ALL SELECT 'clientes', count(*) FROM customer UNION ALL SELECT 'usuarios', count(*) FROM supplier
    UNION ALL SELECT 'ventas', count(*) FROM orders UNION ALL SELECT 'detalles', count(*) FROM lineitem
    """,
)
def _(r: Retail) -> DataFrame:
    return sales.table_counts(
        {
            "categorias": r.categorias,
            "productos": r.catalogo,
            "clientes": r.clientes,
            "usuarios": r.usuarios,
            "ventas": r.ventas_base,
            "detalles": r.detalles,
        }
    )


# ---- filters and projections ----------------------------------------------


def _buyers(r: Retail) -> DataFrame:
    """Event users as a batch of lookups by customer id."""
    return r.table("events").select("event_id", F.col("user_id").alias("id"))


@query(
    "f1_point_lookup",
    "SELECT e.event_id, c.id, c.nombre FROM events e JOIN cliente c ON c.id = e.user_id",
)
def _(r: Retail) -> DataFrame:
    return _buyers(r).join(r.clientes, "id").select("event_id", "id", "nombre")


_PICKED = """
, vendido AS (
  SELECT producto_id, CAST(sum(cantidad) AS BIGINT) AS unidades FROM detalle GROUP BY 1
), elegido AS (
  SELECT id, categoria FROM (
    SELECT s.id, s.categoria, row_number() OVER (
      PARTITION BY s.categoria ORDER BY coalesce(unidades, 0) DESC, s.id) AS n
    FROM snapshot s LEFT JOIN vendido ON producto_id = s.id
  ) t WHERE n = 1
)
"""


def _picked(r: Retail) -> DataFrame:
    """The best-selling product of each category."""
    sold = sales.stock_against_sales(r.snapshot, r.detalles).select("id", "vendidas")
    rows = r.snapshot.select("id", "categoria").join(sold, "id")
    # An aggregate, not a window: a large category is reduced before the shuffle.
    return rows.groupBy("categoria").agg(F.max_by("id", F.struct("vendidas", -F.col("id"))).alias("id"))


@query(
    "f2_same_category",
    _PICKED
    + """
    SELECT e.id AS elegido, s.categoria, s.id, s.nombre
    FROM elegido e JOIN snapshot s ON s.categoria = e.categoria AND s.id <> e.id
    """,
)
def _(r: Retail) -> DataFrame:
    return peers(_picked(r), r.snapshot)


@query(
    "f3_sales_of_day",
    "SELECT id, cliente_id FROM venta, hoy WHERE CAST(fecha AS DATE) = hoy.dia",
)
def _(r: Retail) -> DataFrame:
    return r.ventas_base.where(F.to_date("fecha") == r.as_of).select("id", "cliente_id")


# Search texts in other case and with accents than the names.
TERMS = ("RÍNG", "cóld", "Gízmo", "blue ánvil", "plátano", "L")


@query(
    "f4_name_search",
    """
    , termino(termino) AS (VALUES ('RÍNG'), ('cóld'), ('Gízmo'), ('blue ánvil'), ('plátano'), ('L'))
    SELECT termino, min(id) AS id, arg_min(nombre, id) AS nombre
    FROM termino LEFT JOIN producto ON contains(lower(strip_accents(nombre)), lower(strip_accents(termino)))
    GROUP BY termino
    """,
)
def _(r: Retail) -> DataFrame:
    return matching.search_by_name(r.catalogo, TERMS)


@query(
    "f6_default_segment",
    """
    SELECT c.id, coalesce(CASE WHEN frecuencia >= 12 THEN 'VIP' END, 'Sin clasificar') AS segmento
    FROM cliente c LEFT JOIN metrica m ON m.cliente_id = c.id
    """,
)
def _(r: Retail) -> DataFrame:
    label = F.when(F.col("frecuencia") >= 12, F.lit("VIP"))
    return r.clientes.join(r.metricas.withColumnRenamed("cliente_id", "id").drop("nombre"), "id", "left").select(
        "id", X.or_default(label, X.NO_SEGMENT).alias("segmento")
    )


@query(
    "f7_severity",
    "SELECT event_id, CASE WHEN -value / 100 < -0.3 THEN 'error' ELSE 'warning' END AS gravedad FROM events",
    views=False,
)
def _(r: Retail) -> DataFrame:
    from basketry.operators.anomaly import severity

    return r.table("events").select("event_id", severity(-F.col("value") / 100).alias("gravedad"))


@query(
    "f8_nested_path",
    "SELECT id, categoria, nombre FROM snapshot",
)
def _(r: Retail) -> DataFrame:
    nested = r.snapshot.select("id", F.struct("nombre", F.struct(F.col("categoria").alias("nombre")).alias("categoria")).alias("p"))
    return nested.select("id", F.col("p.categoria.nombre").alias("categoria"), F.col("p.nombre").alias("nombre"))


@query(
    "f9_output_shape",
    """
    SELECT id AS venta_id, strftime(fecha, '%Y-%m-%d') AS dia, CAST(total AS DOUBLE) AS importe,
           CAST(num_productos AS INTEGER) AS lineas FROM venta
    """,
)
def _(r: Retail) -> DataFrame:
    return r.ventas.select(
        F.col("id").alias("venta_id"),
        F.date_format("fecha", "yyyy-MM-dd").alias("dia"),
        F.col("total").alias("importe"),
        F.col("num_productos").cast("int").alias("lineas"),
    )


# ---- joins ----------------------------------------------------------------


@query(
    "j1_product_category",
    "SELECT p.id, p.nombre, c.nombre AS categoria FROM producto p LEFT JOIN categoria c ON c.id = p.categoria_id",
)
def _(r: Retail) -> DataFrame:
    names = r.categorias.select(F.col("id").alias("categoria_id"), F.col("nombre").alias("categoria"))
    return r.productos.join(names, "categoria_id", "left").select("id", "nombre", "categoria")


@query(
    "j2_line_product",
    "SELECT venta_id, linea, producto_id, nombre, cantidad FROM detalle JOIN producto p ON p.id = producto_id",
)
def _(r: Retail) -> DataFrame:
    names = r.catalogo.select(F.col("id").alias("producto_id"), "nombre")
    return r.detalles.join(names, "producto_id").select("venta_id", "linea", "producto_id", "nombre", "cantidad")


@query(
    "j3_sale_customer",
    "SELECT v.id, v.cliente_id, c.nombre FROM venta v LEFT JOIN cliente c ON c.id = v.cliente_id",
)
def _(r: Retail) -> DataFrame:
    people = r.clientes.select(F.col("id").alias("cliente_id"), "nombre")
    return r.ventas_base.join(people, "cliente_id", "left").select("id", "cliente_id", "nombre")


@query(
    "j4_sale_lines",
    """
    SELECT v.id, d.linea, d.producto_id, d.cantidad FROM venta v LEFT JOIN detalle d ON d.venta_id = v.id
    """,
)
def _(r: Retail) -> DataFrame:
    lines = r.detalles.withColumnRenamed("venta_id", "id").drop("precio_unitario")
    return r.ventas_base.select("id").join(lines, "id", "left")


@query(
    "j5_line_lookup",
    """
    SELECT venta_id, linea, producto_id, coalesce(categoria, 'Sin categoría') AS categoria,
           CAST(subtotal AS DOUBLE) AS subtotal
    FROM sublinea LEFT JOIN producto p ON p.id = producto_id
    """,
)
def _(r: Retail) -> DataFrame:
    lookup = r.catalogo.select(F.col("id").alias("producto_id"), "categoria")
    return sales.with_subtotal(r.detalles).join(lookup, "producto_id", "left").select(
        "venta_id",
        "linea",
        "producto_id",
        X.or_default(F.col("categoria"), X.NO_CATEGORY).alias("categoria"),
        "subtotal",
    )


@query(
    "j9_missing_parent",
    """
    SELECT e.event_id, e.user_id * 20 AS cliente_id FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM cliente c WHERE c.id = e.user_id * 20)
    """,
)
def _(r: Retail) -> DataFrame:
    asked = r.table("events").select("event_id", (F.col("user_id") * 20).alias("cliente_id"))
    return asked.join(r.clientes.select(F.col("id").alias("cliente_id")), "cliente_id", "left_anti").select(
        "event_id", "cliente_id"
    )


@query(
    "j10_has_children",
    "SELECT id, nombre FROM cliente c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id)",
)
def _(r: Retail) -> DataFrame:
    return r.clientes.join(r.ventas_base.select(F.col("cliente_id").alias("id")), "id", "left_semi").select("id", "nombre")


@query(
    "j11_described",
    """
    SELECT s_suppkey * 25 AS other, coalesce(p.nombre, 'Producto ' || s_suppkey * 25) AS nombre,
           coalesce(p.categoria, 'Desconocida') AS categoria
    FROM supplier LEFT JOIN producto p ON p.id = s_suppkey * 25
    """,
)
def _(r: Retail) -> DataFrame:
    hits = r.table("supplier").select((F.col("s_suppkey") * 25).alias("other"))
    info = r.catalogo.select(F.col("id").alias("other"), "nombre", "categoria")
    return hits.join(info, "other", "left").select(
        "other",
        F.coalesce("nombre", X.generated_name(X.PRODUCT_PREFIX, F.col("other"))).alias("nombre"),
        X.or_default(F.col("categoria"), X.UNKNOWN_CATEGORY).alias("categoria"),
    )


# ---- scalar functions -----------------------------------------------------


@query("x1_text_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS largo FROM documents", views=False)
def _(r: Retail) -> DataFrame:
    return r.table("documents").select("doc_id", X.text_length(F.col("text")).alias("largo"))


@query(
    "x2_lower_contains",
    "SELECT id, lower(nombre) AS minusculas, contains(lower(nombre), lower('RING')) AS tiene FROM producto",
)
def _(r: Retail) -> DataFrame:
    return r.catalogo.select(
        "id",
        F.lower("nombre").alias("minusculas"),
        X.contains_ignoring_case(F.col("nombre"), F.lit("RING")).alias("tiene"),
    )


@query(
    "x3_plain_text",
    """
    SELECT doc_id, contains(lower(strip_accents(trim(text))), 'eleve') AS tiene,
           contains(lower(strip_accents(trim(text))), 'ca') AS otra FROM documents
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return r.table("documents").select(
        "doc_id",
        X.contains_plain(F.col("text"), F.lit("ÉLEVÈ")).alias("tiene"),
        X.contains_plain(F.col("text"), F.lit("Çá")).alias("otra"),
    )


@query(
    "x4_date_part",
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS dia, CAST(o_orderdate AS DATE) AS fecha FROM orders",
    views=False,
)
def _(r: Retail) -> DataFrame:
    text = F.date_format("fecha", "yyyy-MM-dd'T'HH:mm")
    return r.ventas_base.select("id", X.date_part(text).alias("dia"), X.day_of(F.col("fecha")).alias("fecha"))


@query(
    "x5_parse_day",
    """
    SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'P' THEN (SELECT dia FROM hoy) ELSE o_orderdate END AS DATE) AS dia
    FROM orders
    """,
)
def _(r: Retail) -> DataFrame:
    text = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = X.parse_day(text, r.as_of.cast("timestamp_ntz"))
    return r.table("orders").select(F.col("o_orderkey").alias("id"), F.to_date(day).alias("dia"))


@query(
    "x6_days_back",
    "SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE) - o_custkey % 30, '%Y-%m-%d') AS dia FROM orders"
    .replace("- o_custkey % 30", "- CAST(o_custkey % 30 AS INTEGER)"),
    views=False,
)
def _(r: Retail) -> DataFrame:
    return r.ventas_base.select(
        "id", X.days_back(F.to_date("fecha"), (F.col("cliente_id") % 30).cast("int")).alias("dia")
    )


_TEXT_IDS = "substr(c_name, CASE WHEN c_nationkey < 5 THEN 1 ELSE 10 END)"


@query(
    "x7_text_to_id",
    f"SELECT c_custkey AS id, TRY_CAST({_TEXT_IDS} AS BIGINT) AS numero FROM customer",
    views=False,
)
def _(r: Retail) -> DataFrame:
    start = F.when(F.col("c_nationkey") < 5, 1).otherwise(10)
    text = F.substring("c_name", start, F.length("c_name"))
    return r.table("customer").select(F.col("c_custkey").alias("id"), X.to_id(text).alias("numero"))


@query(
    "x8_leading_number",
    r"""
    SELECT c_custkey AS id,
      TRY_CAST(regexp_extract(CASE WHEN c_nationkey < 5 THEN c_name ELSE ' ' || CAST(CAST(c_acctbal AS INTEGER) AS VARCHAR) || '.5 kg' END,
        '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE) AS numero
    FROM customer
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    whole = F.rint("c_acctbal").cast("int").cast("string")
    text = F.when(F.col("c_nationkey") < 5, F.col("c_name")).otherwise(F.concat(F.lit(" "), whole, F.lit(".5 kg")))
    return r.table("customer").select(F.col("c_custkey").alias("id"), X.leading_number(text).alias("numero"))


@query("x9_default", "SELECT id, categoria FROM snapshot")
def _(r: Retail) -> DataFrame:
    return r.catalogo.select("id", X.or_default(F.col("categoria"), X.NO_CATEGORY).alias("categoria"))


@query(
    "x10_joined_reasons",
    """
    SELECT event_id, coalesce(nullif(concat_ws(' | ', CASE WHEN value > 40 THEN 'alto' END,
      CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN value < 2 THEN 'bajo' END), ''), 'Patrón inusual') AS razon
    FROM events
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return r.table("events").select(
        "event_id",
        X.join_reasons(
            F.when(F.col("value") > 40, F.lit("alto")),
            F.when(F.col("event_type") == "error", F.lit("error")),
            F.when(F.col("value") < 2, F.lit("bajo")),
        ).alias("razon"),
    )


@query(
    "x11_number_formats",
    """
    SELECT id, printf('%.2f', CAST(total AS DOUBLE)) AS importe, printf('%.1f', num_productos / 17.0::DOUBLE * 100) AS porcentaje
    FROM venta
    """,
)
def _(r: Retail) -> DataFrame:
    return r.ventas.select(
        "id",
        X.two_decimals(F.col("total")).alias("importe"),
        X.percent(F.col("num_productos") / F.lit(17.0)).alias("porcentaje"),
    )


@query(
    "x12_message",
    """
    SELECT p.id, 'Stock insuficiente para producto ''' || nombre || '''. Disponible: ' || stock || ', Solicitado: '
           || coalesce(CAST(sum(cantidad) AS BIGINT), 0) AS mensaje
    FROM producto p LEFT JOIN detalle ON producto_id = p.id GROUP BY p.id, nombre, stock
    """,
)
def _(r: Retail) -> DataFrame:
    from basketry.operators.inventory import SHORT

    return sales.stock_against_sales(r.catalogo, r.detalles).select(
        "id", F.format_string(SHORT, "nombre", "stock", "vendidas").alias("mensaje")
    )


@query(
    "x13_round_half_up",
    """
    SELECT c_custkey AS id, floor(c_acctbal * -1 + 0.5) AS entero, floor(c_acctbal * 10 + 0.5) / 10 AS decimo
    FROM customer
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    return r.table("customer").select(
        F.col("c_custkey").alias("id"),
        X.round_half_up(-F.col("c_acctbal")).alias("entero"),
        X.round_half_up(F.col("c_acctbal"), 1).alias("decimo"),
    )


@query("x14_clamp", "SELECT event_id, greatest(0.5, least(0.95, value / 50)) AS confianza FROM events", views=False)
def _(r: Retail) -> DataFrame:
    return r.table("events").select("event_id", X.clamp(F.col("value") / 50, 0.5, 0.95).alias("confianza"))


@query(
    "x15_safe_division",
    """
    SELECT id, CASE WHEN num_productos = 0 THEN 0 ELSE CAST(total AS DOUBLE) / num_productos END AS ticket
    FROM venta
    """,
)
def _(r: Retail) -> DataFrame:
    ticket = X.safe_divide(F.col("total"), F.col("num_productos"))
    return r.ventas.select("id", ticket.alias("ticket"))


@query(
    "x16_floor_at_one",
    "SELECT event_id, greatest(1, CAST(floor(value / 10) AS BIGINT)) AS unidades FROM events",
    views=False,
)
def _(r: Retail) -> DataFrame:
    return r.table("events").select("event_id", X.floor_at_one(F.col("value") / 10).alias("unidades"))


def _neighbours(r: Retail) -> DataFrame:
    """Each vector beside the one with the next id."""
    rows = r.table("embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("siguiente"))
    return rows.join(after, "vec_id")


_COSINE = """
SELECT a.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS coseno
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""


@query("x17_cosine", _COSINE, views=False)
def _(r: Retail) -> DataFrame:
    score = vectors.cosine(F.col("embedding"), F.col("siguiente"))
    return _neighbours(r).select("vec_id", F.round(score, 6).alias("coseno"))


@query("d1_cosine_sql_function", _COSINE, views=False)
def _(r: Retail) -> DataFrame:
    vectors.register(r.spark)
    doubles = [F.to_json(F.col(c).cast("array<double>")).alias(n) for c, n in (("embedding", "a"), ("siguiente", "b"))]
    return _neighbours(r).select("vec_id", *doubles).select(
        "vec_id", F.expr("round(cosine_similarity(a, b), 6)").alias("coseno")
    )


@query(
    "x18_array_parts",
    """
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS largo, CAST(embedding[1] AS DOUBLE) AS primero,
           CAST(embedding[64] AS DOUBLE) AS ultimo, CAST(len(embedding[3:9]) AS INTEGER) AS trozo
    FROM embeddings
    """,
    views=False,
)
def _(r: Retail) -> DataFrame:
    v = F.col("embedding")
    return r.table("embeddings").select(
        "vec_id",
        F.size(v).alias("largo"),
        F.element_at(v, 1).cast("double").alias("primero"),
        F.element_at(v, -1).cast("double").alias("ultimo"),
        F.size(F.slice(v, 3, 7)).alias("trozo"),
    )


@query(
    "x19_json_element",
    "SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS tercero FROM embeddings",
    views=False,
)
def _(r: Retail) -> DataFrame:
    text = F.to_json(F.col("embedding").cast("array<double>"))
    return r.table("embeddings").select("vec_id", F.element_at(vectors.json_vector(text), 3).alias("tercero"))


@query("x20_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents", views=False)
def _(r: Retail) -> DataFrame:
    return r.table("documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("x21_generated_name", "SELECT c_custkey AS id, 'Cliente ' || c_custkey AS nombre FROM customer", views=False)
def _(r: Retail) -> DataFrame:
    return r.clientes.select("id", X.generated_name(X.CUSTOMER_PREFIX, F.col("id")).alias("nombre"))


@query(
    "a23_service_status",
    """
    SELECT (SELECT count(*) FROM part) AS productos, (SELECT count(*) FROM orders) AS ventas,
           (SELECT count(*) FROM metrica) AS clientes, true AS models_trained
    """,
)
def _(r: Retail) -> DataFrame:
    from basketry.operators.customers import customer_metrics

    counts = sales.table_counts(
        {"productos": r.catalogo, "ventas": r.ventas_base, "clientes": customer_metrics(r.ventas_base.withColumn("total", F.lit(0.0)))}
    )
    return dashboard.service_status(counts)
