"""Batch changes: each takes a table and a batch and returns the new table.

A batch holds at most one row per key unless stated otherwise; use
``latest_per_key`` to reduce a change log first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.ranking import number_rows


def insert_with_ids(table: DataFrame, batch: DataFrame, position: str, key: str = "id") -> DataFrame:
    """Append ``batch``, numbered after the largest id in the order of ``position``.

    ``position`` is a unique whole number; it is dropped.
    """
    numbered = number_rows(batch, [position], "_n")
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"), F.lit(1).alias("_k"))
    # One row of ids; the constant key makes it an equi-join with a broadcast single row.
    rows = numbered.withColumn("_k", F.lit(1)).join(F.broadcast(top), "_k")
    ided = rows.withColumn(key, F.col("_top") + F.col("_n")).drop("_k", "_n", "_top", position)
    return table.unionByName(ided.select(*table.columns))


def update_rows(
    table: DataFrame, batch: DataFrame, key: str = "id", keep_null: Sequence[str] = (), touch: tuple[str, Column] | None = None
) -> DataFrame:
    """Overwrite the batch's columns in matching rows.

    Columns in ``keep_null`` keep the old value where the new one is null.
    ``touch`` sets a column, such as a change time, in matched rows.
    """
    new = batch.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in batch.columns if c != key])
    changed = [c for c in batch.columns if c != key]

    def value(c: str) -> Column:
        fresh = F.coalesce(f"_n_{c}", c) if c in keep_null else F.col(f"_n_{c}")
        return F.when(F.col("_hit"), fresh).otherwise(F.col(c)).alias(c)

    columns = [value(c) if c in changed else F.col(c) for c in table.columns]
    if touch:
        name, when = touch
        columns = [
            F.when(F.col("_hit"), when).otherwise(F.col(name)).alias(name) if c == name else col
            for c, col in zip(table.columns, columns, strict=True)
        ]
    return table.join(new, key, "left").select(*columns)


def merge_rows(table: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Partial update: a null in the batch means keep."""
    return update_rows(table, batch, key, keep_null=[c for c in batch.columns if c != key])


def unmatched(batch: DataFrame, table: DataFrame, key: str, reason: str, table_key: str = "id") -> DataFrame:
    """Batch rows whose key is missing in the table, with a reason."""
    known = table.select(F.col(table_key).alias(key))
    return batch.join(known, key, "left_anti").withColumn("motivo", F.lit(reason))


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "id", ids_key: str = "id") -> DataFrame:
    return table.join(ids.select(F.col(ids_key).alias(key)), key, "left_anti")


def insert_if_absent(table: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    fresh = batch.join(table.select(*key), list(key), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; an aggregate, so hot keys are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def upsert(table: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the batch winning over the table and later over earlier batch rows.

    ``table`` has one row per key. ``order`` names columns of the batch; they need not
    be in the table. Only the batch is reduced. The table loses the rows whose keys the
    batch has, by a join that broadcasts the batch's keys when they are few, so it
    is neither sorted nor shuffled then. Null keys count as equal.
    """
    last = latest_per_key(batch, key, order).select(*table.columns)
    taken = last.select(*[F.col(k).alias(f"_k_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    return table.join(taken, same, "left_anti").unionByName(last)


def cascade(children: DataFrame, deleted: DataFrame, foreign_key: str) -> DataFrame:
    return delete_rows(children, deleted, foreign_key)


def set_null(children: DataFrame, deleted: DataFrame, foreign_key: str) -> DataFrame:
    gone = deleted.select(F.col("id").alias(foreign_key), F.lit(True).alias("_gone")).distinct()
    return children.join(gone, foreign_key, "left").select(
        *[
            F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == foreign_key else F.col(c)
            for c in children.columns
        ]
    )


def restricted(deleted: DataFrame, children: DataFrame, foreign_key: str) -> DataFrame:
    """Requested deletions that must be refused because children exist."""
    return deleted.join(children.select(F.col(foreign_key).alias("id")), "id", "left_semi")


def unexpired(table: DataFrame, expiry: str, as_of: Column) -> DataFrame:
    return table.where(F.col(expiry).isNull() | (F.col(expiry) >= as_of))


def younger_than(table: DataFrame, created: str, as_of: Column, days: int = 30) -> DataFrame:
    return table.where(F.col(created) >= as_of - F.make_dt_interval(F.lit(days)))


def expired_count(table: DataFrame, expiry: str, as_of: Column) -> DataFrame:
    gone = F.col(expiry).isNotNull() & (F.col(expiry) < as_of)
    return table.agg(F.count_if(gone).alias("deleted"))


def cleanup_counts(
    predictions: DataFrame, expiry: str, identifications: DataFrame, created: str, as_of: Column, days: int = 30
) -> DataFrame:
    """One row: expired predictions, and identifications past their age."""
    one = F.lit(1).alias("_k")
    old = F.col(created) < as_of - F.make_dt_interval(F.lit(days))
    return (
        expired_count(predictions, expiry, as_of)
        .select(F.col("deleted").alias("predictions_deleted"), one)
        .join(identifications.agg(F.count_if(old).alias("old_identifications_deleted")).select("*", one), "_k")
        .drop("_k")
    )


def restore_stock(productos: DataFrame, detalles: DataFrame, deleted: DataFrame) -> DataFrame:
    """Give the stock of deleted sales back; a null stock stays null."""
    back = (
        detalles.join(deleted.select(F.col("id").alias("venta_id")), "venta_id", "left_semi")
        .groupBy(F.col("producto_id").alias("id"))
        .agg(F.sum("cantidad").alias("_back"))
    )
    return productos.join(back, "id", "left").select(
        *[
            (F.col("stock") + F.coalesce("_back", F.lit(0))).cast("bigint").alias("stock") if c == "stock" else F.col(c)
            for c in productos.columns
        ]
    )


def purge(
    productos: DataFrame, clientes: DataFrame, ventas: DataFrame, detalles: DataFrame
) -> dict[str, DataFrame]:
    """Delete sales, then customers, then products. Stock is restored on the way; categories stay."""
    return {
        "restaurados": restore_stock(productos, detalles, ventas),
        "detalles": detalles.limit(0),
        "ventas": ventas.limit(0),
        "clientes": clientes.limit(0),
        "productos": productos.limit(0),
    }
