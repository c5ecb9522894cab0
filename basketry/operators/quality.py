"""Checks that split rows into good and rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import scalars as X

# Messages of the form checks.
REQUIRED = "Campos requeridos: "
NOT_A_NUMBER = " debe ser un número válido"
SALE_INCOMPLETE = "Debe seleccionar un cliente y agregar al menos un producto"


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add the names of the broken rules; a null result breaks no rule."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("violaciones", broken)


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = with_violations(df, rules)
    good = checked.where(F.size("violaciones") == 0).drop("violaciones")
    return good, checked.where(F.size("violaciones") > 0)


# The check constraints of the stored tables.


def product_rules() -> dict[str, Column]:
    return {"precio_no_negativo": F.col("precio") >= 0, "stock_no_negativo": F.col("stock") >= 0}


def sale_rules() -> dict[str, Column]:
    return {"total_no_negativo": F.col("total") >= 0}


def line_rules() -> dict[str, Column]:
    return {
        "cantidad_positiva": F.col("cantidad") > 0,
        "precio_no_negativo": F.col("precio_unitario") >= 0,
    }


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    present = df.dropna(subset=list(key))
    return present.groupBy(*key).agg(F.count(F.lit(1)).alias("veces")).where(F.col("veces") > 1)


def validate_form(df: DataFrame, required: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Check text rows the way the entry form does.

    A required column must hold text other than blanks. A number column becomes
    the number its text starts with; no number is an error if the column is
    required, and null otherwise. ``error`` is null in good rows.
    """
    missing = F.array_compact(
        F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in required])
    )
    parsed = {c: X.leading_number(F.col(c)) for c in numbers}
    bad = F.coalesce(
        *[F.when(parsed[c].isNull(), F.lit(c + NOT_A_NUMBER)) for c in numbers if c in required],
        F.lit(None).cast("string"),
    )
    error = F.when(F.size(missing) > 0, F.concat(F.lit(REQUIRED), F.concat_ws(", ", missing))).otherwise(bad)
    return df.withColumn("error", error).withColumns(parsed)


def prefill_prices(lines: DataFrame, productos: DataFrame) -> DataFrame:
    """A line without a price takes the product's price."""
    prices = productos.select(F.col("id").alias("producto_id"), F.col("precio").alias("_precio"))
    return lines.join(prices, "producto_id", "left").select(
        *[
            F.coalesce("precio_unitario", "_precio").alias("precio_unitario") if c == "precio_unitario" else F.col(c)
            for c in lines.columns
        ]
    )


def validate_sales(ventas: DataFrame, detalles: DataFrame) -> DataFrame:
    """Sales with an error where the customer or every line is missing."""
    with_lines = detalles.groupBy(F.col("venta_id").alias("id")).agg(F.count(F.lit(1)).alias("lineas"))
    return ventas.join(with_lines, "id", "left").select(
        *ventas.columns,
        F.coalesce("lineas", F.lit(0).cast("bigint")).alias("lineas"),
        F.when(F.col("cliente_id").isNull() | F.col("lineas").isNull(), F.lit(SALE_INCOMPLETE)).alias("error"),
    )
