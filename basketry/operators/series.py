"""Per-product demand series and the simple forecast.

Lines are first summed per product and day. From there on a product has at
most one row per calendar day, so the windows below are bounded by the length
of the calendar, whatever the number of sales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import scalars as X

# Input and output length of a training window, horizon,
# divisor and variation of the simple forecast, confidence bounds, labels.
SEQUENCE_LENGTH = 7
PREDICTION_DAYS = 7
MIN_WINDOWS = 5
JITTER = 0.15
MIN_CONFIDENCE, MAX_CONFIDENCE = 0.5, 0.95
UP, DOWN, FLAT = "creciente", "decreciente", "estable"
SIMPLE, LSTM = "Simulado", "LSTM"

def daily_quantity(ventas: DataFrame, detalles: DataFrame) -> DataFrame:
    """Units per product and selling day; days without sales have no row."""
    days = ventas.select(F.col("id").alias("venta_id"), F.to_date("fecha").alias("dia"))
    return (
        detalles.select("venta_id", "producto_id", "cantidad")
        .join(days, "venta_id")
        .groupBy("producto_id", "dia")
        .agg(F.sum("cantidad").alias("cantidad"))
    )


def demand_series(daily: DataFrame) -> DataFrame:
    """The compressed series: selling days numbered from 1."""
    return daily.withColumn("seq", F.row_number().over(Window.partitionBy("producto_id").orderBy("dia")))


def training_windows(series: DataFrame) -> DataFrame:
    """Seven values in, the next seven out, sliding by one day."""
    ahead = Window.partitionBy("producto_id").orderBy("seq")
    size = SEQUENCE_LENGTH + PREDICTION_DAYS
    values = F.collect_list("cantidad").over(ahead.rowsBetween(0, size - 1))
    return (
        series.select("producto_id", "seq", values.alias("v"))
        .where(F.size("v") == size)
        .select(
            "producto_id",
            F.col("seq").alias("ventana"),
            F.slice("v", 1, SEQUENCE_LENGTH).alias("entrada"),
            F.slice("v", SEQUENCE_LENGTH + 1, PREDICTION_DAYS).alias("salida"),
        )
    )


def last_points(series: DataFrame, n: int = SEQUENCE_LENGTH) -> DataFrame:
    last = Window.partitionBy("producto_id").orderBy(F.desc("seq"))
    return series.withColumn("atras", F.row_number().over(last)).where(F.col("atras") <= n)


def series_range(series: DataFrame) -> DataFrame:
    return series.groupBy("producto_id").agg(
        F.min("cantidad").alias("minimo"), F.max("cantidad").alias("maximo"), F.count(F.lit(1)).alias("dias")
    )


def value_range(low: Column, high: Column) -> Column:
    """The scaling range; a constant series is scaled by 1."""
    return F.when(high == low, F.lit(1)).otherwise(high - low)


def scaled(series: DataFrame) -> DataFrame:
    """Values scaled to 0..1 per product, with the rounded inverse beside them."""
    whole = Window.partitionBy("producto_id")
    low, high = F.min("cantidad").over(whole), F.max("cantidad").over(whole)
    return (
        series.withColumns({"_low": low, "_range": value_range(low, high)})
        .withColumn("escalado", (F.col("cantidad") - F.col("_low")) / F.col("_range"))
        .withColumn(
            "restaurado", F.floor(F.col("escalado") * F.col("_range") + F.col("_low") + F.lit(0.5)).cast("bigint")
        )
        .drop("_low", "_range")
    )


def simple_forecast(series: DataFrame, jitter: float = 0.0, seed: int = 42) -> DataFrame:
    """Seven values from the last seven points: their sum over 7, at least 1.

    The divisor is 7 even for a shorter series. ``jitter`` spreads each value
    by up to that share, repeatably per product and day.
    """
    base = (
        last_points(series)
        .groupBy("producto_id")
        .agg((F.sum("cantidad") / F.lit(SEQUENCE_LENGTH)).alias("base"))
        .select("producto_id", "base", F.explode(F.sequence(F.lit(1), F.lit(PREDICTION_DAYS))).alias("paso"))
    )
    value = F.col("base")
    if jitter:
        unit = F.pmod(F.xxhash64("producto_id", "paso", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
        value = value * (F.lit(1.0) + (unit * 2 - 1) * F.lit(jitter))
    return base.select("producto_id", "paso", X.floor_at_one(value).alias("valor"))


def trend(first: Column, last: Column) -> Column:
    return F.when(last > first, F.lit(UP)).when(last < first, F.lit(DOWN)).otherwise(F.lit(FLAT))


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Mean, trend and confidence of each product's seven forecast values.

    The simple forecast (``metodo``, if there is such a column) has the least confidence;
    that of the other falls with the variance of its values.
    """
    method = F.first("metodo") if "metodo" in forecast.columns else F.lit(LSTM)
    return (
        forecast.groupBy("producto_id")
        .agg(
            F.avg("valor").alias("promedio"),
            F.var_pop("valor").alias("varianza"),
            F.min_by("valor", "paso").alias("primero"),
            F.max_by("valor", "paso").alias("ultimo"),
            method.alias("_metodo"),
        )
        .select(
            "producto_id",
            X.round_half_up(F.col("promedio"), 1).alias("promedio_diario"),
            F.col("varianza"),
            trend(F.col("primero"), F.col("ultimo")).alias("tendencia"),
            F.when((F.col("_metodo") == SIMPLE) | (F.col("promedio") == 0), F.lit(MIN_CONFIDENCE))
            .otherwise(
                X.clamp(1 - F.col("varianza") / (F.col("promedio") * F.col("promedio")), MIN_CONFIDENCE, MAX_CONFIDENCE)
            )
            .alias("confianza"),
        )
    )
