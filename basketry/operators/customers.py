"""Customer metrics and rule segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.model import sum_money

# Segment labels, best first, and the rule thresholds.
SEGMENTS = ("VIP", "Regular", "Ocasional")
RULE = {"VIP": (4, 25.0), "Regular": (2, 12.0)}


def customer_metrics(ventas: DataFrame) -> DataFrame:
    """Total, count and average ticket per customer that has sales."""
    known = ventas.where(F.col("cliente_id").isNotNull())
    return (
        known.groupBy("cliente_id")
        .agg(sum_money(F.col("total")).alias("total_compras"), F.count(F.lit(1)).alias("frecuencia"))
        .select(
            "cliente_id",
            X.generated_name(X.CUSTOMER_PREFIX, F.col("cliente_id")).alias("nombre"),
            "total_compras",
            "frecuencia",
            X.safe_divide(F.col("total_compras"), F.col("frecuencia")).alias("ticket_promedio"),
        )
    )


def rule_segment(count: Column, ticket: Column, rule: dict[str, tuple[int, float]] = RULE) -> Column:
    """The first segment whose minimum count and minimum ticket are both met."""
    best, middle, rest = SEGMENTS

    def meets(name: str) -> Column:
        return (count >= rule[name][0]) & (ticket >= rule[name][1])

    return F.when(meets(best), F.lit(best)).when(meets(middle), F.lit(middle)).otherwise(F.lit(rest))


def with_rule_segment(metrics: DataFrame, rule: dict[str, tuple[int, float]] = RULE) -> DataFrame:
    return metrics.withColumn("segmento", rule_segment(F.col("frecuencia"), F.col("ticket_promedio"), rule))


def segment_report(metrics: DataFrame) -> DataFrame:
    """Customers with their segment, or a default when none was given."""
    return metrics.select(
        "cliente_id",
        "nombre",
        X.or_default(X.filled(F.col("segmento")), X.NO_SEGMENT).alias("segmento"),
        "total_compras",
        "frecuencia",
        "ticket_promedio",
    )


def segment_sizes(metrics: DataFrame) -> DataFrame:
    def size(label: str) -> Column:
        return F.count_if(F.col("segmento") == label)

    return metrics.agg(
        F.count(F.lit(1)).alias("total_clientes"), *[size(s).alias(f"{s.lower()}_count") for s in SEGMENTS]
    )


def mean_ticket_by_segment(metrics: DataFrame) -> DataFrame:
    """Mean ticket of each of the three segments; 0 for an empty one."""
    means = [
        F.struct(
            F.lit(s).alias("segmento"),
            F.coalesce(F.avg(F.when(F.col("segmento") == s, F.col("ticket_promedio"))), F.lit(0.0)).alias("ticket"),
        )
        for s in SEGMENTS
    ]
    return metrics.agg(F.array(*means).alias("m")).select(F.inline("m"))


def top_customers(metrics: DataFrame, limit: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("total_compras"), "cliente_id").limit(limit)
