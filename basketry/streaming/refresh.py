"""Incremental refresh of the customer metrics.

Each micro-batch is reduced to one row per customer and added to the state, a
keyed table in buckets: a batch reads and writes the buckets of its own customers
only. The table keeps the number of its newest batch, so a batch that runs again
after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.functions import scalars as X
from basketry.model import cents
from basketry.sources.buckets import BUCKETS, KeyedTable

STATE = "cliente_id bigint, centavos bigint, frecuencia bigint"


def state_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, f"{root}/state", STATE, ["cliente_id"], buckets)


def batch_state(sales: DataFrame) -> DataFrame:
    """Mergeable sums per customer."""
    return (
        sales.where(F.col("cliente_id").isNotNull())
        .groupBy("cliente_id")
        .agg(F.sum(cents(F.col("total"))).alias("centavos"), F.count(F.lit(1)).alias("frecuencia"))
    )


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    return (
        old.unionByName(new)
        .groupBy("cliente_id")
        .agg(F.sum("centavos").alias("centavos"), F.sum("frecuencia").alias("frecuencia"))
    )


def metrics_of(state: DataFrame) -> DataFrame:
    total = F.col("centavos") / F.lit(100.0)
    return state.select(
        "cliente_id",
        X.generated_name(X.CUSTOMER_PREFIX, F.col("cliente_id")).alias("nombre"),
        total.alias("total_compras"),
        "frecuencia",
        X.safe_divide(total, F.col("frecuencia")).alias("ticket_promedio"),
    )


def start_refresh(sales: DataFrame, root: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Process all waiting sales (``cliente_id``, ``total``) in micro-batches and stop.

    ``sales`` is a streaming frame; ``root`` is a folder all executors share.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        state_table(batch.sparkSession, root, buckets).change(batch_state(batch), merge_state, str(batch_id))

    return (
        sales.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )


def refreshed_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of the newest state."""
    return metrics_of(state_table(spark, root).read())


def purchase_stream(
    spark: SparkSession, folder: str, schema: str, file: str = "events.parquet", files_per_batch: int = 100
) -> DataFrame:
    """Purchases of the event files as sales: the user is the customer, the value the total."""
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    return purchases(events)


def purchases(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("cliente_id"), F.col("value").alias("total")
    )
