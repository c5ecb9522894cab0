"""Full refresh: snapshots, customer metrics, training of the three models, published segments."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import anomaly, pricing, segments
from basketry.operators.customers import customer_metrics, with_rule_segment
from basketry.operators.model_store import ModelStore
from basketry.operators.registry import MODELS, training_runs
from basketry.operators.sales import product_snapshot, sale_snapshot, with_totals
from basketry.session import materialize
from basketry.sources import pointer
from basketry.sources.snapshots import current, full_refresh, read_snapshot, replace_tables


@dataclass
class Models:
    """The models of one snapshot; None where there is too little data."""

    prices: pricing.PriceModel | None
    segments: segments.SegmentModel | None
    detector: anomaly.Detector | None

    def runs(self, spark: SparkSession, at: datetime) -> DataFrame:
        """Registry rows."""
        rows = []
        if self.prices:
            rows.append((MODELS[0], self.prices.r2, self.prices.samples, pricing.FEATURES))
        if self.segments:
            rows.append((MODELS[1], None, self.segments.samples, segments.FEATURES))
        if self.detector:
            rows.append((MODELS[2], None, self.detector.training.samples, anomaly.FEATURES))
        return training_runs(spark, at, rows)


def sync(
    spark: SparkSession,
    productos: DataFrame,
    categorias: DataFrame,
    ventas: DataFrame,
    detalles: DataFrame,
    root: str,
    at: datetime,
) -> tuple[pointer.Entry, dict[str, int]]:
    """Rebuild the three caches; what was published, and the counts of what was written.

    Sales with totals are written once, for both caches that need them: in the
    sale cache itself a missing customer can no longer be told from customer 0.
    """
    sales = materialize(with_totals(ventas, detalles), "sales")
    return full_refresh(
        spark,
        {
            "productos": product_snapshot(productos, categorias),
            "ventas": sale_snapshot(sales),
            "clientes": with_rule_segment(customer_metrics(sales)),
        },
        root,
        at,
    )


def train_models(
    spark: SparkSession, root: str, at: datetime, store: ModelStore, restarts: int = segments.RESTARTS, entry: pointer.Entry | None = None
) -> Models:
    """Models of the published snapshot: stored ones while they are fresh, else trained and stored. They are made side by side."""
    seen = entry or current(spark, root)
    table = lambda name: read_snapshot(spark, root, name, seen)
    with ThreadPoolExecutor(3) as pool:
        prices = pool.submit(lambda: pricing.price_model(store, table("productos"), at))
        clusters = pool.submit(lambda: segments.segment_model(store, table("clientes").drop("segmento"), at, restarts=restarts))
        forest = pool.submit(lambda: anomaly.detector(store, anomaly.sale_features(table("ventas")), at))
        return Models(prices.result(), clusters.result(), forest.result())


def publish_segments(
    spark: SparkSession, root: str, model: segments.SegmentModel, at: datetime, entry: pointer.Entry
) -> pointer.Entry:
    """Second stage of a refresh: the customers' segments become those of the clusters.

    Only if no other refresh came since ``entry``; its own customers would lack.
    """
    labelled = model.label(read_snapshot(spark, root, "clientes", entry))
    return replace_tables(spark, {"clientes": labelled}, root, at, entry)[0]


def sync_and_train(
    spark: SparkSession,
    productos: DataFrame,
    categorias: DataFrame,
    ventas: DataFrame,
    detalles: DataFrame,
    root: str,
    store: ModelStore,
    at: datetime,
    restarts: int = segments.RESTARTS,
) -> tuple[pointer.Entry, Models]:
    """Both stages: caches, models, and customers with the segment of their cluster.

    Below five customers there are no clusters; the segments by rule then stay.
    """
    entry, _ = sync(spark, productos, categorias, ventas, detalles, root, at)
    models = train_models(spark, root, at, store, restarts, entry)
    if models.segments:
        entry = publish_segments(spark, root, models.segments, at, entry)
    return entry, models
