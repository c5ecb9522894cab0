"""Customer clusters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.customers import SEGMENTS
from basketry.operators.model_store import ModelStore
from basketry.session import materialize

# Model name, features, clusters, seed, restarts, rounds, least number of customers.
NAME = "customer_segmentation"
FEATURES = ["total_compras", "frecuencia", "ticket_promedio"]
CLUSTERS = 3
SEED = 42
RESTARTS = 10
ROUNDS = 300
MIN_CUSTOMERS = 5

PARALLEL = RESTARTS  # restarts submitted at a time


@dataclass
class SegmentModel:
    """Assembler, scaler and K-means as one pipeline, with the label of each cluster."""

    pipeline: PipelineModel
    labels: DataFrame  # cluster, ticket_medio, clientes, puesto, segmento
    samples: int

    def assign(self, metrics: DataFrame) -> DataFrame:
        """Customers with the cluster of the nearest centre; those of the training or new ones."""
        return self.pipeline.transform(metrics).select(*metrics.columns, F.col("prediction").alias("cluster"))

    def label(self, metrics: DataFrame) -> DataFrame:
        """Customers with the segment of their cluster. The label table has three rows."""
        rest = [c for c in metrics.columns if c != "segmento"]
        names = F.broadcast(self.labels.select("cluster", "segmento"))
        return self.assign(metrics.select(*rest)).join(names, "cluster", "left").select(*rest, "segmento")


def feature_scales(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature."""
    parts = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("media"), F.stddev_pop(c).alias("desviacion"))
        for c in FEATURES
    ]
    return metrics.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def train_segments(
    metrics: DataFrame, restarts: int = RESTARTS, rounds: int = ROUNDS, seed: int = SEED, starts: DataFrame | None = None
) -> SegmentModel | None:
    """The best of several K-means runs by cost; None below five customers.

    Scaled features are written once, so the runs, which go side by side, only read
    them. ``starts`` gives rows to find the centres in, instead of the customers:
    three rows become the three centres.
    """
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="raw")
    rows = assembler.transform(materialize(metrics.select("cliente_id", *FEATURES), "features"))
    samples = rows.count()
    if samples < MIN_CUSTOMERS:
        return None
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    source = rows if starts is None else assembler.transform(starts.select(*FEATURES))
    scaled = materialize(scaler.transform(source).select("features"), "scaled")

    def fit(number: int):
        return KMeans(k=CLUSTERS, seed=seed + number, maxIter=rounds).fit(scaled)

    with ThreadPoolExecutor(PARALLEL) as pool:
        models = list(pool.map(fit, range(restarts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    pipeline = PipelineModel([assembler, scaler, best])
    placed = pipeline.transform(metrics).select(*metrics.columns, F.col("prediction").alias("cluster"))
    return SegmentModel(pipeline, materialize(cluster_means(placed), "cluster-labels"), samples)


def segment_model(store: ModelStore, metrics: DataFrame, now: datetime, **options) -> SegmentModel | None:
    """The stored model while it is fresh, otherwise one trained on ``metrics`` and stored."""

    def train():
        model = train_segments(metrics, **options)
        return model and _parts(model)

    stored = store.train_or_load(NAME, now, train)
    return stored and SegmentModel(stored.pipeline("kmeans"), stored.table("labels"), stored.info["samples"])


def store_segments(store: ModelStore, model: SegmentModel, at: datetime) -> None:
    """Publish a trained model."""
    store.save(NAME, at, *_parts(model))


def _parts(model: SegmentModel) -> tuple[dict, dict]:
    return {"kmeans": model.pipeline, "labels": model.labels}, {"samples": model.samples}


def cluster_customers(metrics: DataFrame, restarts: int = RESTARTS, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame | None:
    """Each customer with its cluster; None below five customers."""
    model = train_segments(metrics, restarts, rounds, seed)
    return model and materialize(model.assign(metrics), "clusters")


def cluster_means(clustered: DataFrame) -> DataFrame:
    """Mean ticket per cluster, highest first, with the segment label of that place."""
    # The outer window sees one row per cluster.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("ticket_medio"), "cluster")
    return (
        clustered.groupBy("cluster")
        .agg(F.avg("ticket_promedio").alias("ticket_medio"), F.count(F.lit(1)).alias("clientes"))
        .withColumn("puesto", F.row_number().over(order))
        .withColumn("segmento", F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("puesto")))
        .orderBy("puesto")
    )


def name_clusters(clustered: DataFrame) -> DataFrame:
    """Customers with the label of their cluster. The label table has three rows."""
    labels = cluster_means(clustered).select("cluster", "segmento")
    rest = [c for c in clustered.columns if c not in ("cluster", "segmento")]
    return clustered.select(*rest, "cluster").join(F.broadcast(labels), "cluster").select(*rest, "segmento")
