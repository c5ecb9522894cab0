"""Unusual sales by isolation forest (Liu, Ting and Zhou, 2008)."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import scalars as X
from basketry.functions.quantiles import exact_quantiles
from basketry.operators.model_store import ModelStore
from basketry.session import materialize, spread

# Model name, features, forest size, sample size, share, seed, least number
# of sales, quantiles of the reasons, reason texts, severity bound.
NAME = "anomaly_detector"
FEATURES = ["total", "num_productos", "ticket_promedio"]
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.1
SEED = 42
MIN_SALES = 20
LOW, HIGH = 0.05, 0.95
TOTAL_HIGH = "Total muy alto"
TOTAL_LOW = "Total muy bajo"
MANY_PRODUCTS = "Muchos productos"
NO_PRODUCTS = "Sin productos"
TICKET_HIGH = "Ticket promedio alto"
ERROR_SCORE = -0.3

_DEPTH = int(np.ceil(np.log2(SAMPLE)))
_NODES = "tree int, node int, feature int, split double, path double"


def sale_features(ventas: DataFrame) -> DataFrame:
    """Total, line count and ticket per line (0 without lines)."""
    return ventas.select(
        F.col("id").alias("venta_id"),
        F.to_date("fecha").alias("fecha"),
        "total",
        "num_productos",
        X.safe_divide(F.col("total"), F.col("num_productos")).alias("ticket_promedio"),
    )


def _sampled(features: DataFrame, rows: int, trees: int, seed: int) -> DataFrame:
    """At most ``SAMPLE`` rows per tree, chosen by a hash of sale and tree.

    One hash per row first cuts the table to a pool of about twice the rows
    that all trees need; only the pool is hashed once per tree. So a table of
    any size costs one hash per row, and the shuffle carries the pool.
    """
    buckets = 1 << 30

    def share(wanted: int, of: int) -> int:
        return min(buckets, int(buckets * wanted / max(of, 1)) + 1)

    wanted = 2 * trees * SAMPLE
    draw = F.pmod(F.xxhash64("venta_id", F.lit(seed)), F.lit(buckets))
    pool = spread(features.where(draw < share(wanted, rows)).select("venta_id", *FEATURES), "venta_id")
    keep = share(2 * SAMPLE, min(rows, wanted))
    mark = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(
            t.alias("tree"), F.pmod(F.xxhash64("venta_id", t, F.lit(seed + 1)), F.lit(buckets)).alias("h")
        ),
    )
    hits = pool.select(*FEATURES, "venta_id", F.inline(F.filter(mark, lambda m: m["h"] < keep)))
    order = Window.partitionBy("tree").orderBy("h", "venta_id")
    return spread(hits, "tree").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE).drop("_r", "h")


def _average_path(n: np.ndarray | int):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        """One tree over a sample; nodes are numbered as in a heap."""
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        data = pdf.sort_values("venta_id")[FEATURES].to_numpy(dtype="float64")
        nodes, open_ = [], [(0, 0, data)]
        while open_:
            node, depth, rows = open_.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if depth == _DEPTH or len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, depth + float(_average_path(len(rows)))))
                continue
            feature = int(rng.choice(spread))
            column = rows[:, feature]
            split = rng.uniform(column.min(), column.max())
            low = column <= split
            nodes.append((tree, node, feature, float(split), 0.0))
            open_.append((2 * node + 1, depth + 1, rows[low]))
            open_.append((2 * node + 2, depth + 1, rows[~low]))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "path"])

    return grow


def train_forest(features: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame | None:
    """Node rows of all trees (at most ``trees`` x 511); null below 20 sales."""
    rows = features.count()
    if rows < MIN_SALES:
        return None
    sample = _sampled(features, rows, trees, seed)
    nodes = sample.groupBy("tree").applyInPandas(_grow(seed), _NODES)
    return materialize(nodes, "forest")


def score_sales(features: DataFrame, forest: DataFrame, sample: int | None = None) -> DataFrame:
    """Add ``score``: minus two to the power of minus the relative mean depth."""
    # Bounded by trees x 511 rows.
    nodes = forest.toPandas()
    trees = int(nodes["tree"].max()) + 1
    width = 2 ** (_DEPTH + 1) - 1
    feature = np.full((trees, width), -1, dtype="int8")
    split, path = np.zeros((trees, width)), np.zeros((trees, width))
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature[at], split[at], path[at] = nodes["feature"], nodes["split"], nodes["path"]
    norm = float(_average_path(sample or SAMPLE))
    columns = [*features.columns]

    def score(batches):
        row_tree = np.arange(trees)[None, :]
        for pdf in batches:
            x = pdf[FEATURES].to_numpy(dtype="float64")
            depth = np.empty(len(x))
            for start in range(0, len(x), 2048):
                part = x[start : start + 2048]
                node = np.zeros((len(part), trees), dtype="int64")
                row = np.arange(len(part))[:, None]
                for _ in range(_DEPTH):
                    f = feature[row_tree, node]
                    right = part[row, np.maximum(f, 0)] > split[row_tree, node]
                    node = np.where(f < 0, node, 2 * node + 1 + right)
                depth[start : start + 2048] = path[row_tree, node].mean(axis=1)
            yield pdf.assign(score=-np.power(2.0, -depth / norm))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in features.schema)
    return spread(features, "venta_id").mapInPandas(score, f"{fields}, score double").select(*columns, "score")


def feature_limits(features: DataFrame) -> dict[str, list[float]]:
    """The 5 % and 95 % quantile of each feature over all sales."""
    return exact_quantiles(features, FEATURES, [LOW, HIGH])


def limits_row(features: DataFrame) -> DataFrame:
    limits = feature_limits(materialize(features, "sale-features"))
    row = [(c, *limits[c]) for c in FEATURES]
    return features.sparkSession.createDataFrame(row, "feature string, q05 double, q95 double")


def reasons(limits: dict[str, list[float]]) -> Column:
    """The reasons of a sale as one text."""
    low, high = (lambda c: F.lit(limits[c][0])), (lambda c: F.lit(limits[c][1]))
    return X.join_reasons(
        F.when(F.col("total") > high("total"), F.lit(TOTAL_HIGH)),
        F.when(F.col("total") < low("total"), F.lit(TOTAL_LOW)),
        F.when(F.col("num_productos") > high("num_productos"), F.lit(MANY_PRODUCTS)),
        F.when(F.col("num_productos") == 0, F.lit(NO_PRODUCTS)),
        F.when(F.col("ticket_promedio") > high("ticket_promedio"), F.lit(TICKET_HIGH)),
    )


def with_reasons(features: DataFrame) -> DataFrame:
    """All sales with their reasons.

    The features are written once, since finding the limits reads them a few
    times. The limits are plain literals in the plan, so no join is needed.
    """
    features = materialize(features, "sale-features")
    return features.withColumn("razon", reasons(feature_limits(features)))


def severity(score: Column) -> Column:
    return F.when(score < ERROR_SCORE, F.lit("error")).otherwise(F.lit("warning"))


@dataclass
class Training:
    """What the training saw: bound of an anomaly, share of the sales below it, and means."""

    offset: float
    share: float
    samples: int
    mean_score: float
    means: list[float]  # of the features


@dataclass
class Detector:
    forest: DataFrame
    training: Training

    def score(self, features: DataFrame) -> DataFrame:
        return score_sales(features, self.forest, min(SAMPLE, self.training.samples))

    def flag(self, features: DataFrame) -> DataFrame:
        """Sales, of the training or new ones, with score and flag; the bound is that of the training."""
        return flag_below(self.score(features), self.training.offset)


def flag_below(scored: DataFrame, offset: float) -> DataFrame:
    return scored.withColumn("es_anomalia", F.col("score") < offset)


def train_detector(
    features: DataFrame, trees: int = TREES, seed: int = SEED, share: float = CONTAMINATION
) -> tuple[Detector, DataFrame] | None:
    """Forest and bound, and the scored sales of the training; None below 20 sales."""
    features = materialize(features, "sale-features")
    forest = train_forest(features, trees, seed)
    return None if forest is None else with_bound(forest, features, share)


def with_bound(forest: DataFrame, features: DataFrame, share: float = CONTAMINATION) -> tuple[Detector, DataFrame]:
    """A detector whose bound is the quantile of the expected share over all given sales; and these sales with scores."""
    samples = features.count()
    scored = materialize(score_sales(features, forest, min(SAMPLE, samples)), "scored")
    offset = exact_quantiles(scored, ["score"], [share])["score"][0]
    means = scored.agg(F.avg("score"), *[F.avg(c) for c in FEATURES]).first()
    return Detector(forest, Training(offset, share, samples, means[0], list(means[1:]))), scored


def detector(store: ModelStore, features: DataFrame, now: datetime, **options) -> Detector | None:
    """The stored detector while it is fresh, otherwise one trained on ``features`` and stored."""

    def train():
        trained = train_detector(features, **options)
        return trained and _parts(trained[0])

    stored = store.train_or_load(NAME, now, train)
    return stored and Detector(stored.table("forest"), Training(**stored.info))


def store_detector(store: ModelStore, model: Detector, at: datetime) -> None:
    """Publish a trained detector."""
    store.save(NAME, at, *_parts(model))


def _parts(model: Detector) -> tuple[dict, dict]:
    return {"forest": model.forest}, asdict(model.training)


def detect_anomalies(features: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame | None:
    """All sales with score and flag by a detector trained on them."""
    trained = train_detector(features, trees, seed)
    return None if trained is None else flag_below(trained[1], trained[0].training.offset)


def drift_report(model: Detector, flagged: DataFrame) -> DataFrame:
    """One row: share of anomalies and means of scores and features, in the training and in other sales.

    A share far from that of the training says that the sales have changed and the detector should be trained anew.
    """
    seen = model.training
    then = [F.lit(m).alias(f"{c}_entrenamiento") for c, m in zip(FEATURES, seen.means, strict=True)]
    return flagged.agg(
        F.count(F.lit(1)).alias("ventas"),
        X.safe_divide(F.count_if("es_anomalia"), F.count(F.lit(1))).alias("proporcion"),
        F.avg("score").alias("score_medio"),
        *[F.avg(c).alias(f"{c}_medio") for c in FEATURES],
    ).select("*", F.lit(seen.share).alias("proporcion_entrenamiento"), F.lit(seen.mean_score).alias("score_entrenamiento"), *then)


def anomaly_list(flagged: DataFrame) -> DataFrame:
    """Anomalous sales with reasons and severity, lowest score first."""
    return (
        flagged.withColumn("razon", reasons(feature_limits(flagged)))
        .where("es_anomalia")
        .select("venta_id", "fecha", "total", F.col("score").alias("score_anomalia"), "razon")
        .withColumn("gravedad", severity(F.col("score_anomalia")))
        .orderBy("score_anomalia", "venta_id")
    )


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    """Sales analysed, anomalies found, and their share in percent."""
    return flagged.agg(
        F.count(F.lit(1)).alias("total_ventas_analizadas"), F.count_if("es_anomalia").alias("anomalias_detectadas")
    ).withColumn("porcentaje", F.col("anomalias_detectadas") / F.col("total_ventas_analizadas") * 100)
