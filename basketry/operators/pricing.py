"""Price regression on category code, stock and name length."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.functions.ranking import dense_position
from basketry.operators.model_store import ModelStore
from basketry.session import materialize

# Model name, least number of products, the constant confidence, feature names.
NAME = "price_predictor"
MIN_PRODUCTS = 10
CONFIDENCE = 0.85
FEATURES = ["categoria", "stock", "len_nombre"]
_INPUT = ["codigo", "stock", "len_nombre"]


@dataclass
class PriceModel:
    pipeline: PipelineModel  # assembler and regression
    codes: DataFrame  # categoria, codigo
    classes: int
    r2: float
    samples: int
    skipped: int  # products that lack a feature or the price

    @property
    def regression(self) -> LinearRegressionModel:
        return self.pipeline.stages[-1]

    def coefficients(self) -> DataFrame:
        """One row: intercept, the three weights, fit and sample count."""
        weights = [float(w) for w in self.regression.coefficients]
        row = (float(self.regression.intercept), *weights, self.r2, self.samples)
        schema = "intercepto double, w_codigo double, w_stock double, w_len_nombre double, r2 double, muestras bigint"
        return self.codes.sparkSession.createDataFrame([row], schema)


def category_codes(snapshot: DataFrame) -> DataFrame:
    """Alphabetical code of each category, from 0."""
    names = snapshot.select("categoria").distinct()
    return dense_position(names, "categoria", "codigo", start=0)


def _with_length(rows: DataFrame) -> DataFrame:
    return rows.withColumn("len_nombre", X.text_length(F.col("nombre")))


def train_prices(snapshot: DataFrame) -> PriceModel | None:
    """Ordinary least squares by the normal equations; one pass over the products that have all values."""
    codes = materialize(category_codes(snapshot), "codes")
    rows = _with_length(snapshot.join(codes, "categoria", "left")).select(*_INPUT, F.col("precio").cast("double").alias("label"))
    whole = rows.dropna()
    samples = whole.count()
    if samples < MIN_PRODUCTS:
        return None
    assembler = VectorAssembler(inputCols=_INPUT, outputCol="features", handleInvalid="keep")
    model = LinearRegression(solver="normal", regParam=0.0).fit(assembler.transform(whole))
    return PriceModel(PipelineModel([assembler, model]), codes, codes.count(), model.summary.r2, samples, rows.count() - samples)


def price_model(store: ModelStore, snapshot: DataFrame, now: datetime) -> PriceModel | None:
    """The stored model while it is fresh, otherwise one fitted to the snapshot and stored."""

    def train():
        model = train_prices(snapshot)
        return model and _parts(model)

    stored = store.train_or_load(NAME, now, train)
    return stored and PriceModel(stored.pipeline("regression"), stored.table("codes"), **stored.info)


def _parts(model: PriceModel) -> tuple[dict, dict]:
    info = {"classes": model.classes, "r2": model.r2, "samples": model.samples, "skipped": model.skipped}
    return {"regression": model.pipeline, "codes": model.codes}, info


def store_prices(store: ModelStore, model: PriceModel, at: datetime) -> None:
    """Publish a fitted model."""
    store.save(NAME, at, *_parts(model))


def suggest_prices(model: PriceModel, requests: DataFrame) -> DataFrame:
    """Price per request row; an unknown category takes the middle code, a request that lacks a feature gets no price."""
    coded = requests.join(model.codes, "categoria", "left").withColumn(
        "codigo", F.coalesce("codigo", F.lit(model.classes // 2))
    )
    priced = F.round("prediction", 2)
    return model.pipeline.transform(_with_length(coded)).select(
        *requests.columns,
        F.when(~F.isnan("prediction"), priced).alias("precio_sugerido"),
        F.when(~F.isnan("prediction"), F.lit(CONFIDENCE)).alias("confianza"),
    )
