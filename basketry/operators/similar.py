"""Exact top-N neighbours by cosine, without making all pairs.

Vectors are grouped into cells around pivot vectors, and cells are cut into
blocks of bounded size. A block is first searched within itself; that gives
each vector a score its final neighbours must reach. By the triangle
inequality on angles, a vector then visits only the cells that can still hold
such a neighbour: for several pivots a cell knows the least and greatest angle
of its members. Visits are rows of ids; the vectors are joined to them when
block meets block. A task multiplies one block of vectors with one block of
candidates and keeps N rows per vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.session import materialize, spread

BLOCK_ROWS = 16_384
MIN_PIVOTS, MAX_PIVOTS = 16, 1_024
REFERENCES = 16  # pivots to which every cell knows the range of its members' angles
DIGITS = 9  # scores that agree to this many digits are ties, broken by id
_SLACK = 1e-7
_HITS = "id bigint, other bigint, score double"


def _unit(values: pd.Series) -> np.ndarray:
    rows = np.array(values.tolist(), dtype="float64").reshape(len(values), -1)
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _best(left: pd.DataFrame, right: pd.DataFrame, n: int) -> pd.DataFrame:
    """The N best candidates of ``right`` for each row of ``left``; equal scores by lower id."""
    right = right.sort_values("id")
    ids, vectors = right["id"].to_numpy(), _unit(right["embedding"]).T
    out = []
    for start in range(0, len(left), 512):
        part = left.iloc[start : start + 512]
        own = part["id"].to_numpy()
        score = np.round(_unit(part["embedding"]) @ vectors, DIGITS)
        score[own[:, None] == ids[None, :]] = -np.inf
        for _ in range(min(n, len(ids))):
            at = score.argmax(axis=1)
            top = score[np.arange(len(own)), at]
            seen = np.isfinite(top)
            out.append(pd.DataFrame({"id": own[seen], "other": ids[at[seen]], "score": top[seen]}))
            score[np.arange(len(own)), at] = -np.inf
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "other": [], "score": []})


def _keep_best(hits: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return hits.withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= n)


def _angles(values: pd.Series, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(values) @ centre.T, -1.0, 1.0))


def top_similar(vectors: DataFrame, n: int = 4, block_rows: int = BLOCK_ROWS, asked: DataFrame | None = None) -> DataFrame:
    """``id, other, score, puesto`` for the N most similar other vectors of each id.

    ``vectors`` has a unique ``id`` and an ``embedding`` array. With ``asked``, only
    the ids in it get neighbours, which are still sought among all vectors.
    """
    vectors = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(vectors.count() / block_rows) * 4))
    # At most MAX_PIVOTS vectors reach the driver.
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    if chosen.empty:
        return _keep_best(vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score")), n)
    centre = _unit(chosen["embedding"])
    references = min(REFERENCES, len(centre))

    def nearest(batches):
        for pdf in batches:
            angle = _angles(pdf["embedding"], centre)
            yield pdf.assign(cell=angle.argmin(axis=1).astype("int32"), angle=angle.min(axis=1), seen=list(angle[:, :references]))

    placed = vectors.mapInPandas(nearest, "id bigint, embedding array<double>, cell int, angle double, seen array<double>")
    placed = materialize(placed, "cells")
    ranges = [f(F.col("seen")[j]).alias(f"{name}{j}") for j in range(references) for name, f in (("lo", F.min), ("hi", F.max))]
    # One row per cell, so at most MAX_PIVOTS rows.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"), *ranges).toPandas()
    blocks = {int(c): math.ceil(r / block_rows) for c, r in zip(cells["cell"], cells["rows"], strict=True)}
    sizes = placed.sparkSession.createDataFrame(list(blocks.items()), "cell int, blocks int")
    placed = placed.join(F.broadcast(sizes), "cell").select(
        "id", "embedding", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    )
    if asked is None:
        placed = placed.withColumn("asked", F.lit(True))
    else:
        mark = asked.select("id").distinct().withColumn("asked", F.lit(True))
        placed = placed.join(mark, "id", "left").withColumn("asked", F.col("asked").isNotNull())

    own = ["cell", "block"]
    within = spread(placed, *own).groupBy(*own).applyInPandas(lambda pdf: _best(pdf[pdf["asked"]], pdf, n), _HITS)
    within = materialize(within, "within")
    # The score to beat: the N-th best inside the own block, if there are N.
    floor = within.groupBy("id").agg(
        F.when(F.count(F.lit(1)) == n, F.min("score")).otherwise(F.lit(-1.0)).alias("floor")
    )

    ids = cells["cell"].to_numpy()
    radius, centres = cells["radius"].to_numpy(), centre[ids]
    low = cells[[f"lo{j}" for j in range(references)]].to_numpy()
    high = cells[[f"hi{j}" for j in range(references)]].to_numpy()

    def visits(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start : start + 1024]
                seen = _angles(part["embedding"], centre[:references])
                # The least angle to a member of each cell, by its centre and by every reference.
                apart = np.maximum(0.0, _angles(part["embedding"], centres) - radius[None, :])
                for j in range(references):
                    apart = np.maximum(apart, np.maximum(low[None, :, j] - seen[:, j, None], seen[:, j, None] - high[None, :, j]))
                row, col = np.nonzero(np.cos(apart) + _SLACK >= part["floor"].to_numpy()[:, None])
                out = part[["id", "cell", "block"]].iloc[row].reset_index(drop=True)
                yield out.assign(visit=ids[col].astype("int32"))

    seekers = placed.where("asked").join(floor, "id", "left").select("id", "embedding", "cell", "block", F.coalesce("floor", F.lit(-1.0)).alias("floor"))
    queries = materialize(seekers.mapInPandas(visits, "id bigint, cell int, block int, visit int"), "visits")
    # Visitors of a cell come in slices, and its blocks are copied once per
    # slice: a cell that few vectors visit is hardly copied. One row per cell.
    counts = queries.groupBy("visit").count().collect()
    plan = [(r["visit"], blocks[r["visit"]], math.ceil(r["count"] / block_rows)) for r in counts]
    plan = F.broadcast(placed.sparkSession.createDataFrame(plan, "visit int, vblocks int, slices int"))
    met = (
        queries.join(plan, "visit")
        .withColumn("vblock", F.explode(F.sequence(F.lit(0), F.col("vblocks") - 1)))
        .where((F.col("cell") != F.col("visit")) | (F.col("block") != F.col("vblock")))
        .withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int"))
        .select("visit", "vblock", "slice", "id")
        .join(placed.select("id", F.col("embedding").alias("vector")), "id")
    )
    candidates = (
        placed.select(F.col("cell").alias("visit"), F.col("block").alias("vblock"), "id", "embedding")
        .join(plan, "visit")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("visit", "vblock", "slice", "id", "embedding")
    )
    key = ["visit", "vblock", "slice"]
    across = (
        spread(met, *key)
        .groupBy(*key)
        .cogroup(spread(candidates, *key).groupBy(*key))
        .applyInPandas(lambda left, right: _best(left.rename(columns={"vector": "embedding"}), right, n), _HITS)
    )
    return _keep_best(within.unionByName(across), n)
