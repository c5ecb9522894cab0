"""Exact top-k by inner product in three phases with a uniform threshold.

The components are dealt into slices; a slice of the query and of the candidates
gives each query a list of local scores, and a score is the sum of its local
scores. Phase one takes the k best of each list in each block of candidates;
the k-th best score among all of these is a safe cutoff. A candidate that reaches the
cutoff has a local score of at least cutoff / slices in some list: phase two takes
these entries from the lists, a small share of all, and phase three adds up
their scores and keeps what reaches the cutoff.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

BLOCK, QUERY_BLOCK, SLICES = 4096, 512, 2
LONG = (1 << 63) - 1
FOUND = "q long, number long, score long, copies long"
CHUNK = 1 << 18  # scores that are added up at once


def numbered_vectors(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, copies, number): floor(scale * x) of the vectors whose components are all finite.

    Equal rows are one with their number of copies. Numbers follow the ids, null ids
    last, so they stand for them in ties; partitions of a sort are in order.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = table.where(F.coalesce(fit, F.lit(False))).select(F.col(f"`{key}`").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    each = whole.groupBy("id", "v").agg(F.count("*").alias("copies")).orderBy(F.asc_nulls_last("id"), F.xxhash64("v"))
    return materialize(each.withColumn("number", F.monotonically_increasing_id()), "vectors")


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


class Meeting:
    """The local score lists of a part of the queries over a block of candidates."""

    def __init__(self, queries: pd.DataFrame, block: pd.DataFrame):
        width = max(queries["v"].map(len).max(), block["v"].map(len).max(), 1)
        block = block.sort_values("number")
        self.queries, self.numbers = queries["number"].to_numpy(), block["number"].to_numpy()
        q, c = _matrix(list(queries["v"]), width), _matrix(list(block["v"]), width)
        # The query's own row counts once less.
        self.copies = block["copies"].to_numpy()
        self.own = np.searchsorted(self.numbers, self.queries)
        self.own[(self.own == len(self.numbers)) | (self.numbers[np.minimum(self.own, len(self.numbers) - 1)] != self.queries)] = -1
        most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * width
        kind = float if most < 2**53 else object  # floats are exact there; Python numbers always
        self.q, self.c = q.astype(kind), c.astype(kind)
        self.lists = [self.q[:, s::SLICES] @ self.c[:, s::SLICES].T for s in range(SLICES)]

    def scores(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Whole scores of the entries (query row, candidate place)."""
        parts = [np.asarray((self.q[row[a : a + CHUNK]] * self.c[col[a : a + CHUNK]]).sum(axis=1)) for a in range(0, len(row), CHUNK)]
        out = np.concatenate(parts) if parts else np.empty(0)
        return np.array([max(-LONG, min(LONG, int(x))) for x in out], np.int64) if out.dtype == object else out.astype(np.int64)

    def others(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Copies of each entry, without the query's own row."""
        return self.copies[col] - (self.own[row] == col)

    def heads(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries among the k + 1 best of some list: one may be the query itself."""
        n = min(k + 1, len(self.numbers))
        kept = []
        for one in self.lists:
            place = np.argsort(-one, axis=1, kind="stable")[:, :n] if one.dtype == object else np.argpartition(-one, n - 1, axis=1)[:, :n]
            kept.append(place)
        col = np.sort(np.concatenate(kept, axis=1), axis=1)
        fresh = np.ones(col.shape, bool)
        fresh[:, 1:] = col[:, 1:] != col[:, :-1]
        row = np.repeat(np.arange(len(col)), col.shape[1])
        return row[fresh.ravel()], col.ravel()[fresh.ravel()]

    def sufficient(self, cutoffs: list) -> tuple[np.ndarray, np.ndarray]:
        """Entries with a local score of at least cutoff / slices in some list; all, for a query without cutoff."""
        least = np.array([-LONG if x is None or pd.isna(x) else int(x) for x in cutoffs], object if self.q.dtype == object else float)
        seen = np.zeros(self.lists[0].shape, bool)
        for one in self.lists:
            seen |= (one * SLICES >= least[:, None]).astype(bool)
        return np.nonzero(seen | (least == -LONG).astype(bool)[:, None])

    def best(self, row: np.ndarray, col: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
        """The first k entries of each query, ties to the smaller number."""
        copies = self.others(row, col)
        row, col, scores, copies = (x[copies > 0] for x in (row, col, scores, copies))
        by = np.lexsort((col, -scores, row))
        row, col, scores, copies = row[by], col[by], scores[by], copies[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < k
        return pd.DataFrame(
            {"q": self.queries[row[first]], "number": self.numbers[col[first]], "score": scores[first], "copies": copies[first]}
        )


def _head(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"q": [], "number": [], "score": [], "copies": []}, dtype="int64")
        met = Meeting(queries, block)
        row, col = met.heads(k)
        return met.best(row, col, met.scores(row, col), k)

    return run


def _rest(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"q": [], "number": [], "score": [], "copies": []}, dtype="int64")
        met = Meeting(queries, block)
        row, col = met.sufficient(list(queries["cutoff"]))
        scores = met.scores(row, col)
        least = np.array([-LONG if pd.isna(x) else int(x) for x in queries["cutoff"]], np.int64)
        enough = scores >= least[row]
        return met.best(row[enough], col[enough], scores[enough], k)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query, copies as rows of their own, with their rank."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "number").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).where(F.col("before") < k)
    places = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))
    return ranked.select("q", "number", "score", F.explode(places.cast("array<int>")).alias("rank"))


def top_k(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best other rows, ties to the smaller id, null ids last.

    Queries are the rows whose id is divisible by ``every``. Each of several rows with one
    id, and each of several equal rows, is a query and a candidate of its own. Vectors
    that are null or have a null or non-finite component take no part; shorter ones
    are filled with 0. Scores beyond a long become the largest long. Other columns are ignored.
    """
    rows = numbered_vectors(table, key, vector, scale)
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-rows.count() // BLOCK))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    spark = rows.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * parts, 4 * spark.sparkContext.defaultParallelism))

    def meet(asked: DataFrame, run) -> DataFrame:
        """The answers of every block of candidates to every part of the queries."""
        numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")
        left = asked.withColumn("part", F.pmod(F.xxhash64("number", F.lit(1)), F.lit(parts))).withColumn("block", F.explode(numbers(blocks)))
        # Columns of their own, since both sides come from one table.
        right = rows.select(*[F.col(c).alias(c) for c in ("number", "v", "copies")], F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block"))
        right = right.withColumn("part", F.explode(numbers(parts)))
        dealt = [side.repartition(slots, "block", "part").groupBy("block", "part") for side in (left, right)]
        return dealt[0].cogroup(dealt[1]).applyInPandas(run, FOUND)

    heads = _first(meet(queries.select("number", "v"), _head(k)), k)
    cutoffs = materialize(heads.where(F.col("rank") == k).select("q", F.col("score").alias("cutoff")), "cutoffs")
    asked = queries.select("number", "v").join(cutoffs, F.col("number") == F.col("q"), "left").drop("q")
    found = _first(meet(asked, _rest(k)), k)
    out = found.join(queries.select(F.col("number").alias("q"), F.col("id").alias("query_id"), F.col("copies").alias("_times")), "q")
    out = out.join(rows.select("number", F.col("id").alias("vec_id")), "number")
    once = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy")
    return out.select("query_id", "rank", "vec_id", "score", once).drop("_copy")
