"""Hard negatives by exact search in cover trees.

Candidates are dealt by hash into blocks of bounded size, and a task builds a
cover tree over each block. Vectors get one more component, so that all of a block
have the same norm M: they lie on a sphere, and an inner product with an anchor q
depends on the angle alone. A node covers its vectors with a radius around its
centre; the centres of a level are further apart than the level's radius, which
shrinks by ``BASE`` from level to level. With t the angle of the radius and f that
between q and the centre, all products of the node lie from |q| M cos(f + t) to
|q| M cos(f - t).

An anchor descends best bound first. It skips nodes outside all of its windows or
below the last score each window still needs, and computes the products of
the vectors it reaches exactly, as integers. The trees are written once. Two
descents use them: for the nearest rows of the anchor's label, then for the rows
of other labels in the windows that the former set.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

BLOCK, ANCHORS, LEAF = 4096, 512, 128
BASE = 1.3
SAFE = 1e-6  # share of the norm by which bounds are widened against rounding
LONG = (1 << 63) - 1

TREE = (
    "block long, numbers array<bigint>, labels array<string>, copies array<bigint>, width int, vectors array<bigint>, norm double, "
    "centers array<int>, radii array<double>, first_kid array<int>, last_kid array<int>, first_point array<int>, last_point array<int>"
)
FOUND = "a long, positive_score long, number long, score long, copies long"


def matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def augmented(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors with a component that gives all of them the largest norm."""
    x = x.astype(float)
    squares = (x * x).sum(axis=1)
    most = squares.max(initial=0.0)
    return np.hstack([x, np.sqrt(most - squares)[:, None]]), math.sqrt(most)


def cover_tree(x: np.ndarray) -> dict:
    """Flat arrays of a cover tree over ``x``: nodes level by level, and the order of the vectors in which each node's own stand together."""
    points, norm = augmented(x)
    slack = SAFE * norm
    centers, radii, kids, own, order = [], [], [], [], []

    def distances(at: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * norm * norm - 2 * (points[at] @ points[center]), 0.0)) + slack

    todo = [np.arange(len(x))]
    for members in todo:  # grows while it is read: children of a node stand together
        center = members[0]
        far = distances(members, center)
        radius = far.max(initial=0.0)
        centers.append(center)
        radii.append(radius)
        first = len(todo)
        single = members
        if len(members) > LEAF and radius > 2 * slack:
            single, rest, reach = [], members, radius / BASE
            while len(rest):
                near = distances(rest, rest[0]) <= reach
                near[0] = True
                group, rest = rest[near], rest[~near]
                if len(group) <= LEAF:
                    single.extend(group)  # fewer vectors than a node is worth: the parent checks them itself
                else:
                    todo.append(group)
        kids.append((first, len(todo)))
        own.append((len(order), len(order) + len(single)))
        order.extend(single)
    return {
        "order": np.array(order, np.int64), "norm": norm, "centers": centers, "radii": radii,
        "first_kid": [k[0] for k in kids], "last_kid": [k[1] for k in kids],
        "first_point": [p[0] for p in own], "last_point": [p[1] for p in own],
    }


class Search:
    """Descents in one stored tree."""

    def __init__(self, tree):
        self.numbers = np.array(tree.numbers, np.int64)
        self.labels = np.array(tree.labels, object)
        self.copies = np.array(tree.copies, np.int64)
        self.whole = np.array(tree.vectors, np.int64).reshape(len(self.numbers), -1)
        self.largest = int(np.abs(self.whole.astype(float)).max(initial=0.0))
        points, self.norm = augmented(self.whole)
        self.centers = points[np.array(tree.centers, np.int64)][:, :-1]
        self.angles = 2 * np.arcsin(np.clip(np.array(tree.radii) / (2 * self.norm or 1.0), 0.0, 1.0)) + SAFE
        self.kids = list(zip(tree.first_kid.tolist(), tree.last_kid.tolist(), strict=True))
        self.points = list(zip(tree.first_point.tolist(), tree.last_point.tolist(), strict=True))
        self.floats = self.whole.astype(float)

    def bounds(self, nodes: slice, q: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible product of q with the vectors below the nodes."""
        scale = length * self.norm
        angle = np.arccos(np.clip(self.centers[nodes] @ q / (scale or 1.0), -1.0, 1.0))
        reach = self.angles[nodes]
        return scale * (np.cos(np.minimum(angle + reach, np.pi)) - SAFE), scale * (np.cos(np.maximum(angle - reach, 0.0)) + SAFE)

    def products(self, at: slice, q: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.floats[at] @ q.astype(float)).astype(np.int64)
        whole = self.whole[at].astype(object) @ q.astype(object)
        return np.array([max(-LONG, min(LONG, s)) for s in whole], np.int64)

    def best(self, q: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int, self_number: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window the places and scores of the first k allowed vectors, copies counted."""
        width = self.whole.shape[1]
        q = np.pad(q[:width], (0, max(0, width - len(q))))  # the tree's vectors are 0 beyond their width
        exact = float(np.abs(q.astype(float)).max(initial=0.0)) * self.largest * width < 2.0**53
        real = q.astype(float)
        length = math.sqrt(float(real @ real))
        least = [w[0] for w in windows]  # raised to the last score needed once k are found
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        found = [none] * len(windows)
        low, high = self.bounds(slice(0, 1), real, length)
        waiting = [(-high[0], 0, low[0])]
        while waiting:
            top, node, bottom = heapq.heappop(waiting)
            if not any(-top >= least[w] and bottom <= windows[w][1] for w in range(len(windows))):
                continue
            at = slice(*self.points[node])
            if at.stop > at.start:
                scores = self.products(at, q, exact)
                fit = np.flatnonzero(allowed[at] & (scores >= min(least)))
                scores = scores[fit]
                for w, (_, most) in enumerate(windows):
                    good = np.flatnonzero((scores >= least[w]) & (scores <= most))
                    if not len(good):
                        continue
                    places = np.concatenate([found[w][0], fit[good] + at.start])
                    values = np.concatenate([found[w][1], scores[good]])
                    if len(places) > 8 * k:
                        floor = np.partition(values, len(values) - 2 * k)[len(values) - 2 * k]
                        places, values = places[values >= floor], values[values >= floor]
                    by = np.lexsort((self.numbers[places], -values))
                    places, values = places[by], values[by]
                    held = np.cumsum(self.copies[places] - (self.numbers[places] == self_number))
                    need = int(np.searchsorted(held, k)) + 1
                    found[w] = places[:need], values[:need]
                    if need <= len(places):
                        least[w] = max(least[w], int(values[need - 1]))
            a, b = self.kids[node]
            if b > a:
                low, high = self.bounds(slice(a, b), real, length)
                for i in range(b - a):
                    heapq.heappush(waiting, (-high[i], a + i, low[i]))
        return found


def _plant(group: pd.DataFrame) -> pd.DataFrame:
    width = max(group["v"].map(len).max(), 1)
    x = matrix(list(group["v"]), width)
    tree = cover_tree(x)
    by = tree.pop("order")
    tree["centers"] = np.argsort(by)[tree["centers"]]  # places in the tree's own order
    row = {"block": group["block"].iloc[0], "width": width, "vectors": x[by].ravel(), **tree}
    row |= {"numbers": group["number"].to_numpy()[by], "labels": group["label"].to_numpy()[by], "copies": group["copies"].to_numpy()[by]}
    return pd.DataFrame({k: [v] for k, v in row.items()})


def _descend(same: bool, k: int, low: int, high: int):
    """A function of (key, tree, anchors) that finds rows of the anchors' own label, or of others in the windows of their positives."""

    def run(trees: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for tree in trees.itertuples():
            search = Search(tree)
            masks = {label: (search.labels == label) == same for label in set(anchors["label"])}
            for a in anchors.itertuples():
                if same:
                    wanted, windows = [None], [(-LONG, LONG)]
                else:
                    wanted = sorted({int(s) for s in a.scores})
                    windows = [(-(-low * s // 100), high * s // 100) for s in wanted]
                for s, (places, scores) in zip(wanted, search.best(np.array(a.v, np.int64), masks[a.label], windows, k, a.number), strict=True):
                    for p, score in zip(places.tolist(), scores.tolist(), strict=True):
                        copies = int(search.copies[p]) - (search.numbers[p] == a.number)
                        if copies:
                            out.append((a.number, s, search.numbers[p], score, copies))
        return pd.DataFrame(out, columns=["a", "positive_score", "number", "score", "copies"]).astype(
            {"a": "int64", "positive_score": "Int64", "number": "int64", "score": "int64", "copies": "int64"}
        )

    return run


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k of each group, copies as rows of their own, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "number").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).where(F.col("before") < k)
    places = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))
    return ranked.select(*keys, "number", "score", F.explode(places.cast("array<int>")).alias("rank"))


def hard_negatives(
    table: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. A component x counts as
    floor(scale * x). The positives of an anchor are the first other rows of its
    label; negatives are the first rows of other labels whose score is from
    ``low`` to ``high`` percent of the positive's. Higher scores come first, then smaller
    ids, null ids last. Rows with a null label or vector, or with a null or
    non-finite component, take no part. Each of several rows with one id, and each of
    several equal rows, is a row of its own. Shorter vectors are filled with 0.
    Scores beyond a long become the largest long. Anchors without a positive, and
    positives without a negative, give no row. Other columns are ignored.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = table.where(F.col(f"`{label}`").isNotNull() & F.coalesce(fit, F.lit(False))).select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")
    )
    each = whole.groupBy("id", "label", "v").agg(F.count("*").alias("copies"))
    # Numbers follow the ids, so they stand for them in ties; partitions of a sort are in order.
    sorted_ = each.orderBy(F.asc_nulls_last("id"), "label", F.xxhash64("v"))
    rows = materialize(sorted_.withColumn("number", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(F.col("id") % every == 0).select("number", "label", "v", "id", "copies")
    blocks = max(1, -(-rows.count() // BLOCK))
    parts = max(1, -(-anchors.count() // ANCHORS))
    slots = max(1, min(blocks * parts, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    slots = max(slots, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks))).repartition(slots, "block")
    trees = materialize(blocked.select("block", "number", "label", "v", "copies").groupBy("block").applyInPandas(_plant, TREE), "cover-trees")

    def meet(wanted: DataFrame, run) -> DataFrame:
        """The trees' answers to the anchors in ``wanted``, one group per tree and part of the anchors."""
        part = F.pmod(F.xxhash64(F.col("number"), F.lit(1)), F.lit(parts))
        left = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
        right = wanted.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        dealt = [side.repartition(slots, "block", "part").groupBy("block", "part") for side in (left, right)]
        return dealt[0].cogroup(dealt[1]).applyInPandas(run, FOUND)

    near = meet(anchors.select("number", "label", "v"), _descend(True, positives, low, high))
    chosen = materialize(_first(near.drop("positive_score"), positives, "a"), "positives")
    scores = chosen.groupBy("a").agg(F.collect_set("score").alias("scores"))
    asking = anchors.select("number", "label", "v").join(scores, F.col("number") == F.col("a")).drop("a")
    hard = _first(meet(asking, _descend(False, negatives, low, high)), negatives, "a", "positive_score")
    pairs = chosen.select("a", F.col("number").alias("p"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank"))
    out = hard.withColumnRenamed("score", "negative_score").join(pairs, ["a", "positive_score"])
    ids = rows.select(F.col("number").alias("n"), "id")
    out = out.join(anchors.select(F.col("number").alias("a"), F.col("id").alias("anchor_id"), "copies"), "a")
    out = out.join(ids, out.p == ids.n).drop("n", "p").withColumnRenamed("id", "positive_id")
    out = out.join(ids, out.number == ids.n).drop("n").withColumnRenamed("id", "negative_id")
    once = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return out.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score", once).drop("_copy")
