"""Building blocks that split hot groups, against brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry import session
from basketry.functions import factors, quantiles
from basketry.functions.ranking import dense_position, number_rows, range_chunks, running_sums
from basketry.operators import basket, recommend
from basketry.operators.similar import top_similar


def test_running_sums_of_a_hot_key(spark):
    data = [(0 if i % 3 else i % 5, i // 40, i, (i * 7) % 11 - 3) for i in range(400)]
    df = spark.createDataFrame(data, "k int, chunk int, pos int, v bigint")
    got = {r["pos"]: r["s"] for r in running_sums(df, ["k"], "chunk", ["pos"], {"s": F.col("v")}).collect()}
    seen, want = {}, {}
    for k, _, pos, v in data:
        want[pos] = seen.get(k, 0)
        seen[k] = want[pos] + v
    assert got == want


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(300)], "p bigint")
    got = number_rows(df, ["p"], "n").orderBy("p").collect()
    assert [r["n"] for r in got] == list(range(1, 301))
    alike = spark.createDataFrame([(f"same beginning {i * 37 % 1000:04}",) for i in range(300)], "p string")
    cut = range_chunks(alike, ["p"], "alike").groupBy("chunk").count().collect()
    assert len(cut) == 4 and max(r["count"] for r in cut) < 150  # one beginning, several chunks
    assert [r["n"] for r in number_rows(alike, ["p"], "n").orderBy("p").collect()] == list(range(1, 301))
    names = spark.createDataFrame([(n,) for n in ("Verduras", "Bebidas", "Snacks", "Panadería", "Sin categoría")], "n string")
    got = {r["n"]: r["i"] for r in dense_position(names, "n", "i", start=0).collect()}
    assert got == {"Bebidas": 0, "Panadería": 1, "Sin categoría": 2, "Snacks": 3, "Verduras": 4}


@pytest.mark.parametrize("shape", ["spread", "skewed", "few", "constant"])
def test_quantiles_are_exact(spark, monkeypatch, shape):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    monkeypatch.setattr(quantiles, "SMALL", 20)
    rng = np.random.default_rng(5)
    values = {
        "spread": rng.normal(size=700),
        "skewed": np.exp(rng.normal(size=700) * 4),
        "few": rng.integers(0, 4, size=700).astype(float),
        "constant": np.full(50, 3.5),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, ["x"], probs)["x"]
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert np.isnan(quantiles.exact_quantiles(df, ["x"], [0.5])["x"]).all()


def test_pairs_of_a_hot_sale(spark):
    lines = [(1, p) for p in range(40)] * 2 + [(s, p) for s in range(2, 30) for p in (s % 4, s % 7, 50)]
    df = spark.createDataFrame(lines, "venta_id bigint, producto_id bigint")
    want = {}
    for s in {s for s, _ in lines}:
        for pair in permutations({p for t, p in lines if t == s}, 2):
            want[pair] = want.get(pair, 0) + 1
    counts = basket.mirrored(basket.pair_counts(df, block=6), "n")
    assert {(r["p1"], r["p2"]): r["n"] for r in counts.collect()} == want
    assert basket.copurchase_pairs(df, block=6).count() == len(want)
    row = basket.copurchase_matrix(df, block=6).where("product_a = 50 and product_b = 0").first()
    assert row["confidence"] == pytest.approx(want[(50, 0)] / 28)


def _brute(ids, vectors, n):
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    score = np.round(unit @ unit.T, 9)
    out = {}
    for i, one in enumerate(ids):
        best = sorted(((-score[i, j], other) for j, other in enumerate(ids) if other != one))[:n]
        out[one] = [other for _, other in best]
    return out


@pytest.mark.parametrize("block", [25, 1000])
def test_top_similar_is_exact(spark, block):
    """Clusters, a third of exact copies, and zero vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8)) * 4
    vectors = np.concatenate(
        [centres[rng.integers(0, 5, 120)] + rng.normal(size=(120, 8)) * 0.2, np.tile(centres[0], (70, 1)), np.zeros((4, 8))]
    )
    vectors = np.round(vectors, 3)
    ids = list(range(100, 100 + len(vectors)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "id bigint, embedding array<double>")
    got = {}
    for r in top_similar(df, 4, block_rows=block).orderBy("id", "puesto").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == _brute(ids, vectors, 4)
    asked = spark.createDataFrame([(i,) for i in (*ids[::9], ids[-1], 5)], "id bigint")
    some = {}
    for r in top_similar(df, 4, block_rows=block, asked=asked).orderBy("id", "puesto").collect():
        some.setdefault(r["id"], []).append(r["other"])
    assert some == {i: got[i] for i in {*ids[::9], ids[-1]}}


def test_recommendations_for_some_products(spark, rows):
    """Those asked for get the list they have among all: by vectors, or by category without one."""
    snapshot = spark.createDataFrame([(i, f"n{i}", f"c{i % 2}") for i in range(12)], "id bigint, nombre string, categoria string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(i,) for i in (2, 7, 9)], "id bigint")
    whole = recommend.recommendations(vectors, snapshot)
    got = rows(recommend.recommendations(vectors, snapshot, asked=asked))
    assert got == rows(whole.where("id in (2, 7, 9)")) and len(got) == 12


def test_same_category_without_pairs(spark):
    data = [(i, f"n{i}", "big" if i % 5 else f"c{i % 3}") for i in range(200)] + [(999, "alone", "single")]
    df = spark.createDataFrame(data, "id bigint, nombre string, categoria string")
    got = {}
    for r in recommend.same_category(df, 4).orderBy("id", "puesto").collect():
        got.setdefault(r["id"], []).append(r["other"])
    want = {i: [j for j, _, d in sorted(data) if d == c and j != i][:4] for i, _, c in data}
    assert got == {k: v for k, v in want.items() if v}


def test_vectors_train_for_all_rounds(spark):
    lines = spark.createDataFrame([(s, p) for s in range(20) for p in (s % 3, 3 + s % 2)], "venta_id bigint, producto_id bigint")
    pairs = basket.pair_counts(lines)
    vectors = lambda **how: {r["id"]: r["embedding"] for r in recommend.product_vectors(pairs, lines, **how).collect()}
    default = vectors()
    assert default != vectors(iterations=5) and default == vectors(iterations=30)


def test_product_vectors(spark):
    lines = spark.createDataFrame([(s, p) for s in range(20) for p in (s % 3, 3 + s % 2)] + [(99, 77)], "venta_id bigint, producto_id bigint")
    pairs = basket.pair_counts(lines)
    got = {r["id"]: r["embedding"] for r in recommend.product_vectors(pairs, lines, iterations=2).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 77}
    assert all(len(v) == 32 and min(v) >= 0 for v in got.values())
    assert set(got[77]) == {0.0}
    alone = recommend.product_vectors(pairs.limit(0), lines)
    assert alone.count() == 6


def test_pair_tasks_follow_the_lines(spark, monkeypatch):
    """However few bytes the lines have, a task makes the pairs of a bounded number of them."""
    monkeypatch.setattr(basket, "_LINES", 10)
    lines = spark.range(600).select(F.floor(F.col("id") / 3).alias("venta_id"), (F.col("id") % 50).alias("producto_id"))
    made = basket._pairs_per_sale(lines)
    assert made.rdd.getNumPartitions() >= 60
    assert made.count() == 600


def test_training_removes_files_of_past_rounds(spark):
    """Checkpoints of each round, in the shared folder, and a driver that collects while it trains."""
    with session.short_lineage(spark, seconds=0.1):
        assert spark.sparkContext.getCheckpointDir()
    rows = spark.createDataFrame([(a, a + 1) for a in range(40)], "a long, b long")
    lines = rows.select(F.col("a").alias("producto_id")).union(rows.select("b"))
    kept = []
    fit = recommend.ALS.fit
    try:
        recommend.ALS.fit = lambda self, df: kept.append(self.getCheckpointInterval()) or fit(self, df)
        assert recommend.product_vectors(rows, lines, iterations=3).count() == 41
    finally:
        recommend.ALS.fit = fit
    assert kept == [1]


def _als(spark, pairs, rounds):
    """Vectors by Spark's own ALS."""
    blocks = spark.sparkContext.defaultParallelism
    als = recommend.ALS(
        rank=32, numUserBlocks=blocks, numItemBlocks=blocks, implicitPrefs=True, nonnegative=True, maxIter=rounds, seed=42,
        userCol="p1", itemCol="p2", ratingCol="r",
    )
    model = als.fit(basket.mirrored(pairs).select(F.col("p1").cast("int"), F.col("p2").cast("int"), F.lit(1.0).alias("r")))
    return {r["id"]: r["features"] for r in model.userFactors.collect()}


def test_vector_tasks_follow_the_links(spark, monkeypatch):
    """A task solves a bounded number of links, and the vectors are those of Spark's ALS: with a hub, repeated pairs and negative ids."""
    monkeypatch.setattr(factors, "PLAIN_LINKS", 0)
    monkeypatch.setattr(factors, "PART_LINKS", 100)
    rows = [(0, b) for b in range(1, 150)] + [(a, a + d) for a in range(1, 140) for d in (1, 1, 7)] + [(-5, -3), (2**31 - 1, 4)]
    pairs = spark.createDataFrame(rows, "a long, b long")
    parts = []
    deal = factors._packed_links
    monkeypatch.setattr(factors, "_packed_links", lambda links, n: parts.append(n) or deal(links, n))
    sold = spark.createDataFrame([(p,) for row in rows for p in row], "producto_id long")
    got = {r["id"]: r["embedding"] for r in recommend.product_vectors(pairs, sold, iterations=4).collect()}
    want = _als(spark, pairs, 4)
    assert parts[0] >= 2 * len(rows) / 100
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-5 for p in want for x, y in zip(got[p], want[p], strict=True))


def test_nonnegative_least_squares():
    """Every solution is at least zero, and its slope is zero where it is above, from any first guess."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=(200, 9, 6))
    left = base.transpose(0, 2, 1) @ base + 0.01 * np.eye(6)
    right = draw.normal(size=(200, 6))
    right[0] = 0.0
    for guess in (np.ones((200, 6), bool), np.zeros((200, 6), bool), draw.random((200, 6)) < 0.5):
        x = factors.nonnegative(left, right, guess)
        slope = (left @ x[:, :, None])[:, :, 0] - right
        assert x.min() >= 0 and slope.min() > -1e-8 and np.abs(slope[x > 0]).max() < 1e-8


def test_links_are_packed_and_summed_in_pieces(monkeypatch):
    """However the links are cut, a product's matrix and right side add up all of its links."""
    draw = np.random.default_rng(5)
    counts = np.array([1, 3, 40, 2, 5, 17], dtype="int32")
    vectors, index = draw.random((30, 4), dtype="float32"), draw.integers(0, 30, counts.sum()).astype("int32")
    own = np.repeat(np.arange(6, dtype="int32"), counts)
    whole = factors._normal(vectors, np.eye(4), (1.0, 0.1), counts, index)
    monkeypatch.setattr(factors, "_STEP_LINKS", 8)
    cut = factors._normal(vectors, np.eye(4), (1.0, 0.1), counts, index)
    assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(whole, cut, strict=True))
    assert np.allclose(whole[1][1], 2 * vectors[index[1:4]].astype("float64").sum(axis=0))
    monkeypatch.setattr(factors, "CHUNK_LINKS", 10)
    held = [
        (*np.unique(own[at : at + 7], return_counts=True), index[at : at + 7].copy(), index[at : at + 7] % 3) for at in range(0, len(own), 7)
    ]
    made = {"head": [], "link": [], "want": []}
    for record in factors._pack_part(1, held, 3):
        made[record["kind"][0]].append(record.iloc[0])
    read = lambda kind, column, dtype="int32": np.concatenate([np.frombuffer(r[column], dtype) for r in made[kind]])
    asked = read("want", "ids")
    assert (read("head", "ids") == np.arange(6)).all() and (read("link", "ids") == counts).all() and len(made["link"]) > 1
    assert (asked[read("link", "more")] == index).all()
    assert [(r["part"], r["first"]) for r in made["want"]] == [(0, 1), (1, 1), (2, 1)]
    assert (read("head", "more", "int64") == np.cumsum([0, *(len(r["ids"]) // 4 for r in made["want"])])).all()
