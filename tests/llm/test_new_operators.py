"""SimHash near duplicates, hard negatives and periodic runs against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basketry.llm import covertree, periodic, simhash
from basketry.llm.queries import QUERIES, with_periodic_tails

DOCS = "doc_id long, text string, fp string, runs string, collapsed string, id string"


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def plain_components(rows, distance=4):
    """Least id of each row's component; rows are (id, fingerprint)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if ((rows[a][1] ^ rows[b][1]) & (1 << 64) - 1).bit_count() <= distance:
            root[max(find(a), find(b))] = min(find(a), find(b))
    members = {}
    for i, (id_, _) in enumerate(rows):
        members.setdefault(find(i), []).append(id_)
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_simhash_of_the_query_equals_brute_force(spark, small):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op11_simhash_dedup"](spark, small).collect()
    rows = [(i, plain_fingerprint(t)) for i, t in table.items()]
    want = dict(zip(table, plain_components(rows), strict=True))
    assert len(got) == len(table)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{v & (1 << 64) - 1:016x}" for i, v in rows}


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    data = [
        (5, "One two"), (6, "one\ttwo"), (7, None), (8, ""), (9, "  \n"), (3, "a b c d e f"), (3, "something else than that"), (None, "A b c d e F"),
        (None, "alone with no id"), (1, long), (2, long + " end"), (4, "a b c d e f"), (4, "a b c d e f"),
    ]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], DOCS)
    got = sorted(((r.id, r.fingerprint, r.component_id) for r in simhash.near_components(docs).collect()), key=str)
    rows = [(i, plain_fingerprint(t)) for i, t in data]
    assert got == sorted(((*r, c) for r, c in zip(rows, plain_components(rows), strict=True)), key=str)
    assert {c for i, _, c in got if i in (7, 8, 9)} == {7} and (None, plain_fingerprint("a b c d e f"), 3) in got
    assert simhash.near_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 4, 7])
def test_pigeonring_join_loses_no_link(spark, distance):
    rng = random.Random(distance)
    centers = [rng.getrandbits(64) for _ in range(30)]
    values = set()
    for c in centers:
        for _ in range(12):
            v = c
            for bit in rng.sample(range(64), rng.randrange(0, distance + 3)):
                v ^= 1 << bit
            values.add(v - (1 << 64) if v >> 63 else v)
    parts = simhash.segments(distance)
    assert sum(w for _, w in parts) == 64
    table = spark.createDataFrame([(v, v) for v in values], "fp long, root long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash._across(table, parts, distance).collect()}
    want = {
        tuple(sorted((a, b))) for a, b in itertools.combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance
    }
    assert len(want) > 50 and got == want


def test_simhash_cloud_of_near_copies(spark):
    """A dense cloud contracts to one component without all of its pairs."""
    rng = random.Random(3)
    center, active = rng.getrandbits(63), rng.sample(range(64), 9)
    cloud = set()
    for k in range(1 << 9):
        v = center
        for j, bit in enumerate(active):
            v ^= (k >> j & 1) << bit
        cloud.add(v - (1 << 64) if v >> 63 else v)
    classes = spark.createDataFrame([(v,) for v in cloud], "fp long")
    parts = simhash.segments(4)
    links = simhash._stars(classes, parts, 4, 4).union(simhash._stars(classes, parts, 3, 4))
    assert links.count() <= 20 * len(cloud)
    assert simhash._labelled(classes, links, "cloud").select("root").distinct().count() == 1


def test_few_fingerprints_are_few_files(spark):
    """The number of files follows the rows, not the partitions of the shuffles."""
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.rglob("part-*"))
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        data = [(i, f"word{i % 7} and some more of text {i % 5} " * 9) for i in range(300)]
        rows = [(i, plain_fingerprint(t)) for i, t in data]
        got = simhash.near_components(spark.createDataFrame(data, "doc_id long, text string")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted((*r, c) for r, c in zip(rows, plain_components(rows), strict=True))
    assert sorted((r.id, r.fingerprint, r.component_id) for r in got) == want
    files = Counter(f.parent.name.rpartition("-")[0] for f in set(folder.rglob("part-*")) - before)
    folders = Counter(d.rpartition("-")[0] for d in {f.parent.name for f in set(folder.rglob("part-*")) - before})
    assert folders["links"] >= 4 and files["links"] == folders["links"]
    assert files["fingerprint-classes"] == files["fingerprint-roots"] == files["clouds"] == files["cloud-links"] == 1


def plain_runs(w, exponent=4, least=6):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            whole = j > i and size >= max(least, exponent * q)
            if whole and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(13)
    seen = 0
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3])
        w = [bytes([97 + rng.randrange(letters)]) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5 and w:
            p, s = rng.randrange(1, 7), rng.randrange(len(w))
            w = [w[i] if i < s else w[min(s + (i - s) % p, len(w) - 1)] for i in range(len(w))]
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            want = plain_runs(w, exponent, least)
            assert periodic.runs_of(w, exponent, least) == want
            seen += len(want)
    assert seen > 5000


def test_common_extensions_are_those_of_the_words():
    rng = random.Random(4)
    s = [rng.randrange(2) for _ in range(200)]
    ahead = periodic.Extensions(s)
    pairs = [(i, j) for i in range(0, 200, 7) for j in range(200) if i != j]
    got = ahead.common(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    for (i, j), n in zip(pairs, got.tolist(), strict=True):
        want = 0
        while max(i, j) + want < 200 and s[i + want] == s[j + want]:
            want += 1
        assert n == want
    assert ahead.rank.argsort().tolist() == sorted(range(201), key=lambda i: s[i:])


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {k for i, size, q in runs for k in range(i + q, i + size)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{i},{size},{q}\n" for i, size, q in runs)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_the_query_equal_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, small).collect())
    assert got == sorted(plain_row(r.doc_id, r.text) for r in table)
    assert sum(r[1] for r in got) > 5


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "x " + "b c " * 4, long + " y" * 50_000, "é é é é é é ü"]
    docs = spark.createDataFrame([(i if i else None, t, "x", "x", "x", "x") for i, t in enumerate([*texts, texts[4]])], DOCS)
    rows = periodic.find_runs(docs).collect()
    assert [[tuple(x) for x in r.runs] for r in rows] == [
        [], [], [], [], [(0, 6, 1)], [(1, 8, 2)], [(9000, 50_000, 1)], [(0, 6, 1)], [(0, 6, 1)],
    ]
    assert [r.collapsed for r in rows] == ["", "", "", "a a a a a", "a", "x b c", long + " y", "é ü", "a"]
    assert rows[3].id == "x" and "fp" in rows[3].asDict()
    assert periodic.find_runs(docs.limit(0)).count() == 0
    words = " ".join(str(i) for i in range(50))
    planted = spark.createDataFrame([(i, words) for i in range(60)] + [(None, words)], "doc_id long, text string")
    for r in with_periodic_tails(planted).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        a, p = h // 10 % 50, 1 + (50 - h // 10 % 50) // (3 + h // 10 % 8)
        turned = r.doc_id is not None and h % 10 == 0
        assert r.text.split() == [str(i if not turned or i < a else a + (i - a) % p) for i in range(50)]


def plain_negatives(rows, every=100, positives=5, negatives=10):
    """rows: (id, label, integer vector)."""
    far = float("inf")
    order = lambda s: (-s[0], far if rows[s[1]][0] is None else rows[s[1]][0])
    out = []
    for a, (id_, label, v) in enumerate(rows):
        if id_ is None or id_ % every:
            continue
        scores = [(sum(x * y for x, y in itertools.zip_longest(v, w, fillvalue=0)), b) for b, (_, _, w) in enumerate(rows) if b != a]
        for ps, p in sorted((s for s in scores if rows[s[1]][1] == label), key=order)[:positives]:
            fit = [s for s in scores if rows[s[1]][1] != label and 30 * ps <= 100 * s[0] <= 90 * ps]
            for rank, (ns, b) in enumerate(sorted(fit, key=order)[:negatives], 1):
                out.append((id_, rows[p][0], rank, rows[b][0], ps, ns))
    return sorted(out, key=str)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_the_query_equal_brute_force(spark, small):
    rows = []
    for r in spark.read.parquet(f"{small}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * float(x))) for x in r.embedding]))
    got = sorted((tuple(r) for r in QUERIES["op12_hard_negatives"](spark, small).collect()), key=str)
    assert len(got) > 100 and got == plain_negatives(rows)


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "ANCHORS", 2)
    monkeypatch.setattr(covertree, "LEAF", 4)
    rng = random.Random(12)
    spots = [[rng.uniform(-4, 4) for _ in range(3)] for _ in range(6)]
    rows = []
    for k in range(300):
        v = [x + rng.uniform(-0.2, 0.2) for x in rng.choice(spots)] if k % 3 else rng.choice(spots)
        rows.append((rng.choice([None, *range(0, 120, 5)]), rng.randrange(3), v[: rng.choice([2, 3, 3])]))
    rows += [(100, 1, spots[0])] * 14 + [(100, 2, spots[0])] * 12 + [(200, 1, [0.0, 0.0, 0.0]), (300, 2, [])]
    whole = [(i, str(c), [int(np.floor(256 * x)) for x in v]) for i, c, v in rows]
    bad = [(1, None, [1.0]), (2, 1, None), (100, 1, [None, 1.0]), (100, 1, [float("nan")]), (0, 1, [float("inf")])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, label int, embedding array<double>, number string, copies int")
    got = covertree.hard_negatives(table).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(whole)
    assert covertree.hard_negatives(table.limit(0)).count() == 0


def test_cover_tree_covers_and_separates(monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 4)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(-50, 50, (300, 4)), np.repeat(rng.integers(-50, 50, (1, 4)), 100, axis=0)])
    tree = covertree.cover_tree(x)
    points, norm = covertree.augmented(x)
    assert sorted(tree["order"].tolist()) == list(range(400))
    assert np.allclose((points**2).sum(axis=1), norm**2)

    def below(node):
        own = tree["order"][tree["first_point"][node] : tree["last_point"][node]].tolist()
        return own + [p for kid in range(tree["first_kid"][node], tree["last_kid"][node]) for p in below(kid)]

    depth = 0
    for node, (center, radius) in enumerate(zip(tree["centers"], tree["radii"], strict=True)):
        assert np.sqrt(((points[below(node)] - points[center]) ** 2).sum(axis=1)).max() <= radius + 1e-9
        kids = list(range(tree["first_kid"][node], tree["last_kid"][node]))
        depth = max(depth, len(kids))
        for a, b in itertools.combinations(kids, 2):
            apart = np.sqrt(((points[tree["centers"][a]] - points[tree["centers"][b]]) ** 2).sum())
            assert apart > radius / covertree.BASE - 4 * covertree.SAFE * norm
    assert depth > 1
