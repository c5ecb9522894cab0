"""The text operators against plain Python on small tables."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from basketry.llm import bpe, linededup, minhash, mixing, quality, sharding, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string"
NOUNS = [f"w{i}x" for i in range(400)]


def words(start, n):
    return " ".join(NOUNS[(start * 7 + i * (start % 5 + 1)) % 400] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(3, 120)
    changed = base.replace("w21x", "zzz", 1)
    passage = words(11, 60)
    rows = [
        (1, base), (2, base), (3, changed), (4, None), (5, ""), (6, " \n\t "), (7, "One two"), (8, "one TWO"),
        (9, f"alpha beta\n{passage}\nlast line"), (10, f"gamma\n{passage}\nother end"), (11, words(9, 30000)),
        (12, "é ñ ü <|endoftext|> it's 123   \n\n  a"), (12, "é ñ ü <|endoftext|> it's 123   \n\n  a"), (None, "no id here"), (None, None),
    ]
    full = [(i, t, None, ["b", "a", None][k % 3], None, "clash", "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(docs, small, spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(bpe.default_path())
    given = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet"), allowMissingColumns=True)
    seen = 0
    for r in bpe.encode(given, with_ids=True).collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        seen += 1
    assert seen == given.count()


def test_bpe_on_odd_pieces():
    tokenizers = pytest.importorskip("tokenizers")
    whole, own = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.default_path())
    for text in ["aaaaaaaaa", "abababab" * 40, "……——", "  x\x85\x1cy", "日本語テキスト", "👍🏽 ok", "'s's'S", " " * 77, "\r\n\r\n", "x" * 5000]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert own.encode(text)[0] == ",".join(map(str, ids))


def test_bpe_of_any_white_space_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    whole, own = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.default_path())
    letters = [" ", " ", " ", "\n", "\n", "\t", "\r", "\xa0", "\u3000", "\x1c", "\0", "'", "s", "t", "ing", "B", "é", "漢", "1", "½", ".", "!", "<|endoftext|>", "😀"]
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(10)))
        ids = whole.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == (",".join(map(str, ids)), len(ids), whole.decode(ids, skip_special_tokens=False)), repr(text)


def test_bpe_cuts_known_words_no_more(monkeypatch):
    """Words met before are taken from memory whole; the pattern sees the first word only, and memory stays bounded."""

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.seen = pattern, 0

        def findall(self, text):
            self.seen += len(text)
            return self.pattern.findall(text)

    own = bpe.Encoder(bpe.default_path())
    own.pattern = Counted(own.pattern)
    text = "First words, then 12 others.\nAnd it's all: one line more."
    once = own.encode(text)
    own.pattern.seen = 0
    assert own.encode(text) == once and own.pattern.seen == len("First")
    monkeypatch.setattr(bpe, "CACHE", 5)
    assert own.encode(text) == once and own.encode(" ".join(map(str, range(50))))[1] >= 50
    assert max(len(own.known), len(own.blank)) <= 5 and own.encode(text) == once


def _components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_all_pairs(docs, small, spark):
    for table in (docs.where("doc_id is not null"), spark.read.parquet(f"{small}/documents.parquet")):
        want = _components([(r.doc_id, r.text) for r in table.collect()])
        got = minhash.near_components(table).collect()
        assert len(got) == table.count()
        assert {r.id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_keep_one_and_null_ids(docs, none):
    kept = [r.doc_id for r in minhash.keep_one(docs).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 4, 5, 6, 7, 9, 11, 12] and kept.count(None) == 2
    assert minhash.near_components(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_near_duplicates_of_different_texts_under_one_id(spark):
    a, b = words(3, 120), words(9, 120)
    rows = [(1, a), (1, b), (2, a.replace("w21x", "zzz", 1)), (3, b + " end"), (4, words(17, 90)), (1, a), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", "y") for i, t in rows], SCHEMA)
    got = sorted((r.id, r.component_id) for r in minhash.near_components(docs).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5)]
    kept = sorted((r.doc_id, r.text) for r in minhash.keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, b), (4, words(17, 90)), (5, ""), (5, "")])


def test_near_duplicates_of_a_template(spark):
    """Texts that share a template but are not near: few pairs are made, and the planted links are found."""
    import random

    rng = random.Random(6)
    base = words(3, 100).split()
    rows = []
    for i in range(240):
        t = list(base)
        for at in rng.sample(range(100), 7):
            t[at] = f"own{i}x{at}"
        rows.append((i, " ".join(t)))
    rows += [(300 + i, rows[i][1] + " tail") for i in range(0, 240, 6)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", "y") for i, t in rows], SCHEMA)
    assert {r.id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs).collect()} == _components(rows)
    sets = [(str(i), minhash.shingles(t, 4)) for i, t in rows]
    told = [(i, [int(x) for x in s.view("int64")], i, [int(x) for x in minhash._packed(minhash.signature(s))]) for i, s in sets]
    open_ = spark.createDataFrame(told, "set_key string, shingles array<bigint>, root string, signature array<bigint>")
    pairs = {(r.a, r.b) for r in minhash._sharing_rare(open_, 80).collect()}
    assert len(pairs) <= 300 and {tuple(sorted((str(i), str(300 + i)))) for i in range(0, 240, 6)} <= pairs


def test_mix_comes_near_its_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(none).count() == 0
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for r in rows:
        assert abs(taken[r.source] - r.target) <= largest[r.source]
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_shards_are_gapless_and_grow_into_the_new_one(docs, none):
    rows = sharding.shuffle_into_shards(docs, shards=3, bucket_bytes=1000).collect()
    assert len(rows) == docs.count() and sharding.shuffle_into_shards(none).count() == 0
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    more = {r.doc_id: r.shard for r in sharding.shuffle_into_shards(docs, shards=4).collect()}
    assert more == {r.doc_id: r.grown_shard for r in rows}


def test_rows_of_one_id_spread_over_the_buckets(spark):
    texts = [(7, f"text {i}") for i in range(400)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = [r["count"] for r in table.groupBy(sharding.part_of([F.col("doc_id"), F.col("text")], 8, 20)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100
    rows = sharding.shuffle_into_shards(table, shards=2, bucket_bytes=500)
    got = rows.collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(400))


def test_shards_do_not_depend_on_how_rows_arrive(spark, docs):
    table = spark.createDataFrame([(i % 900, f"text {i * 7919 % 1000}") for i in range(1000)], "doc_id long, text string")
    whole = table.union(docs.select("doc_id", "text"))

    def slots(parts, **how):
        dealt = sharding.shuffle_into_shards(whole.repartition(parts), shards=4, bucket_bytes=2000, **how)
        return sorted(((r.doc_id, r.text, r.shard, r.slot) for r in dealt.collect()), key=str)

    assert slots(2) == slots(13) and slots(2) != slots(2, seed=21)
    plan = sharding.shuffle_into_shards(whole, shards=4, bucket_bytes=2000)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    # Within a shard the rows are neither in the order of their ids nor of their texts.
    first = [r[0] for r in sorted((r for r in slots(2) if r[2] == 0), key=lambda r: r[3])][:60]
    assert first != sorted(first, key=str)


def test_written_shards_follow_their_slots(spark, docs, tmp_path):
    shuffled = sharding.shuffle_into_shards(docs.select("doc_id", "text"), shards=3, bucket_bytes=1000)
    sharding.write_shards(shuffled, f"file://{tmp_path}/shards")
    read = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(map(str, read.select("doc_id", "text", "shard", "slot").collect())) == sorted(
        map(str, shuffled.select("doc_id", "text", "shard", "slot").collect())
    )
    for file in {r[0] for r in read.select(F.input_file_name()).distinct().collect()}:
        order = [r.slot for r in spark.read.parquet(file).collect()]
        assert order == sorted(order)


def test_later_copy_of_a_passage_goes(docs, none):
    rows = linededup.dedup_lines(docs).collect()
    assert len(rows) == docs.count() and linededup.dedup_lines(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[9].n_deleted == 0 and by[10].text == "gamma\nother end" and by[2].text == "" and by[1].n_deleted == 0
    assert by[4].text is None and by[4].n_lines == 0 and by[5].text == ""


def test_repeats_inside_a_text(spark):
    text = "\n".join(["again and again"] * 40)
    row = linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_deleted == 39 and row.text == "again and again"


def test_quality_counts_equal_plain_python(docs, none, small, spark):
    assert quality.measure(none).count() == 0
    given = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet"), allowMissingColumns=True)
    for r in quality.measure(given).collect():
        text = r.row.text or ""
        w = [x.decode() for x in text.encode().split()]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = collections.Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert r.kept is False if r.base_failed else r.kept is not None


def test_quality_parts_prose_from_junk(small, spark):
    joined = quality.measure(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select(F.col("row.doc_id").alias("doc_id"), "base_failed", "kept")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in joined.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_top_k_equals_all_scores(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (300, 6)) / 4
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (401, [1.0, None]), (420, [float("nan")] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table).orderBy("query_id", "rank").collect()]
    ints = np.floor(64 * v).astype(int)
    want = []
    for q in range(0, 300, 20):
        order = sorted((-int(ints[q] @ ints[i]), i) for i in range(300) if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert got == want
    assert topk.top_k(table.limit(0)).count() == 0


def test_top_k_of_repeated_rows_over_many_blocks(spark, monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(topk, "BLOCK", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(8)
    spots = [[rng.uniform(-2, 2) for _ in range(5)] for _ in range(9)]
    rows = [(rng.choice([None, *range(0, 90, 5)]), rng.choice(spots)[: rng.choice([4, 5])]) for _ in range(160)]
    rows += [(40, [9.0] * 5), (40, [9.0] * 5), (60, [0.0]), (61, [])]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, q string, number int, copies int")
    ints = [[int(np.floor(64 * x)) for x in v] for _, v in rows]
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=False))
    want = []
    for a, (id_, _) in enumerate(rows):
        if id_ is None or id_ % 20:
            continue
        order = sorted((-score(a, b), float("inf") if rows[b][0] is None else rows[b][0], b) for b in range(len(rows)) if b != a)[:7]
        want += [(id_, k + 1, rows[b][0], -s) for k, (s, _, b) in enumerate(order)]
    got = [tuple(r) for r in topk.top_k(table, k=7).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_only_sufficient_entries_are_added_up():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    v = rng.integers(-64, 65, (400, 16))
    block = pd.DataFrame({"number": range(400), "v": list(v), "copies": 1})
    met = topk.Meeting(block[:20].reset_index(drop=True), block)
    scores = v[:20] @ v.T
    np.fill_diagonal(scores, -(1 << 40))
    cutoffs = np.sort(scores, axis=1)[:, -5]
    row, col = met.sufficient(list(cutoffs))
    assert len(row) < 0.2 * scores.size
    assert {(r, c) for r, c in zip(*np.nonzero(scores >= cutoffs[:, None]), strict=True)} <= set(zip(row, col, strict=True))
    huge = block.assign(v=[x * (1 << 50) for x in v])
    big = topk.Meeting(huge[:20].reset_index(drop=True), huge)
    assert big.scores(np.array([3]), np.array([7]))[0] == max(-topk.LONG, min(topk.LONG, int(v[3] @ v[7]) << 100))


def test_warc_round_trip(spark, none, tmp_path):
    from basketry.llm import warc

    pages = spark.createDataFrame(
        [(1, "u", "a", "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "a", "x"), (4, "z", "a", "x"), (4, "z", "a", "x"), (5, "y", "é" * 9000, "x")],
        "page_id long, url string, html string, shard string",
    )
    path = f"file://{tmp_path}/warc"
    manifest = warc.write(pages, path, file_bytes=1)
    assert manifest.count() == 7 and not [p for p in (tmp_path / "warc").iterdir() if p.name.startswith("_")]
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in warc.read(manifest, path).collect()), key=str)
    want = [
        (0, 1, "response", None, True), (1, 1, "response", None, True), (2, 0, "response", None, True), (3, 0, "revisit", 2, True),
        (4, 1, "revisit", 1, True), (4, 1, "revisit", 1, True), (5, 18000, "response", None, True),
    ]
    assert got == want
    again = f"file://{tmp_path}/again"
    warc.write(pages, again, file_bytes=1)
    read = lambda d: {p.name: p.read_bytes() for p in (tmp_path / d).iterdir()}
    assert read("warc") == read("again")
    assert warc.write(pages.limit(0), f"file://{tmp_path}/none").count() == 0
    # Small shards: the same records, range-sorted over the files, equal rows with ids of their own.
    many = f"file://{tmp_path}/many"
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "_temporary-of-a-dead-attempt").write_bytes(b"x")
    cut = warc.write(pages, many, shard_bytes=700)
    assert cut.count() > 3
    back = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in warc.read(cut, many).collect()), key=str)
    assert back == want and not [p for p in (tmp_path / "many").iterdir() if p.name.startswith("_")]
    raw = [m.split(b"\r\n\r\n")[0].decode().split("\r\n") for p in sorted((tmp_path / "many").iterdir()) for m in warc.members(open(p, "rb"))]
    heads = [dict(x.split(": ", 1) for x in h[1:]) for h in raw]
    assert [int(h.get("X-Page-ID", 0)) for h in heads] == sorted(r[0] for r in want)
    own = {h["WARC-Record-ID"]: h for h in heads}
    assert len(own) == 7
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert own[h["WARC-Refers-To"]]["X-Page-ID"] == h["X-Refers-To-Page-ID"]


def test_null_ids_are_not_held_out(spark, docs, tmp_path):
    from basketry.llm.queries import QUERIES

    docs.select("doc_id", "text", F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op2_ppm_language"](spark, str(tmp_path)).collect()
    assert all(r.held_out in (True, False) for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False, False]


def test_language_held_out_and_odd_texts(spark, docs, none):
    from basketry.llm import langid
    from basketry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op2_ppm_language"](spark, sf).collect() if r.held_out]
    assert len(rows) > 100 and sum(lang[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = langid.identify(docs.withColumn("lang", F.when(F.col("doc_id") == 1, "xx")), F.lit(True)).collect()
    assert {r.doc_id: r.lang_pred for r in odd}[4] == "und" and {r.doc_id: r.lang_pred for r in odd}[6] == "und" and len(odd) == docs.count()
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(none, F.lit(True)).count() == 0


def test_scores_equal_a_plain_context_tree(spark, docs, none):
    import math
    from basketry.llm import ctw

    given = docs.where("doc_id in (1, 3, 4, 5, 7, 12)")
    rows = [(r.doc_id, (r.text or "").lower()) for r in given.collect()]
    train = [t for i, t in rows if i != 3]
    counts = collections.Counter(w for t in train for w in t.split() + [None])
    total, kinds = sum(counts.values()), len(counts)
    node = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)

    def steps(t):
        raw = bytes([255] * 3) + t.encode() + bytes([255])
        for i in range(3, len(raw)):
            for j in range(8):
                yield [(raw[i - d : i], (256 | raw[i]) >> (8 - j)) for d in range(4)], raw[i] >> (7 - j) & 1

    for t in train:
        for path, bit in steps(t):
            for d, k in enumerate(path):
                node[k][bit] += 1
                if d < 3:
                    kids[k].add(path[d + 1])

    def kt(k):
        a, b = node[k]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weigh(k):
        if k not in memo:
            if len(k[0]) == 3:
                memo[k] = kt(k)
            else:
                pe, below = kt(k), sum(weigh(c) for c in kids[k])
                top = max(pe, below)
                memo[k] = top + math.log(math.exp(pe - top) + math.exp(below - top)) - math.log(2)
        return memo[k]

    def chance(path, bit):
        k = path[0]
        own = (node[k][bit] + 0.5) / (sum(node[k]) + 1) if k in node else 0.5
        if len(path) == 1 or path[1] not in node:
            return own
        share = math.exp(kt(k) - math.log(2) - weigh(k))
        return share * own + (1 - share) * chance(path[1:], bit)

    got = ctw.score(given, F.col("doc_id") == 3).collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        tokens = want[r.doc_id].split() + [None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens))
        assert r.score == pytest.approx(sum(math.log10(chance(p, b)) for p, b in steps(want[r.doc_id])), rel=1e-6)
    assert ctw.score(none, F.lit(False)).count() == 0


def test_scores_do_not_depend_on_chunks_and_store_little(spark):
    import random
    from pathlib import Path
    from basketry.llm import ctw
    from basketry.session import shared_dir

    def stored():
        return {f: f.stat().st_size for f in Path(shared_dir(spark)).rglob("*.parquet") if f.parent.name.split("-")[0] in ("part", "byte")}

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(600)] + [None, "", " ", "\u00e9\u00df x"]
    rows = [(None if i % 50 == 1 else i // 2, t) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string")
    held_out = F.col("doc_id") % 5 == 2
    before = stored()
    one = ctw.score(given.coalesce(1), held_out, depth=6).collect()
    # Windows go packed to their groups: at most a few bytes for each byte of text.
    assert sum(k for f, k in stored().items() if f not in before) < 2 * sum(len(t or "") for t in texts)
    many = ctw.score(given.repartition(7), held_out, depth=6).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.score)
    assert len(one) == len(many) == len(rows)
    for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_deep_contexts_come_near_the_base_on_held_out_texts(spark):
    from basketry.llm.queries import QUERIES

    rows = [r for r in QUERIES["op3_ctw_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    # Contexts of 3 bytes are 11% below the base here, those of 6 bytes 0.8%.
    assert len(rows) > 100 and sum(r.score for r in rows) > 1.02 * sum(r.base_score for r in rows)


def test_language_sample_of_a_huge_table(spark):
    from basketry.llm import langid

    drawn = spark.range(200_000).where(langid.in_sample(F.col("id"), F.lit(10**11))).count()
    assert drawn <= 40  # 4 million of 1e11 characters are 8 of these rows
    assert spark.range(1000).where(langid.in_sample(F.col("id"), F.lit(1000))).count() == 1000
