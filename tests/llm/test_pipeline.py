"""The quality verdict and the pipeline against plain Python."""

import collections
import hashlib
import math
import random
import re

import pytest

from basketry.llm import bpe, mixing, quality

SPACE = " \t\n\x0b\f\r"


def distance(counts, total, shares):
    twice = 0.0
    for c, q in zip(counts, shares, strict=True):
        p = c / total
        m = (p + q) / 2
        twice += (p * math.log2(p / m) if p else 0) + (q * math.log2(q / m) if q else 0)
    return math.sqrt(max(twice / 2, 0))


def plain_verdict(text, rules=None):
    """(class distance, word distance, language, base_failed, kept) of a text."""
    rules = rules or quality.Rules()
    body = text or ""
    words = re.findall(f"[^{SPACE}]+", body)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    repeated = {k for i, w in enumerate(windows) if w in often for k in range(i, i + 8)}
    failed = len(words) < rules.min_words or 100 * len(repeated) > rules.max_repeat_percent * len(words)
    classes = [len(re.findall(f"[{c}]", body)) for c in quality.CLASSES.values()]
    classes.append(len(body) - sum(classes))
    # A common word stands after white space and before white space or a stop.
    starts = {m.end() for m in re.finditer(f"^|[{SPACE}]", body)}
    found = collections.Counter()
    for word in {w for common in rules.common_words.values() for w in common}:
        for m in re.finditer(re.escape(word) + rf"(?=[{SPACE}.,;:!?]|\Z)", body, re.IGNORECASE | re.ASCII):
            found[word] += m.start() in starts
    best = None
    for language in sorted(rules.common_words):
        common = rules.common_words[language]
        counts = [found[w] for w in common]
        shares = [quality.FIRST_WORD_SHARE / (r + 1) for r in range(len(common))]
        by_words = by_class = None
        if len(words) >= rules.min_common:
            by_words = distance([*counts, max(len(words) - sum(counts), 0)], len(words), [*shares, 1 - sum(shares)])
        if len(body) >= rules.min_chars:
            by_class = distance(classes, len(body), rules.class_shares[language])
        excess = max((by_words or 0) / rules.max_word_distance, (by_class or 0) / rules.max_class_distance)
        if best is None or excess < best[0] - 1e-12:
            best = (excess, by_class, by_words, language)
    excess, by_class, by_words, language = best
    return by_class, by_words, failed, not failed and excess <= 1


def test_distances_and_verdicts_equal_plain_python(spark, small):
    rows = quality.measure(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert len({r.kept for r in rows}) == 2
    for r in rows:
        by_class, by_words, failed, kept = plain_verdict(r.row.text)
        assert (r.base_failed, r.kept) == (failed, kept), r.row.doc_id
        assert (r.class_distance is None) == (by_class is None) and (r.word_distance is None) == (by_words is None)
        if by_class is not None:
            assert r.class_distance == pytest.approx(by_class, abs=1e-9)
        if by_words is not None:
            assert r.word_distance == pytest.approx(by_words, abs=1e-9)


def prose(rng, n):
    """Lines of running English words, no line twice."""
    common = quality.COMMON_WORDS["en"]
    words = [rng.choice(common) if rng.random() < 0.2 else "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3, 8))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 10]).capitalize() + "." for i in range(0, n, 10))


def plain_lines(docs):
    """Runs of lines with 50 words or more that an earlier document has are gone."""
    out = []
    for i, (id_, text, source) in enumerate(docs):
        lines = text.split("\n")
        gone = set()
        for _, former, _ in docs[:i]:
            old = former.split("\n")
            for a in range(len(lines)):
                for b in range(len(old)):
                    n = 0
                    while a + n < len(lines) and b + n < len(old) and lines[a + n] == old[b + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[a : a + n]) >= 50:
                        gone |= set(range(a, a + n))
        out.append((id_, "\n".join(x for k, x in enumerate(lines) if k not in gone), source))
    return out


def plain_near(docs, width=5):
    """One document, the smallest id, of each component; texts without words stay."""
    sets = {}
    for id_, text, _ in docs:
        w = text.lower().split()
        sets[id_] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return [d for d in docs if find(d[0]) == d[0]]


def test_pipeline_equals_plain_python(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(120, 400)) for _ in range(40)]
    passage = prose(rng, 80)
    for k in (3, 11, 12, 27):
        texts[k] += "\n" + passage
    for k in (5, 6, 7):  # near copies of which no line is the same
        texts.append(texts[k].replace("\n", " ") + " zzz")
    texts += [texts[20], "", "too short", "%$# " * 200, "same again\n" * 90]
    docs = [(i, t, "abc"[i % 3]) for i, t in enumerate(texts)]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    good = [d for d in docs if plain_verdict(d[1])[3]]
    assert 40 <= len(good) < len(docs) - 3
    left = plain_near(plain_lines(good))
    assert len(left) < len(good)

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = tokenizers.Tokenizer.from_file(bpe.default_path())
    ids = {i: whole.encode(t, add_special_tokens=False).ids for i, t, _ in left}
    taken = collections.Counter(r.doc_id for r in rows)
    assert set(taken) <= set(ids) and max(taken.values()) <= 2
    for r in rows:
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    # Each source's words come near its target, which a plain loop shares out.
    size = {i: len(t.split()) for i, t, _ in left}
    of = {i: s for i, _, s in left}
    sums = collections.Counter()
    for i, s in of.items():
        sums[s] += size[i]
    target, free, rest = {}, dict(zip("abc", (3, 1, 2), strict=True)), 1.5 * sum(sums.values())
    while free:
        full = [s for s in free if rest * free[s] / sum(free.values()) >= 2 * sums[s]]
        if not full:
            target |= {s: rest * w / sum(free.values()) for s, w in free.items()}
            break
        for s in full:
            target[s] = 2 * sums[s]
        rest -= sum(target[s] for s in full)
        free = {s: w for s, w in free.items() if s not in full}
    got = collections.Counter()
    for i, n in taken.items():
        got[of[i]] += n * size[i]
    for s, t in target.items():
        assert abs(got[s] - t) <= max(size[i] for i in of if of[i] == s)


def test_targets_equal_a_plain_loop(spark):
    rng = random.Random(7)
    for _ in range(6):
        sizes = {f"s{k}": rng.randrange(1, 4000) for k in range(rng.randrange(1, 7))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows, (3, 1, 2), 1.5, 2).collect()}
        free = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
        want, rest = {}, 1.5 * sum(sizes.values())
        while free:
            full = [s for s, w in free.items() if rest * w / sum(free.values()) > 2 * sizes[s]]
            if not full:
                want |= {s: rest * w / sum(free.values()) for s, w in free.items()}
                break
            want |= {s: 2 * sizes[s] for s in full}
            rest -= sum(2 * sizes[s] for s in full)
            free = {s: w for s, w in free.items() if s not in full}
        assert got == pytest.approx(want)
