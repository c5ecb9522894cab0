"""Language of a text by prediction by partial matching (PPM).

Each language has byte context trees of orders 0 to 3 with frozen counts. A
byte costs -log2 of its share in the longest context seen; where the context
never had it, an escape (distinct / (total + distinct), method C) leads to the
next shorter one, and at last to a uniform byte. The language with the shortest
code for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import others

ORDER = 3
SAMPLE_CHARS = 4_000_000  # of training text per language: the documented bound of the fit


def windows(text: str) -> np.ndarray:
    """Each byte of the lower-case text with the three before it, as one number."""
    raw = np.frombuffer(b"   " + text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]


def in_sample(key: Column, chars: Column) -> Column:
    """Whether a row of a language of ``chars`` characters is drawn; in doubles, since the product passes the longs."""
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(1 << 30)).cast("double") * chars < F.lit(SAMPLE_CHARS) * F.lit(1 << 30).cast("double")


def training(docs: DataFrame, usable: Column, text: str, lang: str, key: str) -> DataFrame:
    """(lang, window, n) of a hash sample of the usable rows, bounded per language."""
    rows = docs.where(usable).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("id"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    drawn = rows.join(sizes, "lang").where(in_sample(F.col("id"), F.col("chars")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, part in batch.groupby("lang"):
                w, n = np.unique(np.concatenate([windows(t) for t in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": language, "window": w.astype(np.int64), "n": n})

    return drawn.select("lang", "text").mapInPandas(count, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))


def trees(window: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per order: the windows with counts, and the contexts with totals and distinct bytes."""
    out = []
    for k in range(ORDER + 1):
        keys, at = np.unique(window & np.uint32((1 << (8 * (k + 1))) - 1 if k < 3 else 0xFFFFFFFF), return_inverse=True)
        counts = np.bincount(at, n)
        contexts, of = np.unique(keys >> np.uint32(8) if k else np.zeros_like(keys), return_inverse=True)
        out.append((keys, counts, contexts, np.bincount(of, counts), np.bincount(of)))
    return out


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def costs(tree: list[tuple[np.ndarray, ...]], window: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each window."""
    bits, open_ = np.zeros(len(window)), np.ones(len(window), bool)
    for k in range(ORDER, -1, -1):
        keys, counts, contexts, totals, distinct = tree[k]
        w = window & np.uint32((1 << (8 * (k + 1))) - 1 if k < 3 else 0xFFFFFFFF)
        context = w >> np.uint32(8) if k else np.zeros_like(w)
        n, total, kinds = _look(keys, counts, w), _look(contexts, totals, context), _look(contexts, distinct, context)
        known = open_ & (total > 0)
        hit, miss = known & (n > 0), known & (n == 0)
        bits[hit] += np.log2((total[hit] + kinds[hit]) / n[hit])
        bits[miss] += np.log2((total[miss] + kinds[miss]) / kinds[miss])
        open_ &= ~hit
    bits[open_] += 8
    return bits


def identify(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score``.

    ``usable`` marks the rows to learn from; those without text or language are
    left out of the fit. ``score`` is the share of the winner when code lengths per byte
    are turned into weights 2^-(10 bits). Texts that are null or have no letter, and all
    texts when nothing can be learned, are ``und`` with score 0. Ties go to the
    language first by name. The model has the size of its bounded sample.
    """
    spark = docs.sparkSession
    fit = training(docs, usable & F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull(), text, lang, key).toPandas()
    model = {str(name): trees(part["window"].to_numpy().astype(np.uint32), part["n"].to_numpy()) for name, part in fit.groupby("lang")}
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        names = sorted(own)
        for texts in parts:
            rows: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
            clear = [i for i, t in enumerate(texts) if names and t is not None and any(map(str.isalpha, t))]
            for at in range(0, len(clear), 64):
                some = clear[at : at + 64]
                each = [windows(texts.iloc[i]) for i in some]
                kinds, place = np.unique(np.concatenate(each), return_inverse=True)
                table = np.stack([costs(own[x], kinds) for x in names])
                starts = np.cumsum([0, *map(len, each)])[:-1]
                for x, i in enumerate(some):
                    mean = table[:, place[starts[x] : starts[x] + len(each[x])]].mean(axis=1)
                    share = np.exp2(-10 * (mean - mean.min()))
                    rows[i] = (names[int(mean.argmin())], float(share.max() / share.sum()))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    results = ("lang_pred", "score")
    return docs.select(*others(docs, *results), predict(F.col(f"`{text}`")).alias("_found")).select(*others(docs, *results), "_found.*")
