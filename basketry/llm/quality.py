"""Quality rules by divergence from language references.

A document is described by two histograms: its characters by class, and its
words by a list of common words. Each language has a reference for both. The
verdict compares them by Jensen-Shannon distance (base 2, between 0 and 1): the
document must lie near the references of one language. Below a minimum length a
histogram says too little, and its test is not applied.

Everything is an SQL expression over one row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACE, words_of

# The most frequent words of each language, most frequent first.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht eine ein als".split(),
    "fr": "de la le et les des en un du une que pour est dans qui par au sur pas avec".split(),
    "es": "de la que el en y los se las del un por con no una su para al es lo".split(),
}
# Share of the words of running text that the most frequent word has; the word of rank r has this share over r.
FIRST_WORD_SHARE = 0.06

# Characters by class, as Java regex classes; the rest is "other".
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": SPACE, "stop": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>@=+/\\_~^{}\[\]"}
# Shares of the classes in running prose of each language, in the order of CLASSES, then other.
CLASS_SHARES = {
    "en": [0.795, 0.014, 0.001, 0.166, 0.024, 0.0, 0.0],
    "de": [0.773, 0.012, 0.001, 0.155, 0.022, 0.0, 0.037],
    "fr": [0.708, 0.011, 0.001, 0.166, 0.024, 0.0, 0.09],
    "es": [0.724, 0.012, 0.001, 0.162, 0.023, 0.0, 0.078],
}


@dataclass(frozen=True)
class Rules:
    """Bounds of the verdict."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_class_distance: float = 0.20
    min_chars: int = 200  # below, the class histogram is not judged
    max_word_distance: float = 0.50
    min_common: int = 60  # words; below, the word histogram is not judged
    common_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: COMMON_WORDS)
    class_shares: Mapping[str, Sequence[float]] = field(default_factory=lambda: CLASS_SHARES)


def js_distance(counts: Column, total: Column, reference: Sequence[float]) -> Column:
    """Jensen-Shannon distance of ``counts`` over ``total`` from a reference distribution."""

    def term(count: Column, q: Column) -> Column:
        p = count / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(counts, F.array(*[F.lit(float(x)) for x in reference]), term)
    twice = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def _length_of(text: Column, of: str) -> Column:
    """Code points of ``text`` in the class ``of``."""
    return F.length(F.regexp_replace(text, f"[^{of}]+", ""))


def _alternatives(words: Sequence[str]) -> str:
    """A regex of ``words``, grouped by first letter so that few branches are tried at each place."""
    by_letter: dict[str, list[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """Adds windows: a hash of each run of ``width`` words, none for shorter texts.

    Runs grow by doubling: two neighbouring runs, or overlapping ones at the
    last step, make the next; so a word is hashed a few times, not ``width`` times.
    """
    rows, covered = rows.withColumn("windows", F.transform("words", lambda w: F.xxhash64(w))), 1
    while covered < width:
        step = min(covered, width - covered)
        later = F.slice("windows", step + 1, F.greatest(F.size("windows") - step, F.lit(0)))
        joined = F.zip_with(F.slice("windows", 1, F.greatest(F.size("windows") - step, F.lit(0))), later, lambda a, b: F.xxhash64(a, b))
        rows, covered = rows.withColumn("windows", joined), covered + step
    return rows


def _repeated(rows: DataFrame, width: int) -> DataFrame:
    """Adds n_repeat_words: positions covered by windows that occur twice or more.

    Windows are sorted with their positions; equal neighbours mark each other.
    A text without equal windows, the usual case, is not sorted. Each step is a
    column of its own, so that no array is computed twice.
    """
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    tail = F.slice("placed", 2, F.greatest(F.size("placed") - 1, F.lit(1)))
    # Each pair of equal neighbours marks both of its places.
    both = F.filter(
        F.zip_with("placed", tail, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()
    )
    gaps = F.zip_with(
        "at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width))
    )
    return (
        rows.withColumn("placed", F.when(twice, placed))
        .withColumn("at", F.sort_array(F.array_distinct(F.flatten(both))))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    )


def measure(docs: DataFrame, text: str = "text", width: int = 8, rules: Rules | None = None) -> DataFrame:
    """``docs`` as a struct ``row`` beside the base counts, distances and the verdict.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    class_distance, word_distance (null where not judged), language (of the
    nearest references, null where neither is judged), base_failed, kept.
    Null and empty texts have no words and fail the base rules.
    """
    rules = rules or Rules()
    languages = sorted(rules.common_words)
    every = sorted({w for words in rules.common_words.values() for w in words}, key=lambda w: (-len(w), w))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"), words_of(body).alias("words"))
    lines = F.filter(F.split("body", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    common = F.regexp_extract_all("body", F.lit(rf"(?:^|[{SPACE}])((?i:{_alternatives(every)}))(?=[{SPACE}.,;:!?]|$)"), F.lit(1))
    # Each pass works on what the one before has left: words without space, then without lower-case letters, the bulk.
    rows = _windows(rows, width).withColumn("solid", F.array_join("words", ""))
    rows = rows.withColumn("rare", F.regexp_replace("solid", f"[{CLASSES['lower']}]+", ""))
    rare = {of: _length_of(F.col("rare"), chars) for of, chars in CLASSES.items()}
    rare["lower"] = F.length("solid") - F.length("rare")
    rare["space"] = F.length("body") - F.length("solid")
    counted = (
        rows.select(
            "row",
            F.size("words").cast("long").alias("n_words"),
            "windows",
            lines.alias("lines"),
            F.length("body").alias("chars"),
            F.length("solid").cast("long").alias("word_chars"),
            _length_of(F.col("rare"), "#*$%&|<>").cast("long").alias("n_symbols"),
            F.array(*rare.values()).alias("classes"),
            # Every common word of the text between bars, as one short string.
            F.lower(F.concat(F.lit("|"), F.array_join(common, "||"), F.lit("|"))).alias("common"),
        )
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    )
    counted = _repeated(counted, width)

    def times(word: str) -> Column:
        marked = f"|{word}|"
        return (F.octet_length("common") - F.octet_length(F.replace(F.col("common"), F.lit(marked), F.lit("")))) / len(marked.encode())

    judged = counted.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars",
        F.concat(F.col("classes"), F.array(F.col("chars") - F.aggregate("classes", F.lit(0), lambda a, x: a + x))).alias("classes"),
        # Columns of their own: fields of a struct would be inlined, and counted anew, wherever they are read.
        *[F.array(*[times(w) for w in rules.common_words[c]]).alias(f"common_{c}") for c in languages],
    )
    distances = []
    for language in languages:
        found = F.col(f"common_{language}")
        n = F.col("n_words").cast("double")
        rest = F.greatest(n - F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        shares = [FIRST_WORD_SHARE / (r + 1) for r in range(len(rules.common_words[language]))]
        distances.append(
            F.struct(
                F.when(F.col("n_words") >= rules.min_common, js_distance(F.concat(found, F.array(rest)), n, [*shares, 1 - sum(shares)])).alias("by_words"),
                F.when(F.col("chars") >= rules.min_chars, js_distance(F.col("classes"), F.col("chars").cast("double"), rules.class_shares[language])).alias("by_class"),
                F.lit(language).alias("language"),
            )
        )
    nearest = F.array_min(
        F.transform(
            F.array(*distances),
            lambda d: F.struct(
                # How far a distance exceeds its bound; not judged counts as on the reference.
                F.greatest(
                    F.coalesce(d["by_words"], F.lit(0.0)) / rules.max_word_distance,
                    F.coalesce(d["by_class"], F.lit(0.0)) / rules.max_class_distance,
                ).alias("excess"),
                d.alias("d"),
            ),
        )
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    here = F.spark_partition_id() >= 0  # always true; keeps a caller's filter above the steps, see keep_good
    unjudged = F.col("near.d.by_words").isNull() & F.col("near.d.by_class").isNull()
    return judged.withColumn("near", nearest).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("near.d.by_class").alias("class_distance"),
        F.col("near.d.by_words").alias("word_distance"),
        F.when(~unjudged, F.col("near.d.language")).alias("language"),
        (failed & here).alias("base_failed"),
        (~failed & (F.col("near.excess") <= 1) & here).alias("kept"),
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass all rules, with their columns.

    A filter on a plain expression is pushed below all steps of ``measure``, and
    then repeats their arrays inside each other without end. The partition
    number, not deterministic to the optimizer, keeps it above them.
    """
    verdict = F.col("kept") & (F.spark_partition_id() >= 0)
    return measure(docs, **options).select("row", verdict.alias("kept")).where("kept").select("row.*")
