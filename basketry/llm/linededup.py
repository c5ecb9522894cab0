"""Delete repeated runs of lines by winnowing over line hashes.

A gram is the shortest run of lines, from a given line on, that has
``noise_words`` words. Of all grams that start within ``guarantee_words -
noise_words`` words of a line, the one with the smallest hash becomes a
fingerprint. So two copies of a run of at least ``guarantee_words`` words share
a fingerprint, and no match is shorter than ``noise_words``. Each fingerprint is
joined with its first position in the collection, the match is extended line by
line both ways, and the run is deleted at the later place.

Lines are compared without white space at their ends; blank lines neither match
nor break a run. Positions are ordered by document id, then by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import SPACE, SPACE_CHARS, count_words, others
from basketry.session import materialize


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_runs(
    docs: DataFrame,
    noise_words: int = 30,
    guarantee_words: int = 50,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Runs to delete: doc, body, then first, last, the lines' places from 0 in the text, and the place
    first_doc, first_line of the earlier copy.

    ``doc`` is the document's id and ``body`` the hash of its text; rows that
    repeat both count as one document, so they never delete each other's lines.
    A row with null id comes before all others. The places of one document may
    overlap when it has several earlier copies.
    """
    trimmed = F.filter(
        F.transform(_lines(F.col(f"`{text}`")), lambda x, i: F.struct(F.btrim(x, F.lit(SPACE_CHARS)).alias("line"), i.alias("at"))),
        lambda x: x["line"] != "",
    )
    # Per document the hashes, word counts and places of its lines: no text beyond this point.
    sketch = materialize(
        docs.select(
            F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("body"), trimmed.alias("lines")
        )
        .where(F.size("lines") > 0)
        .select(
            "doc",
            "body",
            F.transform("lines", lambda x: F.xxhash64(x["line"])).alias("hashes"),
            F.transform("lines", lambda x: count_words(x["line"]).cast("int")).alias("words"),
            F.transform("lines", lambda x: x["at"]).alias("places"),
        ),
        "line-hashes",
    )
    of_doc = Window.partitionBy("doc", "body").orderBy("pos")
    placed = (
        sketch.select("doc", "body", F.posexplode(F.arrays_zip("hashes", "words")).alias("pos", "x"))
        .select("doc", "body", "pos", F.col("x.hashes").alias("hash"), F.col("x.words").alias("words"))
        .dropDuplicates(["doc", "body", "pos"])
        .withColumn("start", F.sum("words").over(of_doc) - F.col("words"))
    )
    by_words = Window.partitionBy("doc", "body").orderBy("start")
    gram = by_words.rangeBetween(0, noise_words - 1)
    near = by_words.rangeBetween(0, guarantee_words - noise_words)
    grams = placed.withColumn(
        "gram", F.when(F.sum("words").over(gram) >= noise_words, F.xxhash64(F.collect_list("hash").over(gram)))
    ).withColumn("least", F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "pos"))).over(near))
    prints = materialize(
        grams.where(F.col("least").isNotNull())
        .select("doc", "body", F.col("least.gram").alias("gram"), F.col("least.pos").alias("pos"))
        .distinct(),
        "fingerprints",
    )
    earliest = (
        prints.groupBy("gram")
        .agg(F.min(F.struct("doc", "body", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("gram", F.col("first.doc").alias("doc0"), F.col("first.body").alias("body0"), F.col("first.pos").alias("pos0"))
    )
    later = prints.join(earliest, "gram").where(
        ~(F.col("doc").eqNullSafe(F.col("doc0")) & (F.col("body") == F.col("body0")) & (F.col("pos") == F.col("pos0")))
    )
    # One row for each pair of documents and shift; its anchors are extended together.
    pairs = later.groupBy("doc", "body", "doc0", "body0", (F.col("pos") - F.col("pos0")).alias("shift")).agg(
        F.sort_array(F.collect_set("pos")).alias("anchors")
    )
    one = sketch.dropDuplicates(["doc", "body"])
    left = one.select(F.col("doc").alias("ld"), F.col("body").alias("lb"), "hashes", "places")
    right = one.select(F.col("doc").alias("rd"), F.col("body").alias("rb"), F.col("hashes").alias("hashes0"), F.col("places").alias("places0"))
    both = pairs.join(left, F.col("doc").eqNullSafe(F.col("ld")) & (F.col("body") == F.col("lb"))).join(
        right, F.col("doc0").eqNullSafe(F.col("rd")) & (F.col("body0") == F.col("rb"))
    )
    n = F.size("hashes")
    differ = F.concat(
        F.array(F.lit(-1)),
        F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda p: (p < F.col("shift"))
            | (p - F.col("shift") >= F.size("hashes0"))
            | (F.get("hashes", p) != F.get("hashes0", F.greatest(p - F.col("shift"), F.lit(0)))),
        ),
        F.array(n),
    )
    runs = F.array_distinct(
        F.transform(
            "anchors",
            lambda a: F.struct(
                (F.array_max(F.filter("differ", lambda m: m < a)) + 1).alias("lo"),
                (F.array_min(F.filter("differ", lambda m: m > a)) - 1).alias("hi"),
            ),
        )
    )
    return (
        both.withColumn("differ", differ)
        .withColumn("run", F.explode(runs))
        .select(
            "doc",
            "body",
            F.get("places", F.col("run.lo")).alias("first"),
            F.get("places", F.col("run.hi")).alias("last"),
            F.col("doc0").alias("first_doc"),
            F.get("places0", F.col("run.lo") - F.col("shift")).alias("first_line"),
        )
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of ``docs``, the text without its later repeated runs, plus ``n_lines, n_deleted`` (long)
    and ``spans`` (array of first, last line deleted, counted from 0, in order and not overlapping).

    A null text stays null with no lines; an empty text has one, empty, line.
    A document all of whose lines repeat keeps an empty text. Input columns with
    the name of a result column are replaced.
    """
    results = ("n_lines", "n_deleted", "spans")
    spans = (
        repeated_runs(docs, key=key, text=text, **options)
        .groupBy("doc", "body")
        .agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))
    )
    # Merge what overlaps or touches, in order.
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= r["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], r["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(r["first"].alias("first"), r["last"].alias("last"))))),
    )
    spans = spans.select("doc", "body", merged.alias("spans"))
    rows = docs.select(
        F.struct(*others(docs, *results)).alias("row"), F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash")
    )
    lines = _lines(F.col(f"row.`{text}`"))
    kept = F.when(F.col("spans").isNull(), F.col(f"row.`{text}`")).otherwise(
        F.array_join(
            F.filter(lines, lambda x, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i <= s["last"]))), "\n"
        )
    )
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("body")), "left")
    deleted = F.aggregate("spans", F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    return joined.select(
        *[kept.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in results],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
    )
