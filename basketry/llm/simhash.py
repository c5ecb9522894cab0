"""Near duplicates by SimHash, found with the pigeonring filter.

A fingerprint is cut into ``distance + 1`` segments on a ring. If two
fingerprints differ in at most ``distance`` bits, there is a segment from which
every chain of consecutive segments keeps to its share of the budget: a chain of
l segments differs in at most ``floor(l * distance / segments)`` = l - 1 bits. So the
first segment is equal and the second differs in one bit at most: these two are
the key of a join, in which one side stands under its own key and the other under
all keys one bit away. Longer chains are tested in the join's condition, before
the distance itself.

Only different fingerprints take part; copies share one. Dense clouds of near
copies would have pairs without number, so they are contracted first: members of a
group that is equal in a long chain (all segments but one, then all but two) are
compared with the group's least and with one drawn member. The join then skips
pairs within a component, and in each bucket the pairs within its most frequent
component are not even formed. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.minhash import components
from basketry.session import materialize

BITS = 64
SEED = 42
ROUND = 1 << 14  # hashes whose bits are counted at once


def fingerprint(text: str | None, width: int) -> int:
    """SimHash over the word shingles of a text, as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    width = min(width, n)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], stops[: n - width])).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, (stops[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), ROUND):
        part = hashes[at : at + ROUND].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments of a fingerprint."""
    n = distance + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def chain_mask(parts: list[tuple[int, int]], first: int, length: int) -> int:
    """The bits of ``length`` consecutive segments on the ring, from ``first`` on, as a signed number."""
    mask = 0
    for k in range(length):
        low, width = parts[(first + k) % len(parts)]
        mask |= ((1 << width) - 1) << low
    return _signed(mask)


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _stars(classes: DataFrame, parts: list[tuple[int, int]], length: int, distance: int) -> DataFrame:
    """Links (a, b) of each fingerprint with the least and with a drawn one of those equal to it in a chain of ``length`` segments."""
    keys = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(chain_mask(parts, i, length))).alias("chain")) for i in range(len(parts))]
    spread = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.i", "k.chain")
    hub = spread.groupBy("i", "chain").agg(
        F.min("fp").alias("least"), F.max_by("fp", F.xxhash64("fp", "i")).alias("drawn"), F.count("*").alias("m")
    ).where("m > 1")
    met = spread.join(hub, ["i", "chain"]).select("fp", F.explode(F.array("least", "drawn")).alias("b"))
    return met.where((F.col("fp") != F.col("b")) & (differing("fp", "b") <= distance)).select(F.col("fp").alias("a"), "b").distinct()


def _across(labelled: DataFrame, parts: list[tuple[int, int]], distance: int) -> DataFrame:
    """Links (a, b) between fingerprints (fp, root) of different roots: the pigeonring join."""
    n = len(parts)
    starts = [
        F.struct(
            F.lit(i).alias("i"),
            F.col("fp").bitwiseAND(F.lit(chain_mask(parts, i, 1))).alias("head"),
            F.col("fp").bitwiseAND(F.lit(chain_mask(parts, i, 2))).alias("chain"),
        )
        for i in range(n)
    ]
    rows = labelled.select("fp", "root", F.explode(F.array(*starts)).alias("s")).select("fp", "root", "s.*")
    # The most frequent root of each bucket (equal first segments); its members need not be probed.
    top = rows.groupBy("i", "head", "root").agg(F.count("*").alias("m")).groupBy("i", "head").agg(
        F.max_by("root", F.struct("m", "root")).alias("top"), F.count("*").alias("roots")
    ).where("roots > 1")
    probes = rows.join(top, ["i", "head"]).where("root != top")
    flips = F.array(
        *[
            F.array(F.lit(0), *[F.lit(_signed(1 << low + b)) for b in range(width)]).cast("array<bigint>")
            for low, width in (parts[(i + 1) % n] for i in range(n))
        ]
    )
    probes = probes.select("i", F.col("fp").alias("a"), F.col("root").alias("root_a"), "chain", F.explode(F.element_at(flips, F.col("i") + 1)).alias("flip"))
    probes = probes.select("i", "a", "root_a", F.col("chain").bitwiseXOR(F.col("flip")).alias("chain"))
    index = rows.select("i", F.col("fp").alias("b"), F.col("root").alias("root_b"), "chain")
    within = differing("a", "b") <= distance
    for length in range(n - 1, 2, -1):
        masks = F.array(*[F.lit(chain_mask(parts, i, length)) for i in range(n)])
        mask = F.element_at(masks, F.col("x.i") + 1)
        within = (F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask)) <= length - 1) & within
    met = probes.alias("x").join(
        index.alias("y"),
        (F.col("x.i") == F.col("y.i")) & (F.col("x.chain") == F.col("y.chain")) & (F.col("root_a") != F.col("root_b")) & within,
    )
    return met.select("a", "b").distinct()


def _labelled(classes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(fp, root) of all classes, materialized."""
    roots = components(links)
    joined = classes.join(roots, classes.fp == roots.node, "left")
    return materialize(joined.select("fp", F.coalesce("root", "fp").alias("root")), name, classes.count())


def near_components(docs: DataFrame, width: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``; ``fingerprint`` is a long.

    Rows link if their fingerprints differ in at most ``distance`` (1 to 15) bits. Null,
    empty and blank texts have fingerprint 0, which links like any other. Links join
    rows, not ids: rows with one id and different texts may be in different
    components. A row with null id takes part; the component is the least id that is
    not null, or null if there is none. Repeated rows stay.
    """
    if not 1 <= distance <= 15:
        raise ValueError("distance must be from 1 to 15")

    @F.pandas_udf("long")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    drawn = docs.select(F.col(f"`{key}`").alias("id"), sketch(F.col(f"`{text}`")).alias("fp"))
    table = materialize(drawn, "fingerprints")
    classes = materialize(table.groupBy("fp").agg(F.min("id").alias("id")), "fingerprint-classes", table.count())
    own = classes.select("fp")
    parts = segments(distance)
    links = _stars(own, parts, distance, distance)
    if distance > 2:
        links = links.union(_stars(own, parts, distance - 1, distance))
    most = 2 * len(parts) * own.count()  # of one _stars: each fingerprint with two others in each chain
    links = materialize(links, "cloud-links", 2 * most if distance > 2 else most)
    across = materialize(_across(_labelled(own, links, "clouds"), parts, distance), "links-across")
    labels = _labelled(own, links.union(across), "fingerprint-roots")
    least = classes.join(labels, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    named = labels.join(least, "root").select("fp", "component_id")
    return table.join(named, "fp").select("id", F.col("fp").alias("fingerprint"), "component_id")
