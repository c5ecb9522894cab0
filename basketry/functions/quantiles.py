"""Exact quantiles by distributed selection.

The built-in exact percentile holds every distinct value of a group in one
task. Here values are counted in a fixed number of buckets; a bucket that
holds a wanted position is then cut again, until few rows are left. A pass
serves all columns in one job, and only bucket counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
SMALL = 2_000


class _Interval(NamedTuple):
    column: str
    low: float
    high: float
    before: int  # rows below it
    rows: int  # rows in it
    spots: list[int]  # wanted positions in it


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of each column over its non-null values.

    The order is minus infinity, finite numbers, infinity, NaN. Next to an infinity
    the quantile is that infinity, next to NaN it is NaN; without values it is NaN.
    ``df`` is read a few times, so an expensive plan is best written first.
    """
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stats = df.agg(*[f.alias(f"{n}_{c}") for c in columns for n, f in _stats(c).items()]).first()
    rows = {c: stats[f"n_{c}"] for c in columns}
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    todo = []
    for c in columns:
        if rows[c]:
            spots = sorted({f(p * (rows[c] - 1)) for p in probs for f in (math.floor, math.ceil)})
            first = stats[f"down_{c}"]
            last = first + stats[f"finite_{c}"]
            for spot in spots:
                if spot < first:
                    found[c][spot] = -math.inf
                elif spot >= last:
                    found[c][spot] = math.inf if spot < last + stats[f"up_{c}"] else math.nan
            spots = [s for s in spots if first <= s < last]
            if spots:
                todo.append(_Interval(c, stats[f"lo_{c}"], stats[f"hi_{c}"], first, last - first, spots))
    while todo:
        for one in todo:
            if one.low == one.high:
                found[one.column].update(dict.fromkeys(one.spots, one.low))
        todo = [one for one in todo if one.low < one.high]
        last, wide = [o for o in todo if o.rows <= SMALL], [o for o in todo if o.rows > SMALL]
        if last:
            _pick(df, last, found)
        todo = _split(df, wide) if wide else []
    return {c: [_between(found[c], p * (rows[c] - 1)) if rows[c] else math.nan for p in probs] for c in columns}


def _stats(column: str) -> dict[str, Column]:
    x = F.col(column)
    finite = F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)
    return {
        "n": F.count(x), "finite": F.count(finite), "lo": F.min(finite), "hi": F.max(finite),
        "down": F.count_if(x == -math.inf), "up": F.count_if(x == math.inf),
    }


def _between(values: dict[int, float], at: float) -> float:
    low, high = values[math.floor(at)], values[math.ceil(at)]
    if low == high or math.isinf(low):
        return low
    if not math.isfinite(high):
        return high
    return low + (high - low) * (at - math.floor(at))


def _members(df: DataFrame, intervals: list[_Interval]) -> DataFrame:
    """The values inside each interval, as ``k, x`` with the interval's number."""
    inside = [
        F.when(F.col(o.column).between(o.low, o.high), F.struct(F.lit(k).alias("k"), F.col(o.column).alias("x")))
        for k, o in enumerate(intervals)
    ]
    return df.select(F.inline(F.array_compact(F.array(*inside))))


def _split(df: DataFrame, intervals: list[_Interval]) -> list[_Interval]:
    """Cut each interval into buckets and keep those that hold a wanted position."""
    # A width beyond the largest number is halved with its values.
    halves = [1.0 if math.isfinite(o.high - o.low) else 0.5 for o in intervals]
    bounds = [
        F.struct(F.lit(h).alias("h"), F.lit(h * o.low).alias("lo"), F.lit(h * o.high - h * o.low).alias("w"))
        for h, o in zip(halves, intervals, strict=True)
    ]
    mine = F.element_at(F.array(*bounds), F.col("k") + 1)
    bucket = F.least(F.floor((F.col("x") * mine["h"] - mine["lo"]) / mine["w"] * F.lit(BUCKETS)), F.lit(BUCKETS - 1))
    hist = (
        _members(df, intervals)
        .groupBy("k", bucket.alias("b"))
        .agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .collect()  # at most BUCKETS rows per interval
    )
    pieces = []
    seen = [o.before for o in intervals]
    for row in sorted(hist, key=lambda r: (r["k"], r["b"])):
        one, start = intervals[row["k"]], seen[row["k"]]
        spots = [s for s in one.spots if start <= s < start + row["n"]]
        if spots:
            pieces.append(_Interval(one.column, row["lo"], row["hi"], start, row["n"], spots))
        seen[row["k"]] = start + row["n"]
    return pieces


def _pick(df: DataFrame, intervals: list[_Interval], found: dict[str, dict[int, float]]) -> None:
    """Read the values at the wanted positions from small intervals."""
    counts = _members(df, intervals).groupBy("k", "x").count().collect()  # at most SMALL rows per interval
    seen = [o.before for o in intervals]
    for row in sorted(counts, key=lambda r: (r["k"], r["x"])):
        one, start = intervals[row["k"]], seen[row["k"]]
        for spot in one.spots:
            if start <= spot < start + row["count"]:
                found[one.column][spot] = row["x"]
        seen[row["k"]] = start + row["count"]
