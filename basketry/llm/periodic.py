"""Periodic runs of words, found with suffix trees.

A run is a longest stretch of words with smallest period q and a length of at
least ``exponent * q``. Runs come from the Lyndon words at each position: the
longest Lyndon word that starts at i gives one candidate period, for an order of
the words and for its reverse, and every run has such a root. A candidate is
extended to the right by the longest common extension of i and i + q, to the
left by that of the reversed text. Both extensions are lowest common ancestors
in a suffix tree (Ukkonen, left to right), read in constant time from a table
of range minima over the Euler tour; the tour keeps the shallowest node between
neighbouring leaves, which is their ancestor.

Trees are built only where a run can be (``regions``): a condition that every
run meets, over the distances between equal groups of words. It drops no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import others

KIND = "starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string"
END = -1  # a letter that ends a sequence and comes before all others


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict[int, int] | None]]:
    """Ukkonen's suffix tree of ``s``, whose last letter occurs once: (start, stop) of the edge into each node, children by first letter."""
    n = len(s)
    start, stop, link, kids = [0], [0], [0], [{}]
    node = edge = length = due = 0
    for i, c in enumerate(s):
        due += 1
        last = 0  # an inner node made in this step, which waits for its suffix link
        while due:
            if not length:
                edge = i
            first = s[edge]
            child = kids[node].get(first)
            if child is None:
                kids[node][first] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                kids.append(None)
                if last:
                    link[last] = node
                    last = 0
            else:
                span = stop[child] - start[child]
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                at = start[child] + length
                if s[at] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(start)
                start += (start[child], i)
                stop += (at, n)
                link += (0, 0)
                kids += ({c: middle + 1, s[at]: child}, None)
                kids[node][first] = middle
                start[child] = at
                if last:
                    link[last] = middle
                last = middle
            due -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - due + 1
    return start, stop, kids


class Extensions:
    """Suffixes in order, and longest common extensions in constant time."""

    def __init__(self, s: list[int]):
        self.size = len(s) + 1
        self.tree = suffix_tree([*s, END])
        order, shallow = self._tour(lambda kids: sorted(kids, reverse=True))
        self.rank = np.empty(self.size, np.int64)
        self.rank[order] = np.arange(self.size)
        self.minima = [np.array(shallow, np.int32)]
        while 2 << len(self.minima) - 1 <= self.size:
            below, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(below[:-half], below[half:]))

    def _tour(self, backwards) -> tuple[list[int], list[int]]:
        """Leaves of the tour from left to right, and the depth of the ancestor each has in common with the leaf before it."""
        start, stop, kids = self.tree
        order, shallow = [], []
        stack = [(0, 0, 0)]
        while stack:
            node, above, low = stack.pop()
            below = kids[node]
            if below is None:
                order.append(start[node] - above)
                shallow.append(low)
                continue
            depth = above + stop[node] - start[node]
            letters = backwards(below)
            for c in letters[:-1]:
                stack.append((below[c], depth, depth))
            stack.append((below[letters[-1]], depth, low))
        return order, shallow

    def reverse_rank(self) -> np.ndarray:
        """Rank of the suffixes when the order of the letters is reversed; the end still comes first."""
        order, _ = self._tour(lambda kids: sorted(kids, key=lambda c: (c != END, -c), reverse=True))
        rank = np.empty(self.size, np.int64)
        rank[order] = np.arange(self.size)
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, which differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.minima[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position: up to the next smaller suffix."""
    r = rank.tolist()
    n = len(r) - 1
    out = np.empty(n, np.int64)
    waiting = [n]
    for i in range(n - 1, -1, -1):
        own = r[i]
        while r[waiting[-1]] > own:
            waiting.pop()
        out[i] = waiting[-1] - i
        waiting.append(i)
    return out


def runs_in(s: list[int], exponent: int, least: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``s`` with a length of at least ``max(least, exponent * period)``."""
    n = len(s)
    ahead = Extensions(s)
    spots, periods = [], []
    for rank in (ahead.rank, ahead.reverse_rank()):
        q = lyndon_lengths(rank)
        i = np.arange(n)
        # From its first full root on, a run goes on for all periods but two at least.
        fit = np.flatnonzero(ahead.common(i, i + q) >= (exponent - 2) * q)
        spots.append(fit)
        periods.append(q[fit])
    i, q = np.concatenate(spots), np.concatenate(periods)
    if not len(i):
        return set()
    right = ahead.common(i, i + q)
    left = Extensions(s[::-1]).common(n - i, n - i - q)
    length = left + q + right
    good = length >= np.maximum(least, exponent * q)
    return set(zip((i - left)[good].tolist(), length[good].tolist(), q[good].tolist(), strict=True))


def regions(words: list[bytes], exponent: int, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches (from, to) of ``words`` that hold every run whole.

    Let d be the distance of a group of g words to the former equal group. A run of
    period q has (exponent - 1) * q - g + 1 groups in a row, or more, with d <= q:
    all but those of its first q words. So in a stretch of T such groups one with
    d * (exponent - 1) > T + g - 1 is in no run. It is taken out, which divides the
    stretch, until nothing changes. Hashes may collide; that only keeps more.
    """
    n = len(words)
    g = max(1, min(5, max(least, exponent) - 1, 2 * (exponent - 1)))
    m = n - g + 1
    if n < max(least, exponent) or m < 2:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = h[:m].copy()
    for k in range(1, g):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += h[k : k + m]
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    same = np.flatnonzero(in_order[1:] == in_order[:-1])
    at = order[same + 1]
    by_place = np.argsort(at)
    at, cost = at[by_place], ((at - order[same]) * (exponent - 1) - g + 1)[by_place]
    fewest = min(max(least, exponent * q) - q - g + 1 for q in range(1, least + 2))
    while len(at):
        ends = np.flatnonzero(np.diff(at) != 1) + 1
        sizes = np.diff(np.concatenate(([0], ends, [len(at)])))
        t = np.repeat(sizes, sizes)
        keep = (cost <= t) & (t >= fewest)
        if keep.all():
            break
        at, cost = at[keep], cost[keep]
    if not len(at):
        return []
    firsts = at[np.concatenate(([0], ends))]
    out: list[tuple[int, int]] = []
    for a, t in zip(firsts.tolist(), sizes.tolist(), strict=True):
        low, high = max(0, a - (t + g - 1) // (exponent - 1)), a + t + g - 1
        while out and low <= out[-1][1]:
            low = min(low, out.pop()[0])
        out.append((low, high))
    return out


def runs_of(words: list[bytes], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, by start, then period."""
    found = set()
    for low, high in regions(words, exponent, least):
        number: dict[bytes, int] = {}
        s = [number.setdefault(w, len(number)) for w in words[low:high]]
        found |= {(low + i, length, q) for i, length, q in runs_in(s, exponent, least)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run has after its first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for i, length, q in runs:
            gone[i + q : i + length] = True
        words = [words[k] for k in np.flatnonzero(~gone)]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """All columns of ``docs`` plus ``runs`` (array of start, length, period) and ``collapsed`` (text).

    Words are numbered from 0. ``exponent`` is 2 or more; a run has at least
    ``max(least, exponent * period)`` words. In ``collapsed`` a word is missing if a
    run has it after its first period; the others are joined by one space. Null,
    empty and blank texts have no runs and collapse to the empty text. Repeated
    rows stay. Texts go through whole, one by one, and nothing is shuffled. An input
    column with the name of a result column is replaced by it.
    """
    if exponent < 2 or least < 1:
        raise ValueError("exponent must be at least 2 and least at least 1")

    @F.pandas_udf(KIND)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                words = (t or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of(words, exponent, least)
                columns = [[r[k] for r in runs] for k in range(3)]
                rows.append((*columns, collapse(words, runs).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["starts", "lengths", "periods", "collapsed"])

    own = others(docs, "runs", "collapsed")
    found = docs.select(*own, read(F.col(f"`{text}`")).alias("_found"))
    runs = F.arrays_zip(F.col("_found.starts").alias("start"), F.col("_found.lengths").alias("length"), F.col("_found.periods").alias("period"))
    runs = runs.cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    return found.select(*own, runs.alias("runs"), F.col("_found.collapsed").alias("collapsed"))
