"""Language model scores by context-tree weighting over bytes.

A byte is eight binary choices, each with a context tree over the bytes before
it. A node holds a Krichevsky-Trofimov estimate of its counts and is weighted
half and half against its children, from the deepest level up. A score mixes
the estimates along the path with the resulting weights, from the root down; a
context never seen in training leaves the rest of the weight with its parent.
Contexts of up to TOP bytes are grouped and joined tables. The subtrees below
them are dealt into groups of bounded mean size and weighted in numpy, so no
level has to fit into one task. Texts are counted and scored in chunks. A chunk
sends its distinct windows and tokens to each group as one packed row and gets
them back with their logarithms and counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import drop_past_shuffles, materialize, slots, spread

TOP = 3  # bytes of context whose nodes are tables
DEPTH = 6  # bytes of context of the registered query; a window of 7 bytes is one long
END = 0xFF  # never a byte of UTF-8; stands before and after a text
CHUNK_BYTES = 32 << 20
_BLOCK_BYTES = 2 << 20  # packed and counted at once
_GROUP_BYTES = 8 << 20  # of text for each group of subtrees and tokens
_UNSENT_BITS = 16  # last binary digits of a logarithm that are not sent: less than 1e-11 of it
_SPREAD = 0x9E3779B1  # deals contexts into groups


def windows(raw: bytes, depth: int) -> np.ndarray:
    """Each byte of a text and its end, with the ``depth`` bytes before it, as one number."""
    b = np.frombuffer(bytes([END] * depth) + raw + bytes([END]), np.uint8).astype(np.int64)
    out = np.zeros(len(b) - depth, np.int64)
    for k in range(depth + 1):
        out = (out << 8) | b[k : len(b) - depth + k]
    return out


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def _cut(batches):
    """Texts in packed blocks of about _BLOCK_BYTES, with the chunk of each: about CHUNK_BYTES of one task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    base, before, small = TaskContext.get().partitionId() << 32, 0, pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = before + np.cumsum(sizes) - sizes
        before += int(sizes.sum())
        block = starts // _BLOCK_BYTES
        cuts = [*np.flatnonzero(np.diff(block, prepend=-1)), len(block)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=small) as out:
                out.write_batch(batch.slice(at, end - at))
            chunk = base + int(block[at]) * _BLOCK_BYTES // CHUNK_BYTES
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "bytes": [int(sizes[at:end].sum())], "docs": [sink.getvalue().to_pybytes()]})


def _texts(docs: bytes) -> Iterator[tuple[str | None, bytes, bool]]:
    """Id, bytes and held_out of each text of a block."""
    import pyarrow as pa

    table = pa.ipc.open_stream(docs).read_all()
    for doc, text, held_out in zip(*(table.column(c).to_pylist() for c in ("doc", "text", "held_out")), strict=True):
        yield doc, _raw(text), held_out


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of ``n`` for each."""
    order = np.argsort(keys, kind="stable")  # keys are mostly runs in order
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], (np.add.reduceat(n, starts) if len(keys) else n).astype(np.int64)


def _pack(raw: bytes) -> bytes:
    import pyarrow as pa

    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _pack_numbers(values: np.ndarray) -> bytes:
    """Numbers of eight bytes; bytes of equal place lie side by side."""
    return _pack(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(packed: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(_unpack(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(kind).reshape(-1)


def _tokens(packed: bytes, kinds: int) -> list[bytes]:
    """Tokens joined by blanks; the empty one is the end."""
    return _unpack(packed).split(b" ") if kinds else []


def _context(window: np.ndarray) -> np.ndarray:
    return (window >> 8) & ((1 << (8 * TOP)) - 1)


def _dealt(context, groups: int):
    """The group of a context of TOP bytes, for numpy and for columns alike."""
    shifted = F.shiftright(context * F.lit(_SPREAD), 16) if isinstance(context, Column) else (context * _SPREAD) >> 16
    return shifted % groups


_COUNTS = "chunk long, group long, windows binary, n binary, tokens binary, c binary"


def _counts(depth: int, groups: int):
    """Per chunk and group the distinct windows and tokens with their counts in training; the empty token is the end."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, tokens, known, block = None, Counter(), [], []

        def fold():
            nonlocal block
            if block:
                # The lowest bit of a row to sort tells whether the window counts in training.
                rows = np.concatenate([(w << 1) | learn for w, learn in block])
                rows.sort()
                first = np.flatnonzero(np.concatenate([[True], rows[1:] >> 1 != rows[:-1] >> 1]))
                block = []
                known.append((rows[first] >> 1, np.add.reduceat(rows & 1, first)))
                del rows, first
                # Tables of like size are merged, so that few lie beside the largest.
                while len(known) > 1 and len(known[-2][0]) < 2 * len(known[-1][0]):
                    known[-2:] = [_sums(*(np.concatenate(x) for x in zip(*known[-2:], strict=True)))]

        def flush():
            fold()
            if chunk is None:
                return
            window, n = _sums(*(np.concatenate(x) for x in zip(*known, strict=True)))
            known.clear()
            group = _dealt(_context(window), groups)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            names = [[] for _ in range(groups)]
            for t in sorted(tokens):
                names[zlib.crc32(t) % groups].append(t)
            mine = [order[cuts[g] : cuts[g + 1]] for g in range(groups)]
            some = [g for g in range(groups) if len(mine[g]) or names[g]]
            yield pd.DataFrame({
                "chunk": chunk, "group": some,
                "windows": [_pack_numbers(window[mine[g]]) for g in some], "n": [_pack_numbers(n[mine[g]]) for g in some],
                "tokens": [_pack(b" ".join(names[g])) for g in some],
                "c": [_pack_numbers(np.array([tokens[t] for t in names[g]], np.int64)) for g in some],
            })

        for batch in batches:
            for of, docs in zip(batch["chunk"], batch["docs"], strict=True):
                if of != chunk:
                    yield from flush()
                    chunk, tokens, known = of, Counter(), []
                for _, raw, held_out in _texts(docs):
                    words = [*raw.split(), b""]
                    tokens.update(dict.fromkeys(words, 0) if held_out else words)
                    block.append((windows(raw, depth), int(not held_out)))
                fold()
        yield from flush()

    return count


def _merged(part: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The windows of each row, and the distinct ones of all with their counts."""
    each = [_numbers(w) for w in part["windows"]]
    return each, *_sums(np.concatenate(each), np.concatenate([_numbers(x) for x in part["n"]]))


def _token_counts(part: pd.DataFrame) -> Counter:
    total: Counter = Counter()
    for names, c in zip(part["tokens"], part["c"], strict=True):
        c = _numbers(c).tolist()
        for t, k in zip(_tokens(names, len(c)), c, strict=True):
            total[t] += k
    return total


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5 by Stirling's series at x + 8."""
    y, shift = x + 8, np.ones_like(x)
    for i in range(4):
        shift *= x + i
    rest = np.ones_like(x)
    for i in range(4, 8):
        rest *= x + i
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift) - np.log(rest)


def _estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of the counts."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _by_depth(window: np.ndarray, n: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per depth from TOP on the contexts with the byte that follows, sorted, and their counts."""
    out = {depth: _sums(window, n)}
    for d in range(depth - 1, TOP - 1, -1):
        out[d] = _sums(out[d + 1][0] & ((1 << (8 * (d + 1))) - 1), out[d + 1][1])
    return out


def _weigh(levels: dict, depth: int, j: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per depth the nodes of bit ``j``: key, n0, n1, log of the weighted probability, share of the own estimate."""
    out: dict[int, tuple[np.ndarray, ...]] = {}
    for d in range(depth, TOP - 1, -1):
        keys, n = levels[d]
        node = keys >> (8 - j)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        bit = (keys >> (7 - j)) & 1
        n1 = np.add.reduceat(n * bit, starts).astype(float)
        n0 = np.add.reduceat(n, starts) - n1
        node, pe = node[starts], _estimate(n0, n1)
        if d == depth:
            pw, share = pe, np.ones_like(pe)
        else:
            up = out[d + 1][0] & ((1 << (8 * d + j)) - 1)
            below = np.bincount(np.searchsorted(node, up), out[d + 1][3], len(node))
            pw = np.logaddexp(pe, below) - math.log(2)
            share = np.exp(pe - math.log(2) - pw)
        out[d] = (node, n0, n1, pw, share)
    return out


_NODES = "context long, node long, n0 long, n1 long, pw double, share double"


def _up(depth: int):
    """The nodes of TOP bytes of a group; that of context -1 has the kinds and number of its tokens seen in training."""

    def up(part: pd.DataFrame) -> pd.DataFrame:
        c = _token_counts(part).values()
        found = [pd.DataFrame({"context": [-1], "node": 0, "n0": sum(k > 0 for k in c), "n1": sum(c), "pw": 0.0, "share": 0.0})]
        _, window, n = _merged(part)
        levels = _by_depth(window, n, depth)
        for j in range(8 if len(window) else 0):
            node, n0, n1, pw, share = _weigh(levels, depth, j)[TOP]
            at = (1 << j) | (node & ((1 << j) - 1))
            found.append(pd.DataFrame({"context": node >> j, "node": at, "n0": n0.astype(np.int64), "n1": n1.astype(np.int64), "pw": pw, "share": share}))
        return pd.concat(found)

    return up


_REPLIES = "chunk long, windows binary, log10p binary, tokens binary, c binary"


def _down(depth: int):
    """Each row of a group with the log10 probabilities of its windows and the counts of its tokens."""

    def down(part: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        each, window, n = _merged(part)
        tokens = _token_counts(part)
        levels = _by_depth(window, n, depth)
        keys = (path["context"].to_numpy() << 8) | path["node"].to_numpy()
        order = np.argsort(keys)
        keys, above = keys[order], [path[c].to_numpy()[order] for c in ("last", "mixed", "rest")]
        context, total = _context(window), np.zeros(len(window))
        for j in range(8 if len(window) else 0):
            tree = _weigh(levels, depth, j) if depth > TOP else {}
            at = np.searchsorted(keys, (context << 8) | (1 << j) | ((window & 255) >> (8 - j)))
            last, mixed, rest = (x[at] for x in above)
            for d in range(TOP + 1, depth + 1):
                node, n0, n1, _, share = tree[d]
                at = np.searchsorted(node, (window & ((1 << (8 * (d + 1))) - 1)) >> (8 - j))
                n, own, part_of = (n0 + n1)[at], ((n1 + 0.5) / (n0 + n1 + 1))[at], share[at]
                seen = n > 0
                last = np.where(seen, own, last)
                mixed = np.where(seen, mixed + rest * part_of * own, mixed)
                rest = np.where(seen, rest * (1 - part_of), rest)
            one = mixed + rest * last
            total += np.log10(np.where((window >> (7 - j)) & 1 == 1, one, 1 - one))
        rounded = (total.view(np.int64) + (1 << (_UNSENT_BITS - 1))) >> _UNSENT_BITS << _UNSENT_BITS
        logs = [_pack_numbers(rounded[np.searchsorted(window, w)]) for w in each]
        c = []
        for names, own in zip(part["tokens"], part["c"], strict=True):
            c.append(_pack_numbers(np.array([tokens[t] for t in _tokens(names, len(_numbers(own)))], np.int64)))
        return pd.DataFrame({"chunk": part["chunk"], "windows": part["windows"], "log10p": logs, "tokens": part["tokens"], "c": c})

    return down


def byte_model(counts: DataFrame, depth: int, groups: int) -> tuple[DataFrame, int, int]:
    """The replies to the rows of ``counts``, and the number and kinds of tokens seen in training."""
    given = spread(counts, "group")
    level = materialize(given.groupBy("group").applyInPandas(_up(depth), _NODES), "context-nodes")
    total, kinds = level.where("context < 0").agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0))).first()
    level = level.where("context >= 0")
    nodes = [level]
    for d in range(TOP - 1, -1, -1):
        up = F.expr(f"context & {(1 << (8 * d)) - 1}")
        level = level.groupBy(up.alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        pe = _lgamma_column(F.col("n0") + 0.5) + _lgamma_column(F.col("n1") + 0.5) - _lgamma_column(F.col("n0") + F.col("n1") + 1.0) - math.log(math.pi)
        both = F.greatest("pe", "below") + F.log1p(F.exp(-F.abs(F.col("pe") - F.col("below")))) - math.log(2)
        level = level.withColumn("pe", pe).withColumn("pw", both)
        level = materialize(level.select("context", "node", "n0", "n1", "pw", F.exp(F.col("pe") - math.log(2) - F.col("pw")).alias("share")), "context-nodes")
        nodes.append(level)
    # Down the path: what is mixed so far, and the weight that is left for deeper contexts.
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    path = nodes[-1].select("context", "node", estimate.alias("last"), (F.col("share") * estimate).alias("mixed"), (1 - F.col("share")).alias("rest"))
    for d, level in enumerate(reversed(nodes[:-1]), 1):
        above = path.select(F.col("context").alias("up"), F.col("node").alias("of"), "last", "mixed", "rest")
        known = F.col("n0") + F.col("n1") > 0
        joined = level.join(above, (F.expr(f"context & {(1 << (8 * (d - 1))) - 1}") == F.col("up")) & (F.col("node") == F.col("of")))
        path = joined.select(
            "context", "node", F.when(known, estimate).otherwise(F.col("last")).alias("last"),
            F.when(known, F.col("mixed") + F.col("rest") * F.col("share") * estimate).otherwise(F.col("mixed")).alias("mixed"),
            F.when(known, F.col("rest") * (1 - F.col("share"))).otherwise(F.col("rest")).alias("rest"),
        )
    paths = spread(path.withColumn("group", _dealt(F.col("context"), groups)), "group")
    drop_past_shuffles(counts.sparkSession)
    replies = given.groupBy("group").cogroup(paths.groupBy("group")).applyInPandas(_down(depth), _REPLIES)
    return replies, total, kinds


def _lgamma_column(x: Column) -> Column:
    """``_lgamma`` of a column."""
    y = x + 8
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - shift


def _scored(depth: int, total: int, kinds: int):
    def scored(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        each = [_numbers(c) for c in table["c"]]
        index = {t: k for k, t in enumerate(t for names, c in zip(table["tokens"], each, strict=True) for t in _tokens(names, len(c)))}
        c = np.concatenate(each)
        base, known = np.log10((c + 1) / float(total + kinds + 1)), c > 0
        keys = np.concatenate([_numbers(w) for w in table["windows"]])
        logs = np.concatenate([_numbers(x, np.float64) for x in table["log10p"]])
        order = np.argsort(keys, kind="stable")
        keys, logs = keys[order], logs[order]
        out, sums = [], []
        for docs in texts["docs"]:
            block = []
            for doc, raw, held_out in _texts(docs):
                words = [*raw.split(), b""]
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                out.append((doc, held_out, len(at), int(known[at].sum()), total, float(base[at].sum())))
                block.append(windows(raw, depth))
            row = np.concatenate(block)
            order = np.argsort(row)
            row = row[order]
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            each = np.empty(len(row))
            each[order] = np.repeat(logs[np.searchsorted(keys, row[at])], np.diff(np.append(at, len(row))))
            sums.append(np.add.reduceat(each, np.cumsum([0, *map(len, block[:-1])])))
        found = pd.DataFrame(out, columns=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])
        return found.assign(score=np.concatenate(sums))

    return scored


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", depth: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Learns from all rows that are not held out. Null text counts as empty: its one
    token is the end. ``score`` is the log10 probability of the bytes of the text in
    lower case and of its end, by contexts of up to ``depth`` bytes (3 to 6).
    """
    if not TOP <= depth <= DEPTH:
        raise ValueError(f"depth must be {TOP} to {DEPTH}")
    # Ids pass pandas as text, which keeps null and large ones exact.
    rows = docs.select(
        F.col(f"`{key}`").cast("long").cast("string").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    texts = materialize(rows.mapInArrow(_cut, "chunk long, bytes long, docs binary"), "texts")
    size, chunks = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_distinct("chunk")).first()
    groups = max(2 * slots(docs.sparkSession), -(-size // _GROUP_BYTES))
    texts = texts.drop("bytes")
    counts = materialize(texts.mapInPandas(_counts(depth, groups), _COUNTS), "part-counts")
    replies, total, kinds = byte_model(counts, depth, groups)
    parts = max(slots(docs.sparkSession), 4 * chunks)  # so that few chunks meet in one
    return (
        texts.repartition(parts, "chunk").groupBy("chunk").cogroup(replies.repartition(parts, "chunk").groupBy("chunk"))
        .applyInPandas(_scored(depth, total, kinds), "doc string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        .select(F.col("doc").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )
