"""Exact byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece there is one last token of its encoding. An
automaton over the vocabulary lists the tokens that end at each byte, longest
first. A token is the last one of a prefix if it is compatible with the last
token of the prefix before it: the merges of the pair's bytes must give back
just these two. Back-pointers from the end give the ids.

What was met before is kept, by words that begin with a single space or line
end, where the pattern always cuts, and by the pieces that make up a word.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import others

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
CACHE = 300_000  # words and pieces in each of a worker's two generations of memory; it bounds memory only

_loaded: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Uneven(Exception):
    """A word beside more white space than the one character it begins with."""


class Memory(dict):
    """Comma-joined ids and decoded bytes by text. A missing text is learned; of the generation before, what is seen again moves on."""

    def __init__(self, learn: Callable[[str], tuple[str, bytes]]):
        self.learn = learn
        self.older: dict[str, tuple[str, bytes]] = {}

    def __missing__(self, text: str) -> tuple[str, bytes]:
        found = self.older.get(text)
        if found is None:
            found = self.learn(text)
        if len(text) < 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Vocabulary, merges and automaton of one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b"".join(back[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: its two parts and the merge's rank
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in self.special:
                # One character for each byte, as Latin-1 has it.
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.uneven = regex.compile(r"[ \n]\s|.*\s\Z", regex.DOTALL)
        self.known = Memory(self._learn)
        self.blank = Memory(self._one)  # pieces of white space, which are no words

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together encode to just these two.

        Walks up the right edge of a's merge tree and the left edge of b's in the
        order of their merges, looking for a merge across that comes first.
        """
        fits = self.fits.get((a, b))
        if fits is None:
            edge = lambda t, side: self._edge(t, side)
            left, right = edge(a, 1), edge(b, 0)
            i, j = len(left) - 1, len(right) - 1
            fits = True
            while True:
                x, x_until = left[i]
                y, y_until = right[j]
                m = self.rank.get((x, y))
                if m is not None and m < x_until and m <= y_until:
                    fits = False
                    break
                if i == 0 and j == 0:
                    break
                if x_until <= y_until:
                    i -= 1
                else:
                    j -= 1
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            self.fits[a, b] = fits
        return fits

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The nodes from ``token`` down one edge of its merge tree, each with the rank at which it merges upward."""
        nodes, until = [(token, NEVER)], NEVER
        while token in self.parts:
            *halves, until = self.parts[token]
            token = halves[side]
            nodes.append((token, until))
        return nodes

    def piece(self, text: str) -> list[int]:
        """Token ids of one piece."""
        shown = text.encode("utf-8", "surrogatepass").decode("latin-1")
        last: list[int | None] = [None] * (len(shown) + 1)
        width = [0] * (len(shown) + 1)
        fits, compatible = self.fits.get, self.compatible
        for end, (token, n) in self.automaton.iter(shown):
            end += 1
            if last[end] is None:
                start = end - n
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    fit = fits((before, token))
                    if not (compatible(before, token) if fit is None else fit):
                        continue
                last[end], width[end] = token, n
        ids, at = [], len(shown)
        while at:
            ids.append(last[at])
            at -= width[at]
        return ids[::-1]

    def _one(self, piece: str) -> tuple[str, bytes]:
        own = self.piece(piece)
        return ",".join(map(str, own)), b"".join([self.bytes_of[i] for i in own])

    def _learn(self, text: str) -> tuple[str, bytes]:
        """A word, or a piece that is not blank."""
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self._one(text)
        if self.uneven.match(text):
            raise Uneven
        cut = self.pattern.findall(text)
        if len(cut) == 1:
            return self._one(text)
        found = self._pieces(cut)
        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def _pieces(self, cut: list[str]) -> list[tuple[str, bytes]]:
        known, blank = self.known, self.blank
        return [blank[p] if p.isspace() else known[p] for p in cut]

    def _parts(self, text: str) -> list[tuple[str, bytes]]:
        """What the words of a text without special tokens encode to.

        The pattern cuts before a space or line end that stands between two
        characters that are not white. A text where it meets other white space,
        or that has the character used as a mark, is cut by the pattern alone.
        """
        if "\0" not in text:
            first, *words = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            try:
                if first[-1:].isspace():
                    raise Uneven
                return self._pieces(self.pattern.findall(first)) + [*map(self.known.__getitem__, words)]
            except Uneven:
                pass
        return self._pieces(self.pattern.findall(text))

    def encode(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and the decoded text."""
        found: list[tuple[str, bytes]] = []
        for part in self.splitter.split(text) if self.splitter else [text]:
            if part in self.special:
                found.append((str(self.special[part]), part.encode()))
            elif part:
                found += self._parts(part)
        ids = ",".join([f[0] for f in found])
        return ids, ids.count(",") + 1 if ids else 0, b"".join([f[1] for f in found]).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``n_tokens, ids_sha256, decoded_sha256``, and ``ids`` (array) on demand.

    Null text counts as empty, which has no tokens. ``path`` names a tokenizer
    file that every worker has. Input columns with the name of a result column
    are replaced. Texts go through whole, one by one; nothing is shuffled.
    """
    path = path or default_path()
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.pandas_udf(kind)
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for texts in parts:
            rows = []
            for t in texts:
                ids, n, back = own.encode(t or "")
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (ids, back)]
                rows.append((n, *sha, *[[int(i) for i in ids.split(",") if i]] * with_ids))
            yield pd.DataFrame(rows, columns=results)

    return docs.select(*others(docs, *results), coded(F.col(f"`{text}`")).alias("_coded")).select(
        *others(docs, *results), *[F.col(f"_coded.{c}").alias(c) for c in results]
    )
