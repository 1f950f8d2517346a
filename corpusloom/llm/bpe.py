"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in one token, whichever way the word goes on, and
a token may follow another only if the two, side by side, encode to themselves. So for each
prefix the one token is kept that ends there and may follow the last token of the prefix
before it; following these back from the end gives the exact ids. An automaton over the
vocabulary yields the tokens that end at each place, and whether two tokens may be
neighbours is decided from their merges and remembered.

Words are independent of each other, so each is encoded once per worker and remembered in
a table of bounded size.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Vocabulary, at_rest, fresh, small_batches

#: Words a worker remembers before it starts anew: those with a blank before them, and the others.
REMEMBERED, OTHERS = 400_000, 100_000
#: From so many letters on a word's table is kept in four bytes an entry.
LONG = 1 << 12
#: The pattern byte-level BPE splits texts by (a fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    plain = set(shown)
    return [chr(b) if b in plain else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's file format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.letters = byte_letters()
        self.table = {i: c for i, c in enumerate(self.letters)}  # for str.translate on latin-1
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        self._spines(ids, merges)
        self.fits: dict[int, bool] = {}
        self.whole = {t: i for t, i in ids.items() if i in self.left}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        byte = {c: b for b, c in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for t, i in ids.items():
            self.bytes[i] = bytes(map(byte.__getitem__, t))
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORDS)
        self.gaps = regex.compile(r"\s\s")
        self.first, self.spaced = Vocabulary(self._unit, OTHERS), Vocabulary(lambda w: self._unit(" " + w), REMEMBERED)

    def _spines(self, ids: dict, merges: list) -> None:
        """For each token that encodes to itself: its edge parts from the byte up, with the rank of the merge that swallows each."""
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        for letter in self.letters:
            if letter in ids:
                i = ids[letter]
                self.left[i] = self.right[i] = [(i, NEVER)]
        for r, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            if x in self.left and y in self.left and z not in self.left and self._neighbours_until(x, y) == r:
                self.left[z] = [*self.left[x][:-1], (x, r), (z, NEVER)]
                self.right[z] = [*self.right[y][:-1], (y, r), (z, NEVER)]

    def _neighbours_until(self, x: int, y: int) -> int:
        """The rank of the first merge across the border of x and y as BPE runs over both; NEVER if there is none.

        The parts at the border grow by the merges inside x and y, in order of rank; a merge
        across happens if it ranks before the next merge on either side (of equal ranks the
        leftmost is made first).
        """
        left, right, i, j, rank = self.right[x], self.left[y], 0, 0, self.rank
        while True:
            a, swallowed_a = left[i]
            b, swallowed_b = right[j]
            across = rank.get((a, b), NEVER)
            if across < swallowed_a and across <= swallowed_b and across != NEVER:
                return across if swallowed_a == swallowed_b == NEVER else -1
            if swallowed_a == swallowed_b == NEVER:
                return NEVER
            if swallowed_a <= swallowed_b:
                i += 1
            else:
                j += 1

    def encode_word(self, letters: str) -> list[int]:
        """Ids of a word given in byte letters."""
        if letters in self.whole:
            return [self.whole[letters]]
        n, fits = len(letters), self.fits
        last, begins = ([-1] * (n + 1), [0] * (n + 1)) if n < LONG else (array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1))
        for end, (length, token) in self.automaton.iter(letters):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > 500_000:
                        fits.clear()
                    ok = fits[key] = self._neighbours_until(before, token) == NEVER
                if not ok:
                    continue
            last[end + 1], begins[end + 1] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = begins[at]
        return out[::-1]

    def forget(self) -> None:
        self.first.clear()
        self.spaced.clear()

    def _unit(self, text: str) -> bytes:
        out: list[int] = []
        for word in self.words.findall(text):
            out += self.encode_word(word.encode().decode("latin-1").translate(self.table))
        return np.array(out, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.gaps.search(text):
            return b"".join(map(self.first.__getitem__, self.words.findall(text)))
        # no two white spaces meet: a line end is a word, a blank belongs to what follows it
        first, spaced, out, newline = self.first, self.spaced, [], self.first["\n"]
        for line in text.split("\n"):
            parts = line.split(" ")
            out.append(first[parts[0]])
            out.extend(map(spaced.__getitem__, parts[1:]))
            out.append(newline)
        out.pop()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; the strings of added tokens in it are these tokens."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.uint32(self.special[m[0]]).astype("<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    """Loaded once per worker."""
    return ByteBpe(path)


def _mapped(df: DataFrame, source: Column, target: str, kind: pa.DataType, sql_kind: str, make, path: str) -> DataFrame:
    """``df`` with a column ``target`` made row by row of ``source``, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 256  # bounds the size of what is sent on at once
            for s in range(0, b.num_rows, step):
                part = b.slice(s, step)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(make, part.column(part.num_columns - 1).to_pylist()), kind)], names=[*part.schema.names[:-1], target])
        vocabulary(path).forget()  # a worker that waits for its next task holds no words
        at_rest()

    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() != target.lower()]
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept], source.alias(*fresh(df, "in")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, `{target}` {sql_kind}" if schema else f"`{target}` {sql_kind}")


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the text's ids as little-endian unsigned 32-bit integers in a binary.

    A null text counts as empty and has no ids. Malformed UTF-8 is replaced. A column of that name is replaced, others may have any name.
    An empty table gives an empty one.
    """
    return _mapped(df, F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")), ids_col, pa.binary(), "binary", lambda t: vocabulary(path).encode(t or ""), path)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of the ids; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    return _mapped(df, F.col(f"`{ids_col}`"), text_col, pa.string(), "string", lambda i: vocabulary(path).decode(i or b""), path)
