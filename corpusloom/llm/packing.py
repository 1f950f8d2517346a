"""Cost-balanced packing of documents into sequences.

A sequence's attention cost is estimated as linear in its tokens plus quadratic in each of its
pieces. Pieces, longest first, go to the cheapest sequence that has room. The room of a block
of documents is exactly its tokens: full sequences, and for the rest sequences of powers of two,
which need no padding. A document longer than a sequence first fills whole ones; a piece that
fits nowhere is cut at the largest room left.

Blocks are runs of an input partition with a bounded number of tokens, so nothing
shuffles, memory is bounded and a lost task is made anew from its own input.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import at_rest, small_batches

#: Words a worker remembers before it starts anew, their letters, and the letters of a word that is not remembered.
REMEMBERED, LETTERS, LONG = 600_000, 24 << 20, 1 << 12
#: Tokens of a block, but for its last document.
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _letters(word: str) -> bool:
    """Whether a word is letters alone, and stays so when composed and lower-cased."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _marked(word: str) -> bool:
    return word[-1] in ".,;:!?" and _letters(word[:-1])


class WordTokens:
    """Ids of a tokenizer that drops white space and looks at each run of other characters by itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.odd = re.compile(r"[\x1c-\x1f]")  # white space to Python, not to the tokenizer

    def _ids(self, texts: list[str]) -> list[bytes]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [_little(e.ids) for e in run(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of words not met before.

        Words of letters alone are encoded many to a text and told apart by the tokens that end a word; a mark
        after such a word is a word of its own. All others go one by one.
        """
        known = self.known
        stems, rest = {w for w in new if _letters(w)}, []
        marked = [w for w in new if _marked(w)]
        stems.update(w[:-1] for w in marked)
        plain = list(stems.difference(known))
        groups = [plain[s : s + 256] for s in range(0, len(plain), 256)]
        for words, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ends = (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4
            if len(ends) == len(words):  # else some letter turned into something else
                known.update(zip(words, [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))
            else:
                rest += words
        rest += set(new).difference(stems, marked)
        rest += {w[-1] for w in marked}.difference(known)
        for s in range(0, len(rest), 10_000):
            known.update(zip(rest[s : s + 10_000], self._ids(rest[s : s + 10_000]), strict=True))
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in marked)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = {i for i, t in enumerate(texts) if self.odd.search(t)}
        words = [[] if i in whole else t.split() for i, t in enumerate(texts)]
        known = self.known
        if len(known) > REMEMBERED or self.held > LETTERS:
            self.forget()
        new = set(chain.from_iterable(words)).difference(known)
        self._learn(list(new))
        out = [self._ids([t])[0] if i in whole else b"".join(map(known.__getitem__, x)) for i, (t, x) in enumerate(zip(texts, words, strict=True))]
        for w in [w for w in new if len(w) > LONG]:
            known.pop(w, None)
            known.pop(w[:-1], None)
            new.remove(w)
        self.held += sum(map(len, new))
        return out

    def forget(self) -> None:
        self.known.clear()
        self.held = 0


@lru_cache(2)
def tokens(path: str) -> WordTokens:
    return WordTokens(path)


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths."""
    out, pieces, n = [], [], 0
    for d, length in enumerate(lengths):
        for s in range(0, length - size + 1, size):
            out.append((d, s, size, n, 0))
            n += 1
        if length % size:
            pieces.append((length % size, d, length - length % size))
    total = sum(p[0] for p in pieces)
    rest = total % size
    room = np.array([size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if rest >> b & 1], np.int64)
    full, cost = room.copy(), np.zeros(len(room))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    for length, d, start in pieces:
        while length:
            fits = room >= length
            at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            put = min(length, int(room[at]))
            out.append((d, start, put, n + at, int(full[at] - room[at])))
            room[at] -= put
            cost[at] += linear * put + quadratic * put * put
            start, length = start + put, length - put
    return out


def pack(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, size: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096
) -> DataFrame:
    """One row per piece: doc_id, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit integers in a binary), doc_tokens, sequence_id and offset in the sequence.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Rows that repeat an id
    are documents of their own. Sequence ids are unique, not gapless. An empty table gives no piece.
    ``size`` is a power of two. Malformed UTF-8 is replaced. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, end = tokens(path), np.uint32(end_id).astype("<u4").tobytes()
        first = TaskContext.get().partitionId() << 32

        def block(ids: list, data: list[bytes]) -> pa.RecordBatch:
            nonlocal first
            rows = assign([len(x) // 4 for x in data], size, linear, quadratic)
            d, s, n, q, o = (list(x) for x in zip(*rows, strict=True))
            parts = [data[i][4 * a : 4 * (a + b)] for i, a, b in zip(d, s, n, strict=True)]
            out = [[ids[i] for i in d], s, n, parts, [len(data[i]) // 4 for i in d], [first + x for x in q], o]
            first += max(q) + 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(out)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        ids, data, held = [], [], 0
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                for i, x in zip(part.column(0).to_pylist(), vocabulary.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids.append(i)
                    data.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= BLOCK_TOKENS:
                        yield block(ids, data)
                        ids, data, held = [], [], 0
        if ids:
            yield block(ids, data)
        vocabulary.forget()  # a worker that waits for its next task holds no words
        at_rest()

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
