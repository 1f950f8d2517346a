"""Texts packed into compressed chunks, and what passage operators share: identifiers of runs of units, anchors, answers by chunk.

A chunk is a run of rows of an input partition with some ``chunk_bytes`` of text. It is kept in a table bucketed by
its number, so that what the rest of the corpus says of it comes to it and texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import at_rest, bucketed, small_batches

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_POS = np.uint64((1 << 28) - 1)
NO_ID = np.iinfo(np.int64).min
#: What an operator says of each row.
RESULT = "doc_id long, text_hash long, n_units long, n_removed long, starts array<long>, ends array<long>, kept binary"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Combine two identifiers in order."""
    z = a * _P1 + (b ^ (b >> np.uint64(29))) * _P2
    z ^= z >> np.uint64(32)
    z *= _P3
    z ^= z >> np.uint64(29)
    return z


def refine(bucket: np.ndarray, depth: int, *targets: int) -> list[np.ndarray]:
    """Identifiers of the grams of each target length (ascending), from those of grams of ``depth``: each round combines a place's
    bucket with that of a later offset and is used again by the next."""
    out = []
    for target in targets:
        while 2 * depth <= target:
            bucket, depth = mix(bucket[:-depth], bucket[depth:]), 2 * depth
        rest = target - depth
        out.append(mix(bucket[:-rest], bucket[rest:]) if rest else bucket)
    return out


def refine_at(bucket: np.ndarray, depth: int, target: int, at: np.ndarray) -> np.ndarray:
    """What ``refine`` makes for ``target``, at the places ``at`` only."""
    shifts = []
    while 2 * depth <= target:
        shifts.append(depth)
        depth *= 2
    if target > depth:
        shifts.append(target - depth)

    def value(level: int, place: np.ndarray) -> np.ndarray:
        return mix(value(level - 1, place), value(level - 1, place + shifts[level - 1])) if level else bucket[place]

    return value(len(shifts), at)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width``."""
    key = (values & ~_POS) | np.arange(len(values), dtype=np.uint64)
    span = 1
    low = key
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & _POS).astype(np.int64)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys sorted together: where each run of equals starts, and how many there are."""
    new = np.ones(len(keys[0]), bool)
    for i, k in enumerate(keys):
        new[1:] = (new[1:] if i else False) | (k[1:] != k[:-1])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new)))


#: Bytes between words.
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes hashed at once, and of a word that is hashed by itself.
_BLOCK, _LONG = 1 << 15, 1 << 14
_BYTES = np.random.default_rng(11).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    inverse = np.uint64(pow(int(_P1), -1, 1 << 64))
    out = []
    for base in (_P1, inverse):
        x = np.ones(1, np.uint64)
        while len(x) < _BLOCK + _LONG + 1:
            x = np.concatenate([x, x * (x[-1:] * base)])
        out.append(x)
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where each begins and ends.

    A word's hash is a polynomial in its bytes, taken from running sums, so no word is made into an object of its own.
    """
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_GAP[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    begin, end = edge[::2], edge[1::2]
    out = np.empty(len(begin), np.uint64)
    power, inverse = _powers()
    long_ = end - begin > _LONG
    cut = np.searchsorted(begin, np.arange(0, len(raw) + _BLOCK, _BLOCK))
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if e > s:
            low, high = begin[s:e], np.where(long_[s:e], begin[s:e], end[s:e])
            base, top = int(low[0]), int(high.max())
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum(_BYTES[raw[base:top]] * power[: top - base], out=sums[1:])
            h = (sums[high - base] - sums[low - base]) * inverse[low - base] + (high - low).astype(np.uint64)
            out[s:e] = mix(h, h)
    for i in np.flatnonzero(long_).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    return out, begin, end


@dataclass
class Chunk:
    ids: np.ndarray
    null: np.ndarray
    texts: list[bytes]
    starts: np.ndarray = field(default=None)  # of each document's units in the chunk's
    sizes: np.ndarray = field(default=None)
    words: bool = False  # whether units are words, or else bytes


def pack_chunk(ids: list[int | None], texts: list[bytes]) -> bytes:
    head = np.array([len(ids)], "<i8").tobytes() + np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(texts))


def unpack_chunk(blob: bytes) -> Chunk:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ids, null, sizes = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "u1", n, 8 + 8 * n).astype(bool), np.frombuffer(data, "<i8", n, 8 + 9 * n)
    ends = 8 + 17 * n + np.cumsum(sizes)
    return Chunk(ids, null, [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])


def chunked(df: DataFrame, chunk_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """(chunk, bytes, docs): runs of an input partition with some ``chunk_bytes`` of text. No row is left out; malformed UTF-8 is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, n = [], [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_chunk(ids, texts)], pa.binary())], names=["chunk", "bytes", "docs"])

        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t or b"")
                    size += len(texts[-1]) + 16
                    if size >= chunk_bytes:
                        yield out()
                        ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield out()
        at_rest()

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return bucketed(rows.mapInArrow(run, "chunk long, bytes long, docs binary"), "chunk", "chunks")


def each_chunk(df: DataFrame, schema: str, make: Callable[..., pa.RecordBatch | None]) -> DataFrame:
    """``make`` on each row's values; it gives a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made = make(*[c[i].as_py() for c in b.columns])
                if made is not None and made.num_rows:
                    yield made
        at_rest()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole_characters(text: bytes, gone: np.ndarray) -> np.ndarray:
    """Covered bytes and the rest of the characters they belong to."""
    data = np.frombuffer(text, np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.add.reduceat(gone, first) > 0, np.diff(np.append(first, len(data))))


def results(chunk: Chunk, covered: np.ndarray, characters: bool = False) -> pa.RecordBatch:
    """Rows of RESULT, from whether each of the chunk's units is covered."""
    out: list[list] = [[] for _ in range(7)]
    empty: list[int] = []
    some = np.add.reduceat(np.append(covered, False), chunk.starts) > 0 if len(covered) and len(chunk.starts) else np.zeros(len(chunk.starts), bool)
    for d, (text, size, start, any_) in enumerate(zip(chunk.texts, chunk.sizes.tolist(), chunk.starts.tolist(), some.tolist(), strict=True)):
        starts, ends, removed = empty, empty, 0
        if any_ and size:
            gone = covered[start : start + size]
            if characters:
                gone = whole_characters(text, gone)
            turn = np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))
            starts, ends, removed = np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), int(np.count_nonzero(gone))
        if not chunk.words:
            kept = text if not removed else b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, size], strict=True))
        else:
            words = text.split()
            for a, b in zip(reversed(starts), reversed(ends), strict=True):
                del words[a:b]
            kept = b" ".join(words)
        h = xxhash.xxh64_intdigest(text, 42)
        row = (None if chunk.null[d] else int(chunk.ids[d]), h - (1 << 64) if h >> 63 else h, size, removed, starts, ends, kept)
        for x, y in zip(out, row, strict=True):
            x.append(y)
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])
