"""Repeated passages of bytes by refining buckets of suffixes.

A suffix's bucket is a content identifier of its first bytes, so a bucket has the same name in every task. Buckets of
q-grams (q = 8) become those of longer ones by pairing a place's bucket with that of a later offset, and each round of that
uses the buckets of the last again (``refine``). What cannot repeat leaves early, so that later rounds sort less:

1. Initial buckets: of the suffixes in a window one is looked at, its anchor (the leftmost least ``anchor``-gram, so equal
   windows have equal anchors). Anchors are sorted; those in one place only leave, with all their windows.
2. A run of neighbouring windows with one anchor is a segment. Segments are sorted by their anchor's bucket and by that of
   the segment's ends. One whose refined bucket holds a smaller document is settled as a copy; an anchor whose segments all
   fall into one refined bucket is settled whole.
3. What is left is sorted suffix by suffix, by the bucket of its first half and by that of the later offset where the half ends.
4. Each chunk joins what it was told with what repeats inside itself, and marks the covered bytes.

Documents are packed into compressed chunks. Of equal entries a chunk sends one, with the least document id; it is told a code per
entry, in the order sent. So a hot passage costs one entry per chunk, not one per document, and unique text costs its anchors
only. Buckets of anchors have 48 bits, and a refined bucket is a pair of two such.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.chunks import RESULT, Chunk, chunked, each_chunk, mix, refine, refine_at, results, runs, sliding_argmin, unpack_chunk
from corpusloom.llm.common import cut, fresh

_GRAM = 8


@dataclass(frozen=True)
class Rule:
    """A window has ``length`` bytes, an anchor ``anchor``; a window counts as repeated if it starts in a document with a smaller id. ``step``
    windows are hashed at once; ``chunk_bytes`` of text make a chunk, ``bucket_bytes`` a group of buckets sorted together."""

    length: int = 50
    anchor: int = 20
    step: int = 1 << 15
    chunk_bytes: int = 2 << 20
    bucket_bytes: int = 16 << 20


def grams(data: bytes) -> np.ndarray:
    """Buckets of the q-grams of a text."""
    return np.ndarray((len(data) - _GRAM + 1,), "<u8", data, strides=(1,)).copy() if len(data) >= _GRAM else np.empty(0, np.uint64)


def read_bytes(docs: bytes) -> tuple[Chunk, bytes]:
    """A chunk, and its documents' bytes one after the other."""
    chunk = unpack_chunk(docs)
    chunk.sizes = np.fromiter(map(len, chunk.texts), np.int64, len(chunk.texts))
    chunk.starts = np.cumsum(chunk.sizes) - chunk.sizes
    return chunk, b"".join(chunk.texts)


@dataclass
class Segments:
    doc: np.ndarray  # index in the chunk
    low: np.ndarray  # first window, in the chunk
    high: np.ndarray  # last window
    anchor: np.ndarray  # 48 bits
    content: np.ndarray  # 48 bits, never 0


_SHORT = np.uint64(16)


def segments(rule: Rule, chunk: Chunk, data: bytes) -> Segments:
    """Runs of windows with one anchor. The whole chunk is looked at, then runs are cut at the documents' last windows."""
    reach = rule.length - rule.anchor + 1
    total = len(data) - rule.length + 1
    lows, names, wholes, last = [], [], [], -1
    ends = chunk.starts + chunk.sizes - rule.length  # the documents' last windows
    some = np.flatnonzero(chunk.sizes >= rule.length)
    for s in range(0, max(total, 0), rule.step):
        n = min(rule.step, total - s)
        (anchors,) = refine(grams(data[s : s + n + rule.length - 1]), _GRAM, rule.anchor)
        place = sliding_argmin(anchors, reach)
        begin = np.flatnonzero(np.diff(place, prepend=last - s))
        last = int(place[-1]) + s
        lows.append(begin + s)
        names.append(anchors[place[begin]])
    if not len(some):
        return Segments(*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 2)
    low, name = np.concatenate(lows), np.concatenate(names)
    high = np.append(low[1:], total) - 1
    # the runs a document's windows fall into
    first, final = np.searchsorted(low, chunk.starts[some], "right") - 1, np.searchsorted(low, ends[some], "right") - 1
    count = final - first + 1
    of = np.repeat(some, count)
    run = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    low, high, name = np.maximum(low[run], chunk.starts[of]), np.minimum(high[run], ends[of]), name[run]
    head = buckets_at(rule, data, low, rule.length)
    content = mix(mix(head, buckets_at(rule, data, high, rule.length)), (high - low).astype(np.uint64)) >> _SHORT
    return Segments(of, low, high, name >> _SHORT, np.maximum(content, np.uint64(1)))


def buckets_at(rule: Rule, data: bytes, at: np.ndarray, *lengths: int) -> np.ndarray:
    """Buckets of the grams of a length that start at the places, which ascend."""
    (length,) = lengths
    out = np.empty(len(at), np.uint64)
    cut = np.searchsorted(at, np.arange(0, len(data) + rule.step, rule.step))
    for k, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if e > s:
            base = k * rule.step
            out[s:e] = refine_at(grams(data[base : base + rule.step + length]), _GRAM, length, at[s:e] - base)
    return out


def windows_of(rule: Rule, data: bytes, seg: Segments, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment index, window, bucket of its first half, bucket at the later offset where it ends) for every window of the chosen segments."""
    half = (rule.length + 1) // 2
    count = seg.high[chosen] - seg.low[chosen] + 1
    of = np.repeat(chosen, count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seg.low[chosen], count)
    first = buckets_at(rule, data, window, half)
    return of, window, first >> _SHORT, buckets_at(rule, data, window + rule.length - half, half) >> _SHORT


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, so that equal bytes stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view(np.uint64), at + n * width


def freeze(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of 64-bit numbers (the first ascending, kept as differences) as one compressed blob."""
    (first, width), *rest = columns
    gaps = np.diff(first, prepend=np.uint64(0))
    data = np.array([len(first)], "<i8").tobytes() + _planes(gaps, width) + b"".join(_planes(x.view(np.uint64), w) for x, w in rest)
    return zstandard.ZstdCompressor(1).compress(data)


def thaw(blob: bytes, *widths: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for w in widths:
        x, at = _unplanes(data, at, n, w)
        out.append(x)
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _batch(names: str, *columns) -> pa.RecordBatch:
    kinds = [pa.binary() if len(x) and isinstance(x[0], bytes) else pa.int64() for x in columns]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names.split())


def _rank(chunk: Chunk) -> np.ndarray:
    """Ids as unsigned numbers in their order; a null id comes last and is before none."""
    up = (chunk.ids.view(np.uint64) ^ np.uint64(1 << 63)).copy()
    up[chunk.null] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return up


def _deal(buckets: int, key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets of ascending keys that have any, and the places of their entries."""
    bucket = (mix(key, key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    start, count = runs(bucket[order])
    return bucket[order][start], [order[s : s + c] for s, c in zip(start.tolist(), count.tolist(), strict=True)]


def _sent(number: int, buckets: int, columns: list[tuple[np.ndarray, int]]) -> pa.RecordBatch | None:
    """Rows (bucket, chunk, entries); the first column is the key, in ascending order."""
    if not len(columns[0][0]):
        return None
    bucket, places = _deal(buckets, columns[0][0])
    return _batch("bucket chunk entries", bucket.tolist(), [number] * len(places), [freeze([(x[p], w) for x, w in columns]) for p in places])


def _said(buckets: int, key: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """One code per key: 0, or what the round's answers say of it."""
    out = np.zeros(len(key), np.uint8)
    if len(key) and answers:
        for bucket, p in zip(*_deal(buckets, key), strict=True):
            if int(bucket) in answers:
                out[p] = np.frombuffer(zstandard.ZstdDecompressor().decompress(answers[int(bucket)]), np.uint8)
    return out


ENTRIES = "bucket long, chunk long, entries binary"
#: Rounds, widths of their entries' columns in bytes, and codes of the answers.
SHARED, COPIES, WINDOWS = range(3)
_WIDTHS = {SHARED: (6,), COPIES: (6, 6, 8), WINDOWS: (6, 6, 8)}
COVERED, MIXED = 1, 2


def answer(kind: int, columns: list[np.ndarray]) -> np.ndarray:
    """A code for each entry (bucket, bucket refined by what is at later offsets, least document); those of one chunk differ in their buckets.

    SHARED: 1 if another chunk has the bucket. Else: COVERED if the refined bucket holds a smaller document than the entry's. If it does
    not, MIXED if the bucket's suffixes fall into several refined buckets.
    """
    order = np.lexsort(columns[1::-1])
    bucket = columns[0][order]
    code = np.zeros(len(order), np.uint8)
    if kind == SHARED:
        _, count = runs(bucket)
        code[order] = np.repeat(count > 1, count)
        return code
    refined, least = columns[1][order], columns[2][order]
    start, count = runs(bucket, refined)
    covered = np.repeat(np.minimum.reduceat(least, start), count) < least
    start, count = runs(bucket)
    mixed = np.repeat(refined[start] != refined[start + count - 1], count)
    code[order] = np.where(covered, COVERED, np.where(mixed, MIXED, 0))
    return code


def _resolve(kind: int, entries: DataFrame) -> DataFrame:
    """Sort each group of buckets and send every chunk a code per entry, in the order it sent them."""

    def run(table: pa.Table) -> pa.Table:
        parts = [thaw(x.as_py(), *_WIDTHS[kind]) for x in table.column("entries")]
        sizes = np.array([len(p[0]) for p in parts])
        code = answer(kind, [np.concatenate(x) for x in zip(*parts, strict=True)])
        ends = np.cumsum(sizes)
        some = [i for i, (s, e) in enumerate(zip(ends - sizes, ends, strict=True)) if code[s:e].any()]
        pack = zstandard.ZstdCompressor(1).compress
        return pa.table(
            {
                "chunk": table.column("chunk").take(pa.array(some, pa.int64())),
                "kind": pa.array([kind] * len(some), pa.int32()),
                "bucket": table.column("bucket").take(pa.array(some, pa.int64())),
                "codes": pa.array([pack(code[ends[i] - sizes[i] : ends[i]].tobytes()) for i in some], pa.binary()),
            }
        )

    return entries.groupBy("bucket").applyInArrow(run, "chunk long, kind int, bucket long, codes binary")


class Entries:
    """Different pairs of buckets of some suffixes, in ascending order, each with its least document; ``of`` tells each suffix's pair."""

    def __init__(self, bucket: np.ndarray, refined: np.ndarray, rank: np.ndarray):
        order = np.argsort(mix(bucket, refined))
        start, count = runs(bucket[order], refined[order]) if len(order) else (order, order)
        pairs = bucket[order[start]], refined[order[start]], np.minimum.reduceat(rank[order], start) if len(order) else rank
        back = np.lexsort(pairs[1::-1])
        place = np.empty(len(back), np.int64)
        place[back] = np.arange(len(back))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(place, count)
        self.bucket, self.refined, self.least = (x[back] for x in pairs)

    def columns(self) -> list[tuple[np.ndarray, int]]:
        return [(self.bucket, 6), (self.refined, 6), (self.least, 8)]


class _View:
    """A chunk, its segments, and what the rounds have said so far."""

    def __init__(self, rule: Rule, buckets: int, docs: bytes, answers: list[dict] | None):
        self.rule, self.buckets = rule, buckets
        self.said: dict[int, dict[int, bytes]] = {k: {} for k in _WIDTHS}
        for a in answers or []:
            self.said[a["kind"]][a["bucket"]] = a["codes"]
        self.chunk, self.data = read_bytes(docs)
        self.seg = segments(rule, self.chunk, self.data)
        self.own = _rank(self.chunk)[self.seg.doc]
        order = np.argsort(self.seg.anchor)
        self.start, self.count = runs(self.seg.anchor[order]) if len(order) else (order, order)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(self.start)), self.count)
        self.key = self.seg.anchor[order][self.start]

    def _codes(self, kind: int, key: np.ndarray) -> np.ndarray:
        return _said(self.buckets, key, self.said[kind])

    def shared(self) -> list[tuple[np.ndarray, int]]:
        return [(self.key, 6)]

    def copies(self) -> list[tuple[np.ndarray, int]]:
        self.common = np.flatnonzero((self._codes(SHARED, self.key) > 0)[self.group]) if len(self.group) else self.group
        self.refined = Entries(self.seg.anchor[self.common], self.seg.content[self.common], self.own[self.common])
        return self.refined.columns()

    def suffixes(self) -> np.ndarray:
        """Segments that are sorted window by window; ``self.copied`` says of each segment whether another chunk settles it."""
        key = self.copies()[0][0]
        code = np.zeros(len(self.seg.doc), np.uint8)
        code[self.common] = self._codes(COPIES, key)[self.refined.of]
        self.copied = code == COVERED
        return np.flatnonzero(code == MIXED)

    def windows(self) -> list[tuple[np.ndarray, int]]:
        of, _, first, later = windows_of(self.rule, self.data, self.seg, self.suffixes())
        return Entries(first, later, self.own[of]).columns()

    def covered(self) -> np.ndarray:
        """Whether each byte of the chunk is in a repeated window."""
        rule, seg, own = self.rule, self.seg, self.own
        sent = self.suffixes()
        edge = np.zeros(len(self.data) + 1, np.int32)
        if not len(seg.doc):
            return np.zeros(len(self.data), bool)
        # what several segments of an anchor say of each other within the chunk
        near = np.flatnonzero((self.count > 1)[self.group])
        inside = Entries(seg.anchor[near], seg.content[near], own[near])
        whole = self.copied.copy()
        whole[near] |= inside.least[inside.of] < own[near]
        np.add.at(edge, seg.low[whole], 1)
        np.add.at(edge, seg.high[whole] + rule.length, -1)

        # window by window: what is not settled, all else of its anchors to compare with, and what was sent
        several = np.zeros(len(self.start), bool)
        start, count = runs(inside.bucket) if len(near) else (near, near)
        several[np.searchsorted(self.key, inside.bucket[start])] = count > 1
        open_ = ~whole & several[self.group]
        open_[sent] |= ~whole[sent]
        anchors = np.zeros(len(self.start), bool)
        anchors[self.group[open_]] = True
        chosen = anchors[self.group]
        chosen[sent] = True
        of, window, first, later = windows_of(rule, self.data, seg, np.flatnonzero(chosen))
        found = Entries(first, later, own[of])
        hit = found.least[found.of] < own[of]
        told = np.zeros(len(seg.doc), bool)
        told[sent] = True
        part = np.flatnonzero(told[of])
        asked = Entries(first[part], later[part], own[of[part]])
        # what another chunk says of a window holds for all of this chunk's occurrences
        hit[part] |= (self._codes(WINDOWS, asked.bucket) == COVERED)[asked.of]
        np.add.at(edge, window[hit], 1)
        np.add.at(edge, window[hit] + rule.length, -1)
        return np.cumsum(edge[:-1]) > 0


def mark_repeats(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, text_hash (XXH64 of the whole text, seed 42), n_units (bytes), n_removed, starts and
    ends (offsets of the maximal covered runs, ascending, ends exclusive) and kept (the bytes left).

    A null text counts as empty; texts shorter than a window have no run. Rows that repeat an id are documents of their own
    (none has the smaller id). A null id is larger than any other. ``characters``: bytes of a character stay or go together.
    Malformed UTF-8 is replaced. Other columns are not looked at. An empty table gives an empty one.
    """
    chunks = chunked(df, rule.chunk_bytes, id_col, text_col)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // rule.bucket_bytes))
    chunks = chunks.select("chunk", "docs")

    def with_answers(answers: DataFrame | None) -> DataFrame:
        if answers is None:
            return chunks.withColumn("answers", F.lit(None).cast("array<struct<kind:int,bucket:bigint,codes:binary>>"))
        told = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "codes")).alias("answers"))
        return chunks.join(told, "chunk", "left")

    answers = None
    for kind, send in ((SHARED, _View.shared), (COPIES, _View.copies), (WINDOWS, _View.windows)):

        def entries(number: int, docs: bytes, told: list[dict] | None, send=send) -> pa.RecordBatch | None:
            return _sent(number, buckets, send(_View(rule, buckets, docs, told)))

        said = cut(_resolve(kind, each_chunk(with_answers(answers), ENTRIES, entries)))
        answers = said if answers is None else answers.unionByName(said)

    def finish(number: int, docs: bytes, told: list[dict] | None) -> pa.RecordBatch:
        view = _View(rule, buckets, docs, told)
        return results(view.chunk, view.covered(), characters)

    return each_chunk(with_answers(answers), RESULT, finish)


def drop_passages(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, in its own columns, with texts less their covered bytes; a character goes if any of its bytes does.

    No row goes, an emptied text is left empty and a null one null. Rows that repeat both id and text lose the same. Malformed UTF-8 is
    replaced. Columns may have any name.
    """
    i, own, null, left = fresh(df, "id", "own", "null", "left")
    # what a text loses depends on its id and itself, so one answer does for all rows that repeat both
    found = mark_repeats(df, rule, id_col, text_col, characters=True).dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias(i), F.col("text_hash").alias(own), F.col("kept").alias(left))
    text = F.coalesce(F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")), F.lit(""))
    rows = df.withColumns({null: F.col(f"`{text_col}`").isNull(), f"{own}_": F.xxhash64(text), f"{i}_": F.col(f"`{id_col}`").cast("long")}).drop(text_col)
    rows = rows.join(found, F.col(f"{i}_").eqNullSafe(F.col(i)) & (F.col(f"{own}_") == F.col(own)))
    return rows.withColumn(text_col, F.when(~F.col(null), F.col(left).cast("string"))).select(*[f"`{c}`" for c in df.columns])
