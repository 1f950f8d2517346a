"""Repeated passages of words by a compacted De Bruijn graph.

Every window of ``length`` words is an edge between the two grams of ``length - 1`` words in it. An edge is repeated if it
occurs twice or more, and a document is a walk over edges.

1. Windows that may repeat: each has one anchor, its leftmost least gram of ``anchor`` words, so equal windows have equal
   anchors. Anchors found once in the corpus are left behind with their windows.
2. The nodes of all other edges, each with what stands before and after it. A node whose surroundings differ anywhere
   branches (or a walk begins or ends there); this is an aggregate over nodes, joined back to the chunks.
3. Between branching nodes lie the compacted paths. All edges of a path occur equally often, so a path is one row: its end
   nodes, its length, and a 128-bit digest of the words read at its coordinates. Paths are counted by these.
4. The words of paths that occur twice or more are covered.

Rows are combined within a chunk before they are shuffled, so a hot passage costs a row or two per chunk. Anchors and paths
are aggregated, which combines again in each task, and looked up by joins that split hot keys.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.chunks import RESULT, Chunk, chunked, each_chunk, mix, refine, results, runs, sliding_argmin, unpack_chunk, word_hashes
from corpusloom.llm.common import skew_join, stored

#: Stand for what is before the first and after the last word.
_BEGIN, _END = np.uint64(1), np.uint64(2)


@dataclass(frozen=True)
class Graph:
    """An edge has ``length`` words, an anchor ``anchor``. ``step`` words are hashed at once; ``chunk_bytes`` of text make a chunk."""

    length: int = 35
    anchor: int = 10
    step: int = 1 << 15
    chunk_bytes: int = 4 << 20


def read_words(docs: bytes) -> tuple[Chunk, np.ndarray]:
    """A chunk and the hashes of all its words, one document after the other."""
    chunk = unpack_chunk(docs)
    chunk.words = True
    joined = b" ".join(chunk.texts)
    hashes, begin, _ = word_hashes(joined)
    length = np.fromiter(map(len, chunk.texts), np.int64, len(chunk.texts)) + 1
    first = np.cumsum(length) - length  # of each text's bytes
    chunk.starts = np.searchsorted(begin, first)
    chunk.sizes = np.diff(np.append(chunk.starts, len(begin)))
    return chunk, hashes


def grams_at(hashes: np.ndarray, at: np.ndarray, length: int, step: int) -> np.ndarray:
    """Identifiers of the grams of ``length`` words that start at the places, which ascend."""
    out = np.empty(len(at), np.uint64)
    edge = np.searchsorted(at, np.arange(0, len(hashes) + step, step))
    for k, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if e > s:
            out[s:e] = refine(hashes[k * step : (k + 1) * step + length - 1], 1, length)[0][at[s:e] - k * step]
    return out


def windows(rule: Graph, chunk: Chunk, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows, ascending, and the places and identifiers of their anchors."""
    count = np.maximum(chunk.sizes - rule.length + 1, 0)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(chunk.starts, count)
    name, place = np.empty(len(at), np.uint64), np.empty(len(at), np.int64)
    edge = np.searchsorted(at, np.arange(0, len(hashes) + rule.step, rule.step))
    for k, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if e > s:
            low = k * rule.step
            (anchors,) = refine(hashes[low : low + rule.step + rule.length - 1], 1, rule.anchor)
            found = sliding_argmin(anchors, rule.length - rule.anchor + 1)[at[s:e] - low]
            name[s:e], place[s:e] = anchors[found], found + low
    return at, place, name


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(rule: Graph, number: int, docs: bytes) -> pa.RecordBatch:
    """(anchor, chunk, several): the chunk's anchors, and whether one may stand at several places in it."""
    chunk, hashes = read_words(docs)
    _, place, name = windows(rule, chunk, hashes)
    key = np.sort(name[np.flatnonzero(np.diff(place, prepend=-1))])
    start, count = runs(key)
    return pa.RecordBatch.from_arrays([_signed(key[start]), pa.array(np.full(len(start), number)), pa.array(count > 1)], names=["anchor", "chunk", "several"])


class Walks:
    """A chunk's runs of neighbouring windows whose anchors are shared, with their nodes."""

    def __init__(self, rule: Graph, docs: bytes, shared: list[int] | None):
        self.rule = rule
        self.chunk, self.hashes = read_words(docs)
        at, _, name = windows(rule, self.chunk, self.hashes)
        at = at[np.isin(name, np.array(shared or [], np.int64).view(np.uint64))]
        doc = np.searchsorted(self.chunk.starts, at, "right") - 1 if len(at) else at
        # of documents without words several start at one place; the last of them holds the words
        begin = np.ones(len(at), bool)
        begin[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        self.low = at[begin]
        self.high = at[np.append(np.flatnonzero(begin)[1:], len(at)) - 1] if len(at) else at
        self.doc = doc[begin]
        # a run of windows low..high has the nodes low..high + 1
        count = self.high - self.low + 2 if len(at) else at
        self.of = np.repeat(np.arange(len(self.low)), count)
        self.place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.low, count)
        self.node = grams_at(self.hashes, self.place, rule.length - 1, rule.step)

    def surroundings(self) -> np.ndarray:
        """What stands before and after each node, as one identifier."""
        starts, sizes = self.chunk.starts[self.doc][self.of], self.chunk.sizes[self.doc][self.of]
        after = self.place + self.rule.length - 1
        padded = np.append(self.hashes, _END)
        before = np.where(self.place > starts, padded[self.place - 1], _BEGIN)
        return mix(before, np.where(after < starts + sizes, padded[np.minimum(after, len(self.hashes))], _END))

    def paths(self, branching: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each compacted path, and the identifier of its end nodes and length."""
        cut = np.isin(self.node, np.array(branching or [], np.int64).view(np.uint64))
        inner = np.ones(len(self.node), bool)
        inner[1:] &= self.of[1:] == self.of[:-1]
        inner[:1] = False
        last = np.append(self.of[1:] != self.of[:-1], True) if len(self.of) else np.empty(0, bool)
        begin = np.flatnonzero(~last & (~inner | cut))  # nodes from which a path goes on
        end = np.flatnonzero(inner & (last | cut))  # nodes in which one ends
        return self.place[begin], self.place[end] - 1, mix(mix(self.node[begin], self.node[end]), (end - begin).astype(np.uint64))

    def digests(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words from each first to the end of each last window, read at these coordinates."""
        out, held, words = bytearray(), -1, []
        doc = np.searchsorted(self.chunk.starts, low, "right") - 1 if len(low) else low
        for d, a, b in zip(doc.tolist(), (low - self.chunk.starts[doc]).tolist(), (high - self.chunk.starts[doc] + self.rule.length).tolist(), strict=True):
            if d != held:
                held, words = d, self.chunk.texts[d].split()
            out += hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest()
        pair = np.frombuffer(bytes(out), "<i8").reshape(-1, 2)
        return np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])


def _nodes(rule: Graph, number: int, docs: bytes, shared: list[int] | None) -> pa.RecordBatch:
    """(node, around, chunk) of the chunk's walks: for each node its least and, if it is another, its greatest surroundings."""
    walks = Walks(rule, docs, shared)
    around = walks.surroundings()
    order = np.argsort(walks.node)
    node, around = walks.node[order], around[order]
    start, _ = runs(node) if len(node) else (order, order)
    least, most = (f.reduceat(around, start) if len(start) else around for f in (np.minimum, np.maximum))
    two = least != most
    rows = [np.concatenate([node[start], node[start][two]]), np.concatenate([least, most[two]])]
    return pa.RecordBatch.from_arrays([*map(_signed, rows), pa.array(np.full(len(rows[0]), number))], names=["node", "around", "chunk"])


def _paths(rule: Graph, number: int, docs: bytes, shared: list[int] | None, branching: list[int] | None) -> pa.RecordBatch:
    """(path, one, two, chunk, n): the chunk's compacted paths with their digests, and how often it has each."""
    walks = Walks(rule, docs, shared)
    low, high, path = walks.paths(branching)
    one, two = walks.digests(low, high)
    order = np.lexsort((two, one, path))
    start, count = runs(path[order], one[order], two[order]) if len(order) else (order, order)
    first = order[start]
    return pa.RecordBatch.from_arrays([_signed(path[first]), pa.array(one[first]), pa.array(two[first]), pa.array(np.full(len(first), number)), pa.array(count.astype(np.int64))], names=["path", "one", "two", "chunk", "n"])


def _finish(rule: Graph, number: int, docs: bytes, shared: list[int] | None, branching: list[int] | None, repeated: list[dict] | None) -> pa.RecordBatch:
    walks = Walks(rule, docs, shared)
    edge = np.zeros(len(walks.hashes) + 1, np.int32)
    if repeated:
        low, high, path = walks.paths(branching)
        maybe = np.isin(path, np.array([r["path"] for r in repeated], np.int64).view(np.uint64))
        low, high, path = low[maybe], high[maybe], path[maybe]
        one, two = walks.digests(low, high)
        known = {(r["path"], r["one"], r["two"]) for r in repeated}
        told = np.fromiter((x in known for x in zip(path.view(np.int64).tolist(), one.tolist(), two.tolist(), strict=True)), bool, len(path))
        np.add.at(edge, low[told], 1)
        np.add.at(edge, high[told] + rule.length, -1)
    return results(walks.chunk, np.cumsum(edge[:-1]) > 0)


def mark_repeats(df: DataFrame, rule: Graph = Graph(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, text_hash (XXH64 of the whole text, seed 42), n_units (words), n_removed, starts and ends (word
    offsets of the maximal covered runs, ascending, ends exclusive) and kept (the words left, joined by one space).

    A null text has no word; texts shorter than a window have no run. Rows that repeat an id or a text are documents of their
    own, so their windows are repeated. Malformed UTF-8 is replaced. Other columns are not looked at. An empty table gives an empty one.
    """
    chunks = chunked(df, rule.chunk_bytes, id_col, text_col).select("chunk", "docs")

    def told(rows: DataFrame, value, name: str) -> DataFrame:
        return rows.groupBy("chunk").agg(F.collect_list(value).alias(name))

    anchors = stored(each_chunk(chunks, "anchor long, chunk long, several boolean", lambda number, docs: _anchors(rule, number, docs)), "anchors")
    often = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("several")).filter("n > 1 or several").select("anchor")
    shared = stored(told(skew_join(anchors, often, ["anchor"]), F.col("anchor"), "shared"), "shared")
    chunks = chunks.join(shared, "chunk", "left")

    # two rows a chunk and node at most, so the rows of a node are moved once and sorted, with room on disk
    nodes = each_chunk(chunks, "node long, around long, chunk long", lambda number, docs, shared: _nodes(rule, number, docs, shared))
    whole = W.partitionBy("node")
    branching = nodes.withColumns({"x": F.min("around").over(whole), "y": F.max("around").over(whole)}).filter("x < y")
    branching = stored(branching.groupBy("chunk").agg(F.collect_set("node").alias("branching")), "branching")
    chunks = chunks.join(branching, "chunk", "left")

    keys = ["path", "one", "two"]
    paths = stored(each_chunk(chunks, "path long, one long, two long, chunk long, n long", lambda *row: _paths(rule, *row)), "paths")
    several = paths.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 1").select(*keys)
    repeated = stored(told(skew_join(paths, several, keys), F.struct(*keys), "repeated"), "repeated")
    return each_chunk(chunks.join(repeated, "chunk", "left"), RESULT, lambda *row: _finish(rule, *row))
