"""SimHash near-dedup with deletion-variant signatures.

A text's fingerprint takes each bit by majority over the hashes of its word shingles. It is cut into
fewer segments than one would need for equal ones: so few that of two near texts one segment differs in
a single bit at most. Each segment is indexed under its variants with one bit wildcarded; an equality
join brings together all that share a variant, and what it brings is verified.

Two uses:

* ``near_duplicates``: 64-bit fingerprints of three-word shingles, two segments of 32 bits. Fingerprints within 3 bits have a
  segment that differs in one bit at most, so no link is lost. A signature's members are streamed in their order; those of
  one with more than ``group`` are cut once more by the same rule on the other half (2 x 16 variants), after which a
  group holds at most 2**18 fingerprints, whatever the corpus.
* ``drop_near``: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Their fingerprints (of
  two-word shingles, which an edit changes less) differ in a tenth of the bits, so there are more and longer segments.
  Members of a signature are compared by their whole fingerprints, what is left by the shingles themselves.

A group is searched outwards from each member over those not reached yet, which yields the links that
connect it and never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bloom
from corpusloom.llm.chunks import word_hashes
from corpusloom.llm.common import at_rest, compact, cut, skew_join, small_batches
from corpusloom.llm.components import components, roots

BITS = 3
BLOCK = 1 << 14
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Of rows of 64-bit words the bits that are set in over half of them, as words."""
    total = sum(map(len, hashes))
    ones = sum(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64) for h in hashes)
    return np.packbits(2 * ones > total).view(">u8").astype(np.uint64)


def fingerprint(data: bytes, size: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 if it has no word."""
    words = data.lower().split()  # of bytes: A-Z only, and the separators of WORD_GAP
    n = len(words)
    if not n:
        return 0
    if n < size:
        words, n, size = [b" ".join(words)], 1, 1
    made, total = [], n - size + 1
    for at in range(0, total, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        joined = b" ".join(part)
        length = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(length + 1) - 1
        start = end - length
        made.append(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[: len(part) - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)], np.uint64))
    return int(majority(made)[0])


def _per_text(df: DataFrame, value: Callable[[bytes], object], name: str, kind: pa.DataType, sql: str) -> DataFrame:
    """(doc_id, ``value`` of the text's bytes) for rows (doc_id, text); a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                made = pa.array([value(t.as_py() or b"") for t in part.column(1).cast(pa.large_binary())], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["doc_id", name])
        at_rest()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, f"doc_id long, {name} {sql}")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long) for every row; a null text has no word."""
    signed = lambda t: int(np.uint64(fingerprint(t, size)).view(np.int64))
    return _per_text(_rows(df, id_col, text_col), signed, "fp", pa.int64(), "long")


def signatures(segments: Column, width: int) -> Column:
    """Longs: place of the segment, wildcarded bit (5 bits), the segment's low ``width`` bits (32 at most) with that bit cleared."""
    bits = F.sequence(F.lit(0), F.lit(width - 1))
    whole = F.lit((1 << width) - 1)

    def variants(segment: Column, place: Column) -> Column:
        head = F.shiftleft(place.cast("long"), 37)
        return F.transform(bits, lambda j: head.bitwiseOR(F.shiftleft(j.cast("long"), 32)).bitwiseOR(segment.bitwiseAND(whole).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j)))))

    return F.flatten(F.transform(segments, variants))


def _halves(fp: Column) -> Column:
    return F.array(fp.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(fp, 32))


def _finer(key: Column, fp: Column) -> Column:
    """32 longs that cut a signature's group on the other half."""
    other = F.when(F.shiftright(key, 37) == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit((1 << 32) - 1)))
    return signatures(F.array(other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)), 16)


def connect(members: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """Places of members and of one that each of them is near: links that connect the rows of 64-bit words as all those within ``bits`` bits would."""
    found, rest = [], np.arange(len(members))
    while rest.size:
        front, rest = [int(rest[0])], rest[1:]
        while front and rest.size:
            x = front.pop()
            near = np.bitwise_count(members[rest] ^ members[x]).sum(1, dtype=np.int64) <= bits
            if near.any():
                reached = rest[near]
                found.append((reached, x))
                rest = rest[~near]
                front.extend(reached.tolist())
    return found


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """Of rows sorted by the first ``keys`` columns: columns, starts of groups in them (and the end), and whether it is a part of one group that holds
    over ``most`` rows. A group may span batches, never tasks."""
    left, large = None, None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        if large is not None:  # the group in hand is one that is passed on in parts
            first = int(at[0]) if len(at) else len(new)
            if tuple(c[0] for c in cols[:keys]) == large:
                yield [c[:first] for c in cols], np.array([0, first]), True
                cols, at = [c[first:] for c in cols], at[1:] - first
            if not len(cols[0]):
                left = None
                continue
            large = None
        last = int(at[-1]) if len(at) else 0
        if last:
            yield [c[:last] for c in cols], np.concatenate([[0], at]), False
        left = [c[last:] for c in cols]
        if most is not None and len(left[0]) > most:
            large = tuple(c[0] for c in left[:keys])
            yield left, np.array([0, len(left[0])]), True
            left = None
    if left is not None and len(left[0]):
        yield left, np.array([0, len(left[0])]), False


def _fp_links(keys: int, group: int | None) -> Callable:
    """Links (a, b) of rows (key, ..., fp) sorted by these; members of larger groups than ``group`` come back as (fp, null, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at, large in _grouped(batches, keys, group):
            fp, size = cols[keys], np.diff(at)
            a, b, k = [], [], []
            if large or group is not None and (size > group).any():
                over = np.ones(len(fp), bool) if large else np.repeat(size > group, size)
                a, b, k = [fp[over]], [None] * int(over.sum()), [cols[0][over]]
            else:
                over = np.zeros(0, bool)
            two = at[:-1][size == 2] if not large else at[:0]
            near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= BITS
            x, y = [fp[two][near]], [fp[two + 1][near]]
            for s, e in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True) if not large else ():
                if group is None or e - s <= group:
                    for reached, one in connect(fp[s:e].view(np.uint64)[:, None], BITS):
                        x.append(fp[s:e][reached])
                        y.append(np.full(len(reached), fp[s + one]))
            link = [np.concatenate(v) for v in (x, y)]
            n, m = len(link[0]), len(b)
            if n + m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([link[0], *a])), pa.array([*link[1].tolist(), *b], pa.int64()), pa.array([*[None] * n, *(k[0].tolist() if k else [])], pa.int64())],
                    names=["a", "b", "large"],
                )

    return run


def dealt_signatures(prints: DataFrame, parts: int) -> DataFrame:
    """(key, fp): the 64 signatures of each fingerprint.

    A few bytes become 64 times as many: the tasks are set by number, dealt by an expression of their own so that no earlier
    exchange can stand in.
    """
    return prints.select("fp").repartition(parts, F.xxhash64("fp", F.lit(1))).select(F.explode(signatures(_halves(F.col("fp")), 32)).alias("key"), "fp")


def links(prints: DataFrame, group: int = 4096) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (fp) as all those within BITS bits would."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = dealt_signatures(prints, parts)
    found = compact(held.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_fp_links(1, group), "a long, b long, large long"))
    finer = found.filter("large is not null").select(F.col("large").alias("key"), F.explode(_finer(F.col("large"), F.col("a"))).alias("sub"), F.col("a").alias("fp"))
    finer = finer.repartition(parts, "key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(_fp_links(2, None), "a long, b long, large long")
    return found.filter("large is null").select("a", "b").unionByName(finer.select("a", "b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, group: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df``.

    The component is the set of rows reachable over links of at most 3 bits; its id is the
    smallest id in it (null only if all its ids are null). Texts without words (null, empty,
    blank) share fingerprint 0 and link like any other. Repeated rows share a component. Malformed
    UTF-8 is replaced. Other columns are not looked at. An empty table gives an empty one.
    """
    docs = cut(fingerprints(df, id_col, text_col, size))
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(prints.select("fp"), group)).withColumnRenamed("node", "fp")
    placed = compact(prints.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = skew_join(placed, names, ["root"]).select("fp", "component_id")
    return skew_join(docs, named, ["fp"]).select("doc_id", "fp", "component_id")


@dataclass(frozen=True)
class Likeness:
    """Near copies by Jaccard similarity of at least ``alike`` (a fraction) of sets of ``shingle``-word shingles.

    Fingerprints have ``words`` words of 64 bits, made of ``grain``-word shingles; each half of a word gives a segment of ``width`` bits. Two
    fingerprints are compared by their shingles if at most ``share`` of their bits differ. Past some 10**8 texts ``width`` should be 32.
    """

    alike: tuple[int, int] = (4, 5)
    shingle: int = 5
    grain: int = 2
    words: int = 6
    width: int = 28
    share: float = 0.2


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * _P1 + (b ^ (b >> np.uint64(29))) * _P2
    z ^= z >> np.uint64(32)
    return z * _P1 ^ z >> np.uint64(29)


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """Hashes of a text's word shingles in order, repeats included; a shorter text is one shingle."""
    one = word_hashes(data.lower())[0]
    if not len(one):
        return np.zeros(1, np.uint64)
    size = min(size, len(one))
    out = one[: len(one) - size + 1]
    for k in range(1, size):
        out = _mix(out, one[k : len(one) - size + 1 + k])
    return out


def long_fingerprint(data: bytes, rule: Likeness) -> bytes:
    hashes = shingle_hashes(data, rule.grain)
    seeds = np.arange(1, rule.words + 1, dtype=np.uint64)
    parts = [_mix(hashes[at : at + BLOCK, None], np.broadcast_to(seeds, (len(hashes[at : at + BLOCK]), rule.words))) for at in range(0, len(hashes), BLOCK)]
    return majority(parts).astype("<u8").tobytes()


def jaccard_links(sets: list[np.ndarray], alike: tuple[int, int]) -> list[tuple[np.ndarray, int]]:
    """Places of members and of one that each of them is alike: links that connect them as all their pairs that are near copies would."""
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    own = np.split(code, np.cumsum(size)[:-1])
    marked = np.zeros(code.max() + 1, bool)
    found, rest, flat = [], np.arange(len(sets)), code
    while len(rest) > 1:
        front, flat, rest = [rest[0]], flat[size[rest[0]] :], rest[1:]
        while front and len(rest):
            x = front.pop()
            marked[own[x]] = True
            both = np.add.reduceat(marked[flat], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            marked[own[x]] = False
            near = alike[1] * both >= alike[0] * (size[x] + size[rest] - both)
            if near.any():
                reached = rest[near]
                found.append((reached, int(x)))
                flat, rest = flat[np.repeat(~near, size[rest])], rest[~near]
                front.extend(reached)
    return found


GROUPS = "group long, doc_id long, known long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, doc_id, known) sorted by these, GROUPS of keys whose documents are not all known to be connected; keys with the same documents are one group."""
    seen: set[int] = set()
    names = [x.split()[0] for x in GROUPS.split(", ")]
    for (key, doc, known), at, large in _grouped(batches, 1, 1 << 16):
        size = np.diff(at)
        if large:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, known)], names=names)
            continue
        two = at[:-1][size == 2]
        two = two[known[two] != known[two + 1]]
        name = _mix(doc[two].view(np.uint64), doc[two + 1].view(np.uint64)).view(np.int64)
        name, first = np.unique(name, return_index=True)
        pairs = np.stack([two[first], two[first] + 1], 1).reshape(-1)
        out = [(np.repeat(name, 2), doc[pairs], known[pairs])]
        for s, e in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True):
            held = xxhash.xxh64_intdigest(doc[s:e].tobytes()) - (1 << 63)
            if held not in seen and (known[s:e] != known[s]).any():
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(held)
                out.append((np.full(e - s, held), doc[s:e], known[s:e]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)


def _new(found: list[tuple[np.ndarray, int]], known: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links between places those that connect what is not known to be connected, as ids of what is known."""
    parent = {k: k for k in known.tolist()}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    a, b = [], []
    for reached, x in found:
        for y in reached.tolist():
            p, q = root(int(known[x])), root(int(known[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(int(known[y]))
                b.append(int(known[x]))
    return a, b


def _least(found: list[tuple[np.ndarray, int]], ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links between places: each id that is connected to a smaller one, and the smallest."""
    if not found:
        return [], []
    x = np.concatenate([r for r, _ in found])
    nodes, low = roots(ids[x], ids[np.repeat([y for _, y in found], [len(r) for r, _ in found])])
    return nodes[low < nodes].tolist(), low[low < nodes].tolist()


def _by_group(rows: DataFrame, value: str, linked: Callable[[np.ndarray, list[bytes], np.ndarray], tuple[list[int], list[int]]]) -> DataFrame:
    """(a, b) that ``linked`` makes of each group's ids, values and what is known of them; rows: GROUPS and ``value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def made() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, known, values = zip(*held, strict=True)
                a, b = linked(np.array(ids, np.int64), list(values), np.array(known, np.int64))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for group, i, k, v in zip(*[batch.column(c).to_pylist() for c in range(3)], batch.column(3), strict=True):
                if group != last:
                    yield from made()
                    last, held = group, []
                held.append((i, k, v.as_py()))
        yield from made()

    return rows.select("group", "doc_id", "known", value).repartition("group").sortWithinPartitions("group", "doc_id").mapInArrow(run, "a long, b long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Likeness = Likeness()) -> DataFrame:
    """(doc_id, first): the ids that are linked over near copies to a smaller one, and the smallest; rows without an id have none."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(df, id_col, text_col).filter("doc_id is not null")

    def words(t: bytes) -> dict:
        return {"fp": long_fingerprint(t, rule), "same": xxhash.xxh3_128_digest(b" ".join(t.lower().split()))}

    kind = pa.struct([("fp", pa.binary()), ("same", pa.binary())])
    made = cut(_per_text(rows, words, "made", kind, "struct<fp: binary, same: binary>").select("doc_id", "made.*"))
    # texts of the same words are one, so that groups of copies are indexed once
    first = made.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = skew_join(made, first.filter("first < last").select("same", "first"), ["same"]).filter("doc_id <> first").select("doc_id", "first")
    prints = compact(skew_join(made, first.select("same", "first"), ["same"]).filter("doc_id = first").select("doc_id", "fp").dropDuplicates(["doc_id"]), 20_000)

    # words as longs: the halves of each are segments
    half = lambda k, h: F.conv(F.substring(F.hex("fp"), 16 * k + 8 * h + 1, 8), 16, 10).cast("long")
    segments = F.array(*[half(k, h) for k in range(rule.words) for h in range(2)])
    held = prints.select("doc_id", segments.alias("segments"))
    most = int(64 * rule.words * rule.share)

    def alike(ids: np.ndarray, values: list[bytes], known: np.ndarray) -> tuple[list[int], list[int]]:
        return _new(connect(np.frombuffer(b"".join(values), "<u8").reshape(len(values), -1), most), known)

    def found(held: DataFrame, keys: Column) -> DataFrame:
        """The least document of what equal keys and near fingerprints connect, of each that is connected; held: (doc_id, segments, known)."""
        dealt = held.repartition(parts, F.xxhash64("doc_id", F.lit(1))).select(F.explode(keys).alias("key"), "doc_id", "known")
        groups = dealt.repartition(parts, "key").sortWithinPartitions("key", "doc_id").mapInArrow(_members, GROUPS).distinct()
        return components(_by_group(groups.join(prints, "doc_id"), "fp", alike))

    # first those of equal segments; what these connect is one to the variants, which then say what else belongs together
    whole = F.lit((1 << rule.width) - 1)
    equal = F.transform("segments", lambda x, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(x.bitwiseAND(whole)))
    near = found(held.withColumn("known", F.col("doc_id")), equal)
    known = held.join(near, held["doc_id"] == near["node"], "left").select("doc_id", "segments", F.coalesce("root", "doc_id").alias("known"))
    more = found(known, signatures(F.col("segments"), rule.width)).select(F.col("node").alias("known"), F.col("root").alias("group"))
    placed = known.select("doc_id", "known").join(more, "known", "left").select(F.coalesce("group", "known").alias("group"), "doc_id", "known")
    several = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    placed = compact(skew_join(placed, several, ["group"]).select("group", "doc_id", "known"))

    # of groups of near fingerprints, those whose shingles are alike
    some = bloom.among(rows, "doc_id", placed.select("doc_id"))
    sets = _per_text(some.dropDuplicates(["doc_id"]), lambda t: np.unique(shingle_hashes(t, rule.shingle)).tobytes(), "items", pa.large_binary(), "binary")
    linked = lambda ids, values, _: _least(jaccard_links([np.frombuffer(v, np.uint64) for v in values], rule.alike), ids)
    least = compact(_by_group(placed.join(sets, "doc_id"), "items", linked).select(F.col("a").alias("doc_id"), F.col("b").alias("least")))
    copied = copies.join(least.withColumnRenamed("doc_id", "first"), "first", "left").select("doc_id", F.coalesce("least", "first").alias("first"))
    return least.withColumnRenamed("least", "first").unionByName(copied)


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Likeness = Likeness()) -> DataFrame:
    """The rows of ``df``, in its own columns, but those linked, over near copies, to one with a smaller id.

    Rows without an id stay. A null text counts as empty; texts of the same words are near copies, those without words too. Of
    rows that repeat an id one text is looked at, and all stay or go. An empty table gives an empty one. Columns may have any name.
    """
    return bloom.without(df, id_col, compact(near_copies(df, id_col, text_col, rule).select(F.col("doc_id").alias("node")).distinct()))


def near_dedup(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df``, in its own columns, whose id is their fingerprint's component's; rows without an id stay."""
    found = near_duplicates(df, id_col, **options)
    return bloom.without(df, id_col, compact(found.filter("doc_id <> component_id").select("doc_id").distinct()))
