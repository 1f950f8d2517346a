"""Training-data operators against brute force, round trips and held-out data."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import bpe, components, debruijn, exact_dedup, packing, quality, queries, sharding, simhash, suffixes, toxicity, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts():
    random.seed(3)
    letters = "abethn  \n\t'srtΣİ.,1290éßA漢字🙂  \x1c\x85-_<|>́"
    out = ["".join(random.choices(letters, k=random.randrange(120))) for _ in range(600)]
    return [*out, "", " ", "\n", " \n a", "a" * 3000, "it's we'll 's", "<|endoftext|>", "x <|endoftext|>\ny<|startoftext|>z", "a\0b"]


@pytest.fixture(scope="module")
def texts():
    return [t or "" for t in pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()] + odd_texts()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows and one very long text, with columns named like the operators' own."""
    base = "the quick brown fox jumps over the lazy dog and runs away from here"
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    rows = [(1, base, "en", "a", 3), (2, base, "en", "a", 3), (2, base, "en", "a", 3), (3, None, None, None, None), (4, "", "en", "b", 0), (None, base, "en", "b", 1), (5, long_, "en", "a", 5), (6, " \t\n", "de", "a", 2), (7, base + " x", "en", "a", 1), (8, "a b", "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in OWN_NAMES})


#: Names that the operators give to columns of their own.
OWN_NAMES = """
kept ids decoded shard slot rank size curve cell bucket part row first root node group key fp n x y a b large known shared branching repeated anchor around path chunk docs bytes bucket_id sequence_id
__sha __kept __keep_id __group_size __hash __possible __first __shadow __bucket __bitmap __bucket0 __bitmap0 __maybe __id __own __own_ __id_ __null __left __in __rejected __grade __severity __p_toxic __text
stratum quality n_words n_lines rejected_by base_failed total before inside at short longer edge
""".split()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# 1


def test_bpe_equals_library(texts):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTE_BPE), bpe.ByteBpe(BYTE_BPE)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(t[:80])
        assert own.decode(got) == library.decode(want, skip_special_tokens=False) == t


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    text = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    rows = queries.op1_bpe(spark, DATA).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_bpe_odd_rows(odd, empty):
    out = bpe.decode(bpe.encode(odd, BYTE_BPE), BYTE_BPE)
    assert out.count() == odd.count() and out.filter("decoded <> coalesce(text, '')").count() == 0
    assert bpe.encode(empty, BYTE_BPE).count() == 0


# 2


def _metrics(t):
    import re

    gap = r"[^\x20\x09-\x0D]+"
    w = re.findall(gap, t)
    lines = [x for x in t.split("\n") if re.search(gap, x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, texts):
    more = ["a b c d e " * 5, "x\nx\n\nx\n", "p q r s t u p q r s t", "é " * 12]
    rows = [(i, t, "en") for i, t in enumerate([*texts, *more]) if "\0" not in t]
    got = quality.text_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    want = {i: _metrics(t) for i, t, _ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], repr(rows[r.doc_id][1][:100])


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.05), (3, 200, 0.05), (10, 5000, 0.01), (300, 40_000, 0.01), (7, 100, 0.05)])
def test_binomial_tail(spark, k, n, p):
    from math import comb

    exact = 1.0 if k >= n * p else float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) if n < 1000 else None
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("t")).first().t
    if exact is None:
        from math import exp, lgamma, log, log1p

        exact = sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(exact, rel=1e-6)


def test_quality_cutoffs_reject_junk_and_hold(spark):
    random.seed(1)
    word = lambda: "".join(random.choices("abcdefg", k=5))
    good = lambda: " ".join(word() for _ in range(30))
    junk = lambda: " ".join(word() + "%%" for _ in range(30))
    rows = [(i, junk() if i % 4 == 0 else good(), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(3000)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()}
    assert all(out[i] == (i % 4 > 0) for i in range(4000))
    few = quality.quality_verdicts(docs, labels.limit(20))
    assert few.filter("not kept").count() == 0  # too few labels to vouch for any cutoff


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    out = quality.quality_verdicts(odd, labels)
    assert out.count() == odd.count() and out.filter("doc_id = 3 and n_words = 0 and base_failed and not kept").count() == 1
    assert quality.quality_verdicts(empty, labels).count() == 0


def test_quality_rules_all_fire_and_equal_sql(spark):
    """Labelled texts on which each rule finds a cutoff, against the same SQL."""
    import duckdb
    import pyarrow as pa

    random.seed(10)
    word = lambda n=5: "".join(random.choices("abcdefghijklmnop", k=n))
    good = lambda: "\n".join(" ".join(word() for _ in range(8)) for _ in range(6))
    junk = {
        "symbols": lambda: " ".join(word() + "%%" for _ in range(40)),
        "dup_lines": lambda: "\n".join([" ".join(word() for _ in range(3))] * 3 + [" ".join(word() for _ in range(60))]),
        "long_words": lambda: " ".join(word(35) for _ in range(20)),
        "short_words": lambda: " ".join(random.choice("abcdefgh") + random.choice(["", "", "i"]) for _ in range(60)),
    }
    rows, labels = [], []
    for lang in ("en", "de"):
        for i in range(3000):
            kind = random.choice([*junk]) if i % 4 == 0 else None
            rows.append((len(rows), junk[kind]() if kind else good(), lang, kind))
            labels.append((rows[-1][0], int(kind is None)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")
    out = quality.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    kind = {r[0]: r[3] for r in rows}
    fired = collections.Counter((kind[r.doc_id], x) for r in out for x in r.rejected_by)
    assert {k for k, x in fired if k == x} == set(junk)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}))
    con.register("labels", pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels]}))
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from ({queries.ORACLES['op2_quality_rules']})").fetchall()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out} == want


def test_quality_query(same_as_sql):
    same_as_sql(queries.op2_quality_rules, queries.ORACLES["op2_quality_rules"])


# 3


def test_hilbert_curve_is_continuous():
    for d, b in ((2, 4), (3, 3)):
        p = np.indices([1 << b] * d).reshape(d, -1).T
        h = sharding.hilbert_index(p, b)
        assert sorted(h.tolist()) == list(range(len(p)))
        assert np.abs(np.diff(p[np.argsort(h)], axis=0)).sum(1).max() == 1


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_shards(spark, bucket):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sharding.assign_shards(docs, 40, bucket=bucket).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    slots = collections.defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))
        slots[r.shard].append(r.slot)
    assert len(rows) == len(text) and set(slots) == set(range(40))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


def test_shard_query_by_brute_force(spark):
    """Codes, curve, shards and slots of the query, from plain Python over the whole table."""
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    rows = {r.doc_id: r for r in queries.op3_hilbert_sharding(spark, DATA).collect()}
    size = {d["doc_id"]: len((d["text"] or "").encode()) + 16 for d in docs}
    assert {i: (r["size"], r.text_crc32) for i, r in rows.items()} == {d["doc_id"]: (size[d["doc_id"]], zlib.crc32((d["text"] or "").encode())) for d in docs}

    def codes(values):
        """Quantiles as the least value that a share of the rows does not pass, and how many of these a value reaches."""
        held, n = sorted(values), len(values)
        cuts = [held[max(0, -(-n * k // 32) - 1)] for k in range(1, 32)]
        return [sum(c <= v for c in cuts) for v in values]

    axes = [codes([(d["lang"] or "").encode() for d in docs]), codes([(d["source"] or "").encode() for d in docs]), codes([size[d["doc_id"]] for d in docs])]
    index = sharding.hilbert_index(np.array(axes).T, sharding.BITS).tolist()
    assert {d["doc_id"]: c for d, c in zip(docs, index, strict=True)} == {i: r.curve for i, r in rows.items()}
    order = sorted(rows.values(), key=lambda r: (r.shard, r.slot))
    total, at = len(docs), 0
    for shard in range(40):
        n = total // 40 + (shard < total % 40)
        assert [(r.shard, r.slot) for r in order[at : at + n]] == [(shard, k) for k in range(n)]
        at += n
    assert [r.curve for r in order] == sorted(r.curve for r in order)
    assert {(r.law, r.grown_shard) for r in order} == {("rows", None)}


def test_equal_texts_lie_near_each_other(spark):
    rows = [(i, f"text {i % 50}" if i % 3 else "the same", "en", "s", 1) for i in range(3000)]
    found = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), 4, bucket=16).collect()
    place = {r.doc_id: (r.shard, r.slot) for r in found}
    order = {i: k for k, i in enumerate(sorted(place, key=place.get))}
    same = sorted(order[i] for i in range(0, 3000, 3))
    assert len(same) == 1000 and same[-1] - same[0] < 1000 + 4 * 16 + 200


def test_shards_prune_by_several_columns(spark, tmp_path):
    """Ranges in the manifest let a reader pass over most shards, whichever column it asks for."""
    random.seed(8)
    rows = [(i, "x" * random.randrange(1, 4000), random.choice(["de", "en", "es", "fr"]), f"src{random.randrange(20)}", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    manifest = sharding.write_shards(docs, str(tmp_path / "p"), 64).cache()
    read = lambda **w: sharding.shards_to_read(manifest, **w).count()
    assert read(lang=("en", "en")) <= 32 and read(source=("src7", "src7")) <= 32 and read(size=(16, 400)) <= 32
    assert read(lang=("en", "en"), size=(16, 400)) <= 16
    kept = {r.shard for r in sharding.shards_to_read(manifest, lang=("en", "en"), size=(16, 400)).collect()}
    back = spark.read.parquet(str(tmp_path / "p")).filter("lang = 'en' and octet_length(text) + 16 <= 400")
    assert {r.shard for r in back.select("shard").distinct().collect()} <= kept


def test_shards_odd_rows(spark, odd, empty, tmp_path):
    rows = sharding.assign_shards(odd, 40).collect()
    assert sorted(r.shard for r in rows) == list(range(len(rows))) and all(r.slot == 0 for r in rows)
    assert sharding.assign_shards(empty, 40).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    manifest = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r.shard: r.rows for r in manifest.collect()} == {r.shard: r["count"] for r in back.groupBy("shard").count().collect()}


# 4


def _fingerprint(t):
    w = t.encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(texts):
    for t in texts[::3]:
        assert simhash.fingerprint(t.encode()) == _fingerprint(t)


@pytest.mark.parametrize("group", [4096, 4])
def test_links_lose_nothing(spark, group, monkeypatch):
    monkeypatch.setattr(components, "ROWS", 100_000 if group > 4 else 10)
    random.seed(4)
    values = set()
    for _ in range(25):
        base = random.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(random.choice([1, 2, 3, 5, 8])):
                x ^= 1 << random.randrange(64)
            values.add(x)
    a = np.array(sorted(values), np.uint64)
    parent = list(range(len(a)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3), strict=True):
        parent[find(i)] = find(j)
    want = collections.defaultdict(set)
    for i, x in enumerate(a.view(np.int64).tolist()):
        want[find(i)].add(x)
    frame = spark.createDataFrame([(x,) for x in a.view(np.int64).tolist()], "fp long")
    got = collections.defaultdict(set)
    for r in components.components(simhash.links(frame, group)).collect():
        got[r.root].add(r.node)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_signatures_are_made_in_tasks_set_by_number(spark):
    """The exchange of fingerprints that are unique by an aggregate over them is one that the plan cannot leave out."""
    prints = spark.range(1000).select((F.col("id") % 900).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    dealt = simhash.dealt_signatures(prints, 7)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    assert dealt.rdd.getNumPartitions() == 7


@pytest.mark.parametrize("rows", [100_000, 50])
def test_components_of_chains_and_hubs(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "ROWS", rows)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_query(spark):
    text = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    ids = sorted(text)
    fp = np.array([_fingerprint(text[i]) for i in ids], np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, np.arange(len(ids))
    while True:
        low = np.where(near, label[None, :], len(ids)).min(1)
        if (low == label).all():
            break
        label = low
    want = {i: (f"{int(fp[k]):016x}", ids[label[k]]) for k, i in enumerate(ids)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, DATA).collect()} == want


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.fp == 0} == {3}
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.filter("doc_id < 3").collect()) == [1]
    assert simhash.near_duplicates(empty).count() == 0


# 5


def test_word_tokens_equal_library(texts):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def _check_packed(rows, ids):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids[i]))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0


def test_packing_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    _check_packed(queries.op5_packing(spark, DATA).collect(), ids)


def _best_fit(lengths, size):
    """Longest pieces first to the fullest sequence with room: as tight, but not after cost."""
    pieces = sorted(((n % size, d) for d, n in enumerate(lengths) if n % size), reverse=True)
    total = sum(n for n, _ in pieces)
    room, cost = [size] * (total // size) + [total % size], collections.Counter()
    for n, _ in pieces:
        while n:
            fits = [i for i, r in enumerate(room) if r >= n]
            at = min(fits, key=lambda i: room[i]) if fits else max(range(len(room)), key=lambda i: room[i])
            put = min(n, room[at])
            cost[at] += put + put * put / 4096
            room[at], n = room[at] - put, n - put
    return np.array([c for i, c in cost.items() if i < total // size])


@pytest.mark.parametrize(("longest", "gain"), [(1500, 10), (3000, 1.2)])
def test_assignment_balances_cost(longest, gain):
    random.seed(2)
    lengths = [random.randrange(1, longest) for _ in range(800)]
    rows = packing.assign(lengths, 4096, 1.0, 1 / 4096)
    filled, cost = collections.Counter(), collections.Counter()
    for _, _, n, q, _ in rows:
        filled[q] += n
        cost[q] += n + n * n / 4096
    assert sum(filled.values()) == sum(lengths)
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())
    own, other = np.array([c for q, c in cost.items() if filled[q] == 4096]), _best_fit(lengths, 4096)
    assert len(own) == len(other) and own.std() * gain < other.std() and own.min() > other.min() and own.max() <= other.max()
    assert packing.assign([], 4096, 1.0, 1.0) == []


def test_packing_odd_rows(odd, empty):
    out = packing.pack(odd, WORD_BPE)
    assert out.filter("start = 0").count() == odd.count()
    assert out.filter("doc_id = 3 and doc_tokens = 1").count() == 1
    assert packing.pack(empty, WORD_BPE).count() == 0


# 6


def test_exact_query(same_as_sql):
    same_as_sql(queries.op6_exact_dedup, queries.ORACLES["op6_exact_dedup"])


@pytest.mark.parametrize("bits", [2**27, 64])
def test_exact_odd_rows(odd, empty, bits):
    """A filter of 64 bits calls nearly all rows possible copies; the result is the same."""
    rows = exact_dedup.mark_exact(odd.drop("__sha", "__keep_id", "__group_size", "__kept"), filter_bits=bits).collect()
    assert len(rows) == odd.count()
    of = collections.defaultdict(list)
    for r in rows:
        of[r.text or ""].append(r)
    for group in of.values():
        assert sum(r["__kept"] for r in group) == 1
        assert {r["__group_size"] for r in group} == {len(group)}
        best = max((r.doc_id for r in group if r.doc_id is not None), default=None)
        assert {r["__keep_id"] for r in group} == {best}
        assert next(r for r in group if r["__kept"]).doc_id == best
    kept = exact_dedup.exact_dedup(odd, filter_bits=bits)
    assert kept.columns == odd.columns and kept.count() == len(of) and {r["__hash"] for r in kept.collect()} == {"__hash"}
    assert exact_dedup.exact_dedup(empty).count() == 0


# 7 and 9


def _repeats(rows, kind):
    """By brute force: windows of 35 words found anywhere else, or of 50 bytes found in a document with a smaller id."""
    occ, units, length = collections.defaultdict(list), [], 35 if kind == "word" else 50
    for k, (_, t) in enumerate(rows):
        data = (t or "").encode()
        u = data.split() if kind == "word" else [data[j : j + 1] for j in range(len(data))]
        units.append(u)
        for j in range(len(u) - length + 1):
            occ[tuple(u[j : j + length])].append(k)
    order = lambda i: 1 << 62 if i is None else i
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for j in range(len(u) - length + 1):
            held = occ[tuple(u[j : j + length])]
            if min(order(rows[x][0]) for x in held) < order(i) if kind == "byte" else len(held) > 1:
                gone[j : j + length] = [True] * length
        out.append((i, len(u), sum(gone), (b" " if kind == "word" else b"").join(x for x, g in zip(u, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    random.seed(5)
    base = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()][:120]
    rows = [*base, (1010, "b " * 36), (1011, "q r " * 18 + "s"), (1000, "a " * 300), (1001, "ab" * 200), (1002, None), (1003, ""), (1004, "x y " * 100), (None, base[3][1]), (7, base[5][1][:300] + "zz" + base[6][1][100:]), (1005, "a" * 49), (1006, "a" * 50), (1007, "a" * 51), (1008, base[9][1]), (1008, base[9][1])]
    for _ in range(40):
        a, b = random.choice(base)[1], random.choice(base)[1]
        p, q = random.randrange(max(1, len(a) - 200)), random.randrange(max(1, len(b) - 200))
        rows.append((2000 + random.randrange(500), a[p : p + random.randrange(400)] + " " + b[q : q + random.randrange(400)]))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["word", "byte"])
@pytest.mark.parametrize(("step", "chunk"), [(1 << 18, 1 << 22), (100, 3000)])
def test_repeats(spark, passages, kind, step, chunk):
    frame = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    if kind == "word":
        got = debruijn.mark_repeats(frame, debruijn.Graph(step=step, chunk_bytes=chunk)).collect()
    else:
        got = suffixes.mark_repeats(frame, suffixes.Rule(step=step, chunk_bytes=chunk, bucket_bytes=50_000)).collect()
    assert sorted(((r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in got), key=repr) == _repeats(passages, kind)
    for r in got:
        assert sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == r.n_removed
        assert all(e < s for e, s in zip(r.ends, r.starts[1:], strict=False))


def test_drop_passages_keeps_characters(spark):
    shared = "é" * 40
    rows = [(1, "aaa" + shared + "bbb", "en", "s", 1), (2, "cc" + shared + "dd", "en", "s", 1), (3, None, "en", "s", 1)]
    out = {r.doc_id: r.text for r in suffixes.drop_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: rows[0][1], 2: "ccdd", 3: None}


def test_repeats_odd_rows(odd, empty):
    assert debruijn.mark_repeats(odd).count() == odd.count() and debruijn.mark_repeats(empty).count() == 0
    out = suffixes.drop_passages(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert suffixes.mark_repeats(empty).count() == 0 and suffixes.drop_passages(empty).count() == 0


def test_word_repeats_query(same_as_sql):
    same_as_sql(queries.op7_substring_dedup, queries.ORACLES["op7_substring_dedup"])


def test_byte_repeats_query(same_as_sql):
    same_as_sql(queries.op9_suffix_array_dedup, queries.ORACLES["op9_suffix_array_dedup"])


# 8


def test_warc_query(spark):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(p["html"] or "", p["page_id"])
    want = set()
    for p in pages:
        data = (p["html"] or "").encode()
        f = first[p["html"] or ""]
        same = f == p["page_id"]
        want.add((p["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else f))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op8_warc(spark, DATA).collect()} == want


def test_warc_query_equals_sql(same_as_sql):
    same_as_sql(queries.op8_warc, queries.ORACLES["op8_warc"])


def test_warc_reads_ordinary_archives(spark, tmp_path):
    """Members without lengths and records that are not compressed, of several types, without a list of archives."""
    page = "<p>é</p>".encode() * 3000
    http = b"HTTP/1.1 200 OK\r\ncontent-length: " + str(len(page)).encode() + b"\r\n\r\n" + page

    def plain(kind, name, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", *more, f"content-length:{len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    records = [plain("warcinfo", "i", b"software: x\r\n"), plain("request", "q", b"GET / HTTP/1.1\r\n\r\n"), plain("response", "r", http, f"WARC-Payload-Digest: sha1:{warc.digest(page)}"), plain("response", "s", http), plain("metadata", "m", b"")]
    (tmp_path / "in" / "more").mkdir(parents=True)
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "in" / "more" / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "in" / "readme.txt").write_text("no archive")
    for path, n in ((tmp_path / "in", 2), (tmp_path / "in" / "a.warc.gz", 1), (tmp_path / "in" / "more", 1)):
        rows = warc.read_archives(spark, f"file://{path}").collect()
        assert sorted(r.record_id for r in rows) == sorted(["<urn:i>", "<urn:q>", "<urn:r>", "<urn:s>", "<urn:m>"] * n)
        assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {page}
        assert warc.read_archives(spark, f"file://{path}").filter("record_type = 'response'").count() == 2 * n
    bad = plain("response", "x", http, f"WARC-Payload-Digest: sha1:{'A' * 32}")
    (tmp_path / "bad.warc").write_bytes(bad)
    with pytest.raises(Exception, match="does not match"):
        warc.read_archives(spark, f"file://{tmp_path}/bad.warc").collect()
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(records[2])[:-40])
    with pytest.raises(Exception, match="breaks off|does not match"):
        warc.read_archives(spark, f"file://{tmp_path}/cut.warc.gz").collect()


def test_warc_odd_rows(spark, tmp_path):
    """Repeated rows, null ids, nulls and columns named like the operator's own."""
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, None, "same"), (3, None, None), (4, "v", ""), (None, "w", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(n) for n in ("id", "key", "payload", "first", "n", "__maybe", "record_id", "target_uri")})
    warc.write_archives(warc.records(pages), f"file://{tmp_path}/o")
    found = sorted((r.record_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/o").collect())
    name = lambda i: f"<urn:page:{i}>"
    assert found == sorted([(name(1), "response", None)] * 2 + [(name(2), "revisit", name(1)), (name(""), "revisit", name(1)), (name(3), "response", None), (name(4), "revisit", name(3)), (name(""), "response", None)], key=lambda r: (r[0], r[1], r[2]))


def test_warc_archives(spark, tmp_path):
    rows = [(1, "http://x/\r\nEvil: 1", "a" * 70_000 + "é"), (2, None, None), (3, "http://y", "a" * 70_000 + "é"), (4, "http://z", "q"), (None, "http://n", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.records(pages), path)
    found = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(found) == 5
    assert bytes(found["<urn:page:1>"].payload) == rows[0][2].encode() and found["<urn:page:1>"].target_uri == "http://x/%0D%0AEvil: 1"
    assert found["<urn:page:3>"].record_type == "revisit" and found["<urn:page:3>"].payload is None and found["<urn:page:3>"].payload_bytes == 70_002
    assert found["<urn:page:3>"].refers_to == "<urn:page:1>" and bytes(found["<urn:page:2>"].payload) == b""
    # the archives are gzip members that any reader can take apart
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert plain.count(b"WARC/1.1\r\n") == 5
    assert not any(r.payload for r in warc.read_archives(spark, path, payload=False).collect())


def test_warc_predicates_reach_the_reader(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = warc.WarcReader("p", True)
    kept = [GreaterThan(("payload_bytes",), 3)]
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), ("a", "b")), IsNotNull(("refers_to",)), *kept])) == kept
    assert reader.wanted == {"record_type": {"revisit"}, "record_id": {"a", "b"}} and reader.present == {"refers_to"}
    pages = spark.createDataFrame([(i, f"http://{i}", "same" if i % 2 else f"page {i}") for i in range(50)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/v"
    warc.write_archives(warc.records(pages), path)
    rows = warc.read_archives(spark, path).filter("record_type = 'revisit' and target_uri = 'http://7'").collect()
    assert [r.record_id for r in rows] == ["<urn:page:7>"]
    fs, root = warc.filesystem(path)
    reader = warc.WarcReader(path, True)
    list(reader.pushFilters([EqualTo(("record_type",), "response")]))
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 26


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.records(pages), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r.record_id: r.record_type for r in warc.records(pages, least_bytes=3).collect()}
    assert list(kinds[f"<urn:page:{i}>"] for i in (1, 2, 3, 4)) == ["response", "response", "response", "revisit"]


# 10


def test_ordinal_fit_orders_grades():
    random.seed(6)
    rows, grades = [], []
    for _ in range(900):
        strength = random.choice([0, 0, 1, 2])
        rows.append(sorted(set(random.sample(range(5, 40), 6)) | set(random.sample(range(5), 2 * strength))))
        grades.append(strength)
    w, t = toxicity.fit_ordinal(rows, np.array(grades), 40, 3)
    assert t[0] < t[1] and w[:5].min() > 4 * np.abs(w[5:]).max()
    guess = [int(sum(w[f] for f in r) > t[0]) + int(sum(w[f] for f in r) > t[1]) for r in rows]
    assert np.mean(np.array(guess) == grades) > 0.95


def test_ordinal_fit_equals_a_plain_optimiser():
    """The penalised likelihood, written out from its definition, has its maximum where the fit ends."""
    random.seed(9)
    rows = [sorted(random.sample(range(6), random.randrange(4))) for _ in range(200)]
    grades = np.array([min(2, max(0, round(sum(f < 2 for f in r) + random.gauss(0, 0.6)))) for r in rows])
    w, t = toxicity.fit_ordinal(rows, grades, 6, 3, l2=0.1, steps=4000, rate=0.05)

    def loss(p):
        total = 0.05 * sum(x * x for x in p[:6])
        cuts = [-np.inf, p[6], p[7], np.inf]
        for r, g in zip(rows, grades, strict=True):
            s = sum(p[f] for f in r)
            total -= np.log(1 / (1 + np.exp(-(s - cuts[g]))) - 1 / (1 + np.exp(-(s - cuts[g + 1]))))
        return total

    best = np.concatenate([w, t])
    low = loss(best)
    step = 0.5
    p = np.concatenate([np.zeros(6), [0.0, 1.0]])
    value = loss(p)
    while step > 1e-5:  # coordinate search from elsewhere
        moved = False
        for i in range(8):
            for d in (step, -step):
                q = p.copy()
                q[i] += d
                if q[6] < q[7] and loss(q) < value:
                    p, value, moved = q, loss(q), True
        step = step if moved else step / 2
    assert low == pytest.approx(value, abs=1e-3) and np.abs(best - p).max() < 0.05


def test_scores_by_brute_force(spark):
    """Severity, odds, grade and verdict of the query's operator, from sums over each text's words."""
    import re

    model = toxicity.OrdinalModel({b"die": 1.5, b"the": -0.7, b"und": 0.4, b"abc": 2.0, b"schpf-": 0.9}, [0.3, 2.1])
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for r in toxicity.score_toxicity(docs, model).collect():
        words = {w for w in re.split(rb"[^0-9a-z\x80-\xff]+", (r.text or "").encode().lower()) if w}
        words |= {w[:5] + b"-" for w in words if len(w) > 5}
        s = sum(v for w, v in model.weights.items() if w in words)
        p = [1 / (1 + np.exp(-(s - t))) for t in model.thresholds]
        assert r["__severity"] == pytest.approx(sum(p)) and r["__p_toxic"] == pytest.approx(p[0])
        assert (r["__grade"], r["__rejected"]) == (sum(x >= 0.5 for x in p), p[0] >= 0.5)


def test_toxicity_takes_grades_as_they_are(spark):
    rows = [(i, "bad worse " * (i % 3 == 2) + "bad " * (i % 3 == 1) + f"plain words {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert {r["__grade"] == r.doc_id % 3 for r in toxicity.score_toxicity(docs, model).collect()} == {True}


def test_toxicity_on_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.filter("doc_id % 3 <> 0"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = toxicity.score_toxicity(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), model).select("toxic", "__rejected", "__severity").collect()
    clean, bad = [r for r in rows if r.toxic == 0], [r for r in rows if r.toxic == 1]
    assert np.mean([r["__rejected"] for r in clean]) < 0.01
    assert np.mean([r["__rejected"] for r in bad]) > 0.6
    assert np.mean([r["__severity"] for r in bad]) > 10 * np.mean([r["__severity"] for r in clean])


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    assert model.thresholds == [] and toxicity.drop_toxic(odd, model).count() == odd.count()
    model = toxicity.OrdinalModel({b"fox": 9.0}, [1.0, 10.0])
    out = toxicity.score_toxicity(odd.drop("__severity", "__p_toxic", "__grade", "__rejected"), model)
    assert out.filter("__rejected").count() == 5 and out.filter("__grade > 1").count() == 0
    assert toxicity.drop_toxic(empty, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns and toxicity.drop_toxic(odd, model).count() == odd.count() - 5


# pipeline


def _five(t):
    w = t.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def test_near_copies(spark):
    """Near copies of five-word similarity 0.8 or more go, whatever their fingerprints; others stay."""
    random.seed(7)
    text = {}
    for base in range(0, 400, 10):
        words = [f"w{random.randrange(10**6)}" for _ in range(random.choice([104, 204, 404]))]
        text[base] = " ".join(words)
        for k in range(1, 6):
            changed = list(words)
            for at in random.sample(range(len(words)), random.randrange(1, len(words) // 35 + 2)):
                changed[at] = "other"
            text[base + k] = " ".join(changed)
    text |= {1000: "Two words", 1001: "two  WORDS", 1002: "two other", 1003: "", 1004: " "}
    ids = sorted(text)
    sets, parent = {i: _five(t) for i, t in text.items()}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (_fingerprint(text[i]) ^ _fingerprint(text[j])).bit_count() > 3
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    assert far > 50
    docs = spark.createDataFrame(sorted(text.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near(docs).collect()} == {i for i in ids if find(i) == i}


def test_near_copies_odd_rows(odd, empty):
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns and sum(r.doc_id is None for r in kept.collect()) == sum(r.doc_id is None for r in odd.collect())
    assert simhash.drop_near(empty).count() == 0


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    """Nulls, empties, repeated rows, a long text and columns of any name go through every stage; an empty table stays empty."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, 1), (2, 0), (None, 0), (8, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES:
        found, none = stage(spark, odd, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0, name
        if name == "packing":
            assert found.filter("start = 0").count() == odd.count()
        else:
            assert found.columns == odd.columns and {r["__hash"] for r in found.collect()} == {"__hash"}, name
            texts = {r.text for r in found.collect()}
            assert found.count() == {"toxicity": 10, "exact_dedup": 6, "near_dedup": 5, "passage_dedup": 10}[name], (name, found.count())
            assert None in texts or name == "exact_dedup", name


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    count, now = docs.count(), docs
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, now, DATA)
        assert made.columns == docs.columns, name
        now = made.persist()
        assert now.count() <= count
        count = now.count()
    texts = [r.text for r in now.collect()]
    assert len({t for t in texts if len(t) >= 50}) == len([t for t in texts if len(t) >= 50])
    left = _repeats([(r.doc_id, r.text) for r in now.collect()], "byte")
    assert sum(r[2] for r in left) < sum(r[1] for r in left) // 50
    ids = {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in P.STAGES[-1][1](spark, now, DATA).collect()} == ids
    assert {r.doc_id for r in P.run(spark, DATA).collect()} == ids
