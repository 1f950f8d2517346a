"""Sharding along a Hilbert curve, for pruning by several columns at once.

Language, source and size are quantised to 5 bits each by quantiles in their own order, so a code is a range of values;
the cell's index on the curve orders the documents, and runs of equal length become shards, so each file spans short
ranges of all three and the least and greatest values in its footer let a reader pass it over. Places in the order come from
counts: of the curve's cells (at most 2**15, whatever the input), of buckets that cut large cells, and of rows in a bucket.
Only ids and sizes move, never texts.

Equal texts of one language and source share a cell and a bucket of it, so they lie near each other in the order; the law of
equal counts holds first, so a shard's edge may part them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import cut, skew_join, text_or_empty

BITS = 5
#: Rows of a cell that are ordered together, on average.
BUCKET = 1024


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n x dimensions), each coordinate under 2**bits."""
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    for b in range(bits - 1, 0, -1):  # undo the turns of the cube at each scale
        low = (1 << b) - 1
        for i in range(len(x)):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
    for i in range(1, len(x)):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | ((c ^ turn) >> b) & 1
    return out


def _number(value: Column, skip: int) -> Column:
    """The first bytes of a string past ``skip`` as a long, in their order."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def quantised(df: DataFrame, columns: dict[str, Column]) -> list[Column]:
    """For each column its code of BITS bits: the number of its quantiles (2**BITS - 1 values, the driver's only share) that are not above it.

    Strings are told apart by the seven bytes that follow what all of them begin with.
    """
    kinds = df.select(*[c.alias(n) for n, c in columns.items()]).schema
    texts = [n for n in columns if kinds[n].dataType.typeName() == "string"]
    ends = df.agg(F.lit(0), *[f(columns[n]).alias(f"{n}_{k}") for n in texts for k, f in (("low", F.min), ("high", F.max))]).first()
    numbers = {}
    for n, c in columns.items():
        if n in texts:
            low, high = ((ends[f"{n}_{k}"] or "").encode() for k in ("low", "high"))
            skip = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
            numbers[n] = _number(c, skip)
        else:
            numbers[n] = c.cast("long")
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = df.agg(*[F.percentile_approx(c, shares, 1 << 12).alias(n) for n, c in numbers.items()]).first()

    def code(value: Column, cuts: list[int] | None) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x <= value)).cast("long") if cuts else F.lit(0).cast("long")

    return [code(c, found[n]) for n, c in numbers.items()]


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``df``: doc_id, size (UTF-8 bytes + 16), text_crc32, curve, shard, slot.

    Shards hold runs of the curve whose counts differ by one at most; slots are gapless from 0. A null
    text has no byte, a null language or source counts as empty. Within a cell rows go by ranges of the checksum, ranges that hold many rows
    (copies) by parts of these, then by checksum and id; rows that repeat an id and text are interchangeable. Fewer rows than
    shards leave the last ones empty, an empty table gives an empty one. Other columns are not looked at.
    """
    spark = df.sparkSession
    text = text_or_empty(text_col)
    size = (F.octet_length(text) + 16).cast("long")
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    codes = quantised(df, {"lang": value(lang_col), "source": value(source_col), "size": size})
    cell = F.shiftleft(codes[0], 2 * BITS).bitwiseOR(F.shiftleft(codes[1], BITS)).bitwiseOR(codes[2])
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell.alias("cell"), F.monotonically_increasing_id().alias("row"))
    side = np.indices([1 << BITS] * 3).reshape(3, -1).T
    cells = (side[:, 0] << 2 * BITS) | (side[:, 1] << BITS) | side[:, 2]
    curve = spark.createDataFrame(list(zip(cells.tolist(), hilbert_index(side, BITS).tolist(), strict=True)), "cell long, curve long")
    rows = cut(rows.join(F.broadcast(curve), "cell").drop("cell"))

    count = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n"))  # 2**15 rows at most
    place = W.partitionBy(F.lit(1))
    count = cut(count.select("curve", F.ceil(F.col("n") / bucket).alias("buckets"), F.sum("n").over(place).alias("total"), (F.sum("n").over(place.orderBy("curve")) - F.col("n")).alias("before")))
    rows = rows.join(F.broadcast(count), "curve").withColumn("bucket", F.floor(F.col("text_crc32") * F.col("buckets") / F.lit(1 << 32)))
    # copies fall into one range of checksums; a range is cut into as many parts as its rows ask for
    ranges = rows.groupBy("curve", "bucket").agg(F.ceil(F.count(F.lit(1)) / (4 * bucket)).alias("parts"))
    rows = skew_join(rows, ranges, ["curve", "bucket"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    keys = ["curve", "bucket", "part"]
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    held = held.select(*keys, (F.sum("n").over(W.partitionBy("curve").orderBy("bucket", "part")) - F.col("n")).alias("inside"))
    order = F.row_number().over(W.partitionBy(*keys).orderBy("text_crc32", "doc_id", "row")) - 1
    rows = skew_join(rows.withColumn("rank", order), held, keys)

    at = F.col("before") + F.col("inside") + F.col("rank")
    short = F.floor(F.col("total") / shards)
    longer = F.pmod(F.col("total"), F.lit(shards))
    rows = rows.withColumns({"at": at, "short": short, "longer": longer, "edge": longer * (short + 1)})
    shard = F.expr("if(at < edge, at div (short + 1), longer + (at - edge) div nullif(short, 0))")
    start = F.expr("if(shard < longer, shard * (short + 1), edge + (shard - longer) * short)")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.col("at") - start)
    return rows.select("doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int"), F.col("slot").cast("long"))


def write_shards(df: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Write ``df`` as Parquet, a folder ``shard=N`` per shard in slot order; returns the manifest.

    Per shard: rows, bytes, and the first and last curve index, id, language, source and size. Ids must be unique and not
    null here: rows find their shard by id. A column named shard or slot is replaced.
    """
    placed = cut(assign_shards(df, shards, id_col, text_col, lang_col, source_col)).withColumnRenamed("doc_id", id_col)
    rows = df.drop("shard", "slot").join(placed.select(id_col, "shard", "slot"), id_col)
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("errorifexists").partitionBy("shard").parquet(path)
    known = df.select(F.col(id_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")).join(placed, id_col)
    ranges = [f(c).alias(f"{k}_{n}") for c, n in (("curve", "curve"), (id_col, "id"), ("lang", "lang"), ("source", "source"), ("size", "size")) for k, f in (("first", F.min), ("last", F.max))]
    return known.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)


def shards_to_read(manifest: DataFrame, **wanted: tuple) -> DataFrame:
    """The shards of a manifest whose ranges meet all of ``wanted`` (lang=(low, high), source=..., size=...)."""
    for name, (low, high) in wanted.items():
        manifest = manifest.filter((F.col(f"last_{name}") >= low) & (F.col(f"first_{name}") <= high))
    return manifest
