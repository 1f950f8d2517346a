"""Bloom filters as native bitmaps: tables of (bucket, bitmap) of a bounded size that are broadcast and probed in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import compact, fresh

#: Bits of a filter: some 16 a row, between these limits (128 KB and 128 MB).
LEAST_BITS, MOST_BITS, BITS_A_ROW = 1 << 20, 1 << 30, 16


def bits_for(rows: int) -> int:
    """A power of two within the limits. Past the upper one (some 10**8 rows) more rows pass that are not in the set; none is lost."""
    return min(max(LEAST_BITS, 1 << max(rows * BITS_A_ROW - 1, 1).bit_length()), MOST_BITS)


def slots(h: Column, hashes: int, bits: int) -> list[Column]:
    """1-based slots of a 64-bit hash."""
    return [F.pmod(h if i == 0 else F.xxhash64(h, F.lit(i)), F.lit(bits)) + 1 for i in range(hashes)]


def bitmaps(hashed: DataFrame, column: str, hashes: int, bits: int, hits: int = 1) -> DataFrame:
    """(bucket, bitmap) of the slots hit at least ``hits`` times; at most bits / 32768 rows of 4 KB. Slots are counted before they shuffle."""
    hit = hashed.select(F.explode(F.array(*slots(F.col(column), hashes, bits))).alias("slot"))
    some = hit.groupBy("slot").count().filter(F.col("count") >= hits)
    return compact(some.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")), 2000)


def _bit(bitmap: Column, slot: Column) -> Column:
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def probed(df: DataFrame, h: Column, maps: DataFrame, hashes: int, bits: int, name: str) -> DataFrame:
    """``df`` with ``name``: whether the hash may be in the filter's set; if not, it certainly is not."""
    own = fresh(df, "bucket", "bitmap")
    rows, found = df, []
    for i, slot in enumerate(slots(h, hashes, bits)):
        bucket, bitmap = (f"{c}{i}" for c in own)
        rows = rows.join(F.broadcast(maps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))), F.bitmap_bucket_number(slot) == F.col(bucket), "left")
        found.append(_bit(F.col(bitmap), slot))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], reduce(lambda x, y: x & y, found).alias(name))


def without(df: DataFrame, column: str, keys: DataFrame, hashes: int = 2) -> DataFrame:
    """The rows of ``df``, in its own columns, whose ``column`` is not among the different values of the only one of ``keys``; nulls stay.

    Rows that the filter calls absent pass straight through; only the others shuffle and are compared.
    """
    (key,) = keys.columns
    kept, maybe = parted(df, column, keys, hashes)
    return kept.unionByName(maybe.join(keys, maybe[column] == keys[key], "left_anti"))


def among(df: DataFrame, column: str, keys: DataFrame, hashes: int = 2) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among the different values of the only one of ``keys``; only those that may be shuffle."""
    (key,) = keys.columns
    maybe = parted(df, column, keys, hashes)[1]
    return maybe.join(keys, maybe[column] == keys[key], "left_semi")


def parted(df: DataFrame, column: str, keys: DataFrame, hashes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows that are certainly not among the keys, and those that may be."""
    (key,) = keys.columns
    bits = bits_for(keys.count())
    (flag,) = fresh(df, "maybe")
    maps = bitmaps(keys.select(F.xxhash64(F.col(key)).alias("h")), "h", hashes, bits)
    rows = probed(df, F.xxhash64(F.col(f"`{column}`").cast(keys.schema[key].dataType)), maps, hashes, bits, flag)
    return rows.filter(~F.col(flag)).drop(flag), rows.filter(F.col(flag)).drop(flag)
