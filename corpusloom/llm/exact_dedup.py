"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every text to a few slots of a bitmap, counts slots with map-side combining and keeps a bitmap of the slots hit
twice or more. Pass 2 probes that bitmap: a text one of whose slots was hit once is unique and passes straight through; only
the others shuffle, and are compared by SHA-256 of the whole text.

The bitmap is broadcast. It has some 16 bits a row, and 128 MB at most; past some 10**8 texts more and more unique rows
are compared as well, so the saving fades (at 10**9 a third of the unique ones shuffle) while the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm import bloom
from corpusloom.llm.common import fresh, skew_join, text_or_empty


def mark_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None, hashes: int = 2, ending: str = "") -> DataFrame:
    """Every row of ``df`` with __sha (lowercase hex), __keep_id, __group_size and __kept (names that take ``ending``).

    A null text counts as empty; texts are equal when their bytes are. Of equal texts the
    row with the largest id is kept; null ids lose against any other, and of rows that
    repeat the id as well one is kept. An empty table gives an empty one. Columns may have any other name than these four.
    """
    sha, keep_id, size, kept = (f"__{n}{ending}" for n in ("sha", "keep_id", "group_size", "kept"))
    possible, first = fresh(df, f"possible{ending}", f"first{ending}")
    text = text_or_empty(text_col)
    bits = filter_bits or bloom.bits_for(df.count())
    maps = bloom.bitmaps(df.select(F.xxhash64(text).alias("h")), "h", hashes, bits, hits=2)
    base = bloom.probed(df, F.xxhash64(text), maps, hashes, bits, possible).withColumn(sha, F.sha2(text, 256))

    columns = [*[f"`{c}`" for c in df.columns], sha, keep_id, size, kept]
    own = F.col(f"`{id_col}`")
    alone = base.filter(~F.col(possible)).withColumns({keep_id: own, size: F.lit(1).cast("long"), kept: F.lit(True)})
    seen = base.filter(possible)
    groups = seen.groupBy(sha).agg(F.max(own).alias(keep_id), F.count(F.lit(1)).alias(size))
    place = F.row_number().over(W.partitionBy(sha, own).orderBy(F.lit(1)))
    found = skew_join(seen.withColumn(first, place), groups, [sha])
    found = found.withColumn(kept, own.eqNullSafe(F.col(keep_id)) & (F.col(first) == 1))
    return alone.select(*columns).unionByName(found.select(*columns))


def exact_dedup(df: DataFrame, **options) -> DataFrame:
    """The kept rows of ``df``, in its own columns, whatever their names; see ``mark_exact``."""
    (kept,) = fresh(df, "kept")
    ending = kept.removeprefix("__kept")
    while any(f"__{n}{ending}" in [c.lower() for c in df.columns] for n in ("sha", "keep_id", "group_size")):
        ending += "_x"
    return mark_exact(df, ending=ending, **options).filter(f"__kept{ending}").select(*[f"`{c}`" for c in df.columns])
