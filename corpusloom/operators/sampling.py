"""Deterministic samples and repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REPEAT_COLUMNS = ("training_repeat", "training_repeats", "repeat", "repeats")


def even_places(count: Column, limit: int, single: str = "middle") -> Column:
    """Places (from 0) of ``limit`` evenly spaced of ``count`` items; halves go to the even place."""
    if limit == 1:
        return F.array(F.floor(count / 2).cast("int") if single == "middle" else F.lit(0))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda q: F.rint(q * (count - 1) / F.lit(float(limit - 1))).cast("int"))
    return F.array_distinct(spaced)


def evenly_capped(items: Column, limit: Column | int, places: Column) -> Column:
    """The items of an array, or those at ``places`` if there are more than ``limit``."""
    return F.when(F.size(items) <= limit, items).otherwise(F.filter(items, lambda x, i: F.array_contains(places, i)))


#: Sampled keys that cut a table into ranges, and ranges.
CUTS, RANGES = 4096, 64


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``rows`` with __at (place from 0 in ``order``, in the table or in each stratum) and __n (rows of it).

    The order's columns are to tell rows apart. Keys of CUTS rows, those of the least hash, cut the table into ranges; places are
    counted within a range and added to the rows of the ranges before, so no task orders a large table. The strata are few.
    """
    keys = by or []
    key = F.struct(*order)
    cuts = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(CUTS).collect()
    stratum = W.partitionBy(*[F.col(c) for c in keys] or [F.lit(1)])
    if len(cuts) < CUTS:  # no more rows than that, so they are one range
        return rows.withColumns({"__at": F.row_number().over(stratum.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(stratum).cast("int")})
    cuts = sorted(cuts, key=lambda r: [(x is not None, x) for x in r])
    kinds = [rows.schema[c].dataType for c in order]
    bounds = [F.struct(*[F.lit(x).cast(t).alias(c) for x, t, c in zip(r, kinds, order, strict=True)]) for r in cuts[:: -(-len(cuts) // RANGES)][1:]]
    held = F.size(F.filter(F.array(*bounds), lambda c: c <= key))
    ranged = rows.withColumn("__range", held)
    counts = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    counts = counts.select(*[F.col(c).alias(f"__by_{c}") for c in keys], F.col("__range").alias("__of"), (F.sum("__rows").over(stratum.orderBy("__range")) - F.col("__rows")).alias("__before"), F.sum("__rows").over(stratum).alias("__n"))
    same = F.col("__range") == F.col("__of")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = ranged.withColumn("__in", F.row_number().over(W.partitionBy(*keys, "__range").orderBy(*order)) - 1).join(F.broadcast(counts), same)  # ranges times strata
    return out.withColumns({"__at": (F.col("__before") + F.col("__in")).cast("int"), "__n": F.col("__n").cast("int")}).drop("__range", "__of", "__in", "__before", *[f"__by_{c}" for c in keys])


def even_sample(rows: DataFrame, order: list[str], limit: int, by: list[str] | None = None, single: str = "middle") -> DataFrame:
    """``limit`` evenly spaced rows of the table, or of each stratum."""
    keep = (F.col("__n") <= limit) | F.array_contains(even_places(F.col("__n"), limit, single), F.col("__at"))
    return numbered(rows, order, by).filter(keep).drop("__at", "__n")


def for_mode(rows: DataFrame, mode: str, order: list[str], limit: int, single: str = "first") -> DataFrame:
    """All rows, or in a smoke run ``limit`` evenly spaced ones."""
    if mode not in ("full", "smoke"):
        raise ValueError(f"no such mode: {mode}")
    return even_sample(rows, order, limit, single=single) if mode == "smoke" else rows


def strided(rows: DataFrame, order: list[str], checks: int) -> DataFrame:
    """About ``checks`` rows at a regular stride."""
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / F.greatest(F.least(F.lit(checks), F.col("__n")), F.lit(1))))
    return numbered(rows, order).filter(F.pmod("__at", step) == 0).drop("__at", "__n")


def evaluation_keys(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``rows`` with benchmark_index (from 0 in ``order``) and evaluation_key, "name:00000"."""
    out = numbered(rows, order).withColumnsRenamed({"__at": "benchmark_index"}).drop("__n")
    return out.withColumns({"benchmark": F.lit(name), "evaluation_key": F.format_string(f"{name.replace('%', '%%')}:%05d", "benchmark_index")})


def shuffled(rows: DataFrame, seed: int, *keys: str, limit: int | None = None) -> DataFrame:
    """A seeded order by hash, and its first rows; no or a negative limit changes nothing."""
    if limit is None or limit < 0:
        return rows
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(limit)


def expanded(rows: DataFrame) -> DataFrame:
    """Each row as often as its repeat column says, once at least; unchanged without such a column."""
    name = next((c for c in REPEAT_COLUMNS if c in rows.columns), None)
    if name is None:
        return rows
    times = F.greatest(F.lit(1), F.coalesce(F.col(name).cast("int"), F.lit(1)))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).drop("__copy")
