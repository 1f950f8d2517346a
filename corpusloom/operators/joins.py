"""Joins and keyed choices that stand a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``table`` (one row per key) to ``rows``.

    A shadow key gives both sides an exchange of their own even where the table is an
    aggregate by the key, so a hot key of ``rows`` can be split at run time.
    """
    shadow = F.xxhash64(*[F.col(k) for k in keys])
    return rows.withColumn("__shadow", shadow).join(table.withColumn("__shadow", shadow), [*keys, "__shadow"], how).drop("__shadow")


def first_per_key(rows: DataFrame, key: str, order: Column, name: str) -> DataFrame:
    """``rows`` with column ``name``: the least ``order`` of their key, aggregated before the shuffle."""
    return lookup(rows, rows.groupBy(key).agg(F.min(order).alias(name)), [key])
