"""Deterministic identifiers and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the seed of all deterministic orders.
SEED = 20260717


def _joined(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def stable_order(*parts, seed: int = SEED) -> Column:
    """16 hex digits; their order is that of the unsigned 64-bit number they spell."""
    return F.substring(F.sha2(_joined(seed, *parts), 256), 1, 16)


def fingerprint(prompt: Column, completion: Column) -> Column:
    return F.sha2(F.concat(prompt, F.char(F.lit(0)), completion), 256)


def short_id(*parts) -> Column:
    return F.substring(F.sha2(_joined(*parts), 256), 1, 24)
