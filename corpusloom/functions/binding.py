"""Naming a value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once for many uses in ``body``; as a column it might be made anew for each."""
    return F.element_at(F.transform(F.array(value), body), 1)
