"""Rates and rounding as the published tables have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up on the double, the same in every engine (``round`` is not)."""
    p = 10.0**digits
    return F.floor(x * p + 0.5).cast("double") / p


def pct(hits: Column, total: Column, digits: int = 2) -> Column:
    """100 * hits / total, rounded; null where there is no total."""
    return rounded(F.lit(100.0) * hits / F.nullif(total, F.lit(0)), digits)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))
