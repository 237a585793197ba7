"""Arithmetic that keeps the NaN and infinity of floating point under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles, with x/0 infinite and 0/0 and NaN/0 NaN instead of an error."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def or_null(x: Column) -> Column:
    """NaN as null, so that sums skip it."""
    return F.nanvl(x, F.lit(None).cast("double"))


def positive(x: Column) -> Column:
    """x > 0 where NaN is not above anything."""
    return ~F.isnan(x) & (x > 0)
