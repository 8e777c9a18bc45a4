"""Rounding and clamping as the scores need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """To a whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def round1(x: Column) -> Column:
    """To one decimal, halves towards plus infinity."""
    return F.floor(x * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def size(x: Column) -> Column:
    """Size of an array, 0 for null."""
    return F.coalesce(F.size(x), F.lit(0))


def part(condition: Column, share: float) -> Column:
    """share if the condition holds, else 0; an unknown condition doesn't hold."""
    return F.when(condition, F.lit(float(share))).otherwise(F.lit(0.0))
