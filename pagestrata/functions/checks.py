"""Maps of criteria to whether they are met, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(before: Column, after: Column) -> Column:
    """Criteria in both maps that are met now and weren't; null without an earlier map."""
    return F.when(before.isNotNull(), F.array_sort(F.filter(F.map_keys(after), lambda k: F.try_element_at(after, k) & ~F.try_element_at(before, k))))


def regressed(before: Column, after: Column) -> Column:
    return F.when(before.isNotNull(), F.array_sort(F.filter(F.map_keys(after), lambda k: ~F.try_element_at(after, k) & F.try_element_at(before, k))))
