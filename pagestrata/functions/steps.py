"""Columns that are computed once, whatever is done with them afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns by a generator of one row.

    A filter on an ordinary computed column is pushed below it, with the whole expression in place of its
    name, and so is the filter that an explode brings along; for long expressions that is the same work
    again for each mention. Nothing is pushed through a generator's own columns.
    """
    made = F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", made)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, inside an expression where no column can be added."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


#: Rows up to which a side of a join is broadcast.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; no more than that are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
