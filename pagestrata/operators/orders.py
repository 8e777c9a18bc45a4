"""The orders in which reports list things. Operators return rows in no order; whoever shows them sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = {
    "pages": ("totalScore", "url"),
    "overview": ("last_score", "url_norm"),
    "runs": ("created_at", "run_id"),
    "page_changes": ("delta", "path"),
    "finding_changes": ("after - before DESC", "priority DESC", "key"),
    "tickets": ("state != 'open'", "priority DESC", "page_count DESC", "key"),
    "findings": ("n DESC", "priority DESC", "key"),
    "inputs": ("position",),
}


def in_order(rows: DataFrame, what: str) -> DataFrame:
    keys = [(k.removesuffix(" DESC"), k.endswith(" DESC")) for k in ORDERS[what]]
    return rows.orderBy(*(F.expr(k).desc() if down else F.expr(k).asc() for k, down in keys))
