"""Broadcasts whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import written

#: Most rows that are ever broadcast; beyond, the join is left to shuffle (AQE splits hot keys).
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df written to the shared folder once; marked for broadcast only if it has at most max_rows rows."""
    kept = written(df, "side")
    return F.broadcast(kept) if kept.count() <= max_rows else kept
