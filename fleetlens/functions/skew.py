"""Joins of a large side with a lookup when one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Rows up to which a written lookup is sent to all tasks.
FEW = 20_000


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` with a side that has few rows per key.

    No side is forced to broadcast: Spark broadcasts the lookup only while its size estimate is below
    ``spark.sql.autoBroadcastJoinThreshold``. Beyond that the session's skew handling (``session.DEFAULTS``) splits
    the partition of a hot key by the measured sizes, which copies the lookup rows of that key alone.
    """
    return facts.join(lookup, list(keys), how)


def row_join(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two sides that both grow with the estate, sorted and merged at any size.

    Size estimates are those of compressed files, and rows derived from them can be a hundred times as large: a side that is sent to
    all tasks by its estimate can fill the driver.
    """
    return rows.join(other.hint("merge"), list(keys), how)


def settled_lookup(lookup: DataFrame, label: str = "lookup", few: int = FEW) -> DataFrame:
    """The rows of a lookup, written once. Whether joins with them, or with what is selected from them, send them to all tasks goes by
    their counted number instead of an estimate: up to ``few`` rows are sent, more are merged."""
    kept = settle(lookup, label)
    return F.broadcast(kept) if kept.limit(few + 1).count() <= few else kept.hint("merge")
