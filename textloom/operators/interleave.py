"""Round-robin over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import ordered


def interleave(docs: DataFrame, order_by: str, source_ordinal: str = "ordinal",
               rows_per_cell: int = ordered.ROWS_PER_CELL, source: str = "source") -> DataFrame:
    """Add ``turn``: every source gives one row per turn, sources that have run
    out are passed over. Sorting by ``(turn, ordinal)`` gives the merged order.
    Blank rows must still be present: they use up their turn."""
    return ordered.ordinals(docs, [order_by], [source], "turn", rows_per_cell)
