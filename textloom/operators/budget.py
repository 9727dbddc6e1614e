"""Budgets: the ordered prefix of each source that fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import ordered

# Fixed value: how far a capped budget may be exceeded.
OVERSHOOT = 1.01


def admit_capped(counts: DataFrame, budget: Column, order_by: Sequence[str],
                 group_by: Sequence[str] = ("source",), n: str = "n_tok",
                 rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Rows with tokens, taken while the total is below the budget; the first
    row that would pass 101 % of it ends the source. Sums only grow, so both
    rules are plain filters on the running total ``running``."""
    rows = counts.where(F.col(n) > 0)
    run = ordered.running_totals(rows, order_by, {"running": F.col(n)}, group_by, rows_per_cell)
    limit = (budget * F.lit(OVERSHOOT)).cast("bigint")
    return run.where((F.col("running") - F.col(n) < budget) & (F.col("running") <= limit))


def admit_crossing(counts: DataFrame, budget: Column, order_by: Sequence[str],
                   group_by: Sequence[str] = (), n: str = "n_tok",
                   rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Rows up to and including the one that reaches the budget; at least one."""
    run = ordered.running_totals(
        counts, order_by, {"running": F.col(n), "_ord": F.lit(1).cast("bigint")}, group_by, rows_per_cell)
    return run.where((F.col("running") - F.col(n) < budget) | (F.col("_ord") == 1)).drop("_ord")


def progress(counts: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = ("source",),
             n: str = "n_tok", rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Running document and token totals per source."""
    return ordered.running_totals(
        counts, order_by, {"docs_so_far": F.lit(1).cast("bigint"), "tokens_so_far": F.col(n)},
        group_by, rows_per_cell)
