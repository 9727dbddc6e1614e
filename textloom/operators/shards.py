"""Cut each source into shards of about ``shard_tokens`` tokens.

``uniform_shards`` cuts the token line at multiples and needs one pass.
``greedy_bounds`` closes a shard at the first row that fills it and starts the
next from zero, so every cut depends on the one before. The chain is followed
for all rows at once by pointer doubling: after ``r`` joins each row knows the
row ``2^r`` cuts ahead, so ``K`` shards need ``log2(K)`` joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ordered
from textloom.workspace import freeze

SMALL_TABLE = 1 << 20
MAX_BOUNDS = 1 << 20
_START = "shard_start"


def uniform_shards(run: DataFrame, shard_tokens: int, n: str = "n_tok") -> DataFrame:
    """Shard by position on the token line; ``run`` has the column ``running``."""
    start = F.col("running") - F.col(n)
    return run.withColumn("shard_id", ordered.whole_div(start, shard_tokens))


def _next_cut(points: DataFrame, group: str, shard_tokens: int, rows_per_cell: int) -> DataFrame:
    """For each point of the token line the first row that fills a shard begun
    there: ``(group, at, nxt)``. Rows and targets are merged into one line that
    is cut into cells; a target without a row behind it in its cell takes the
    first row of a later cell."""
    targets = points.select(group, (F.col("at") + shard_tokens).alias("pos"), F.col("at").alias("asker"))
    rows = points.select(group, F.col("at").alias("pos"), F.lit(None).cast("bigint").alias("asker"))
    line = targets.unionByName(rows).withColumn("is_row", F.col("asker").isNull().cast("int"))
    line = ordered.add_cells(line, ["pos"], rows_per_cell)
    here = F.when(F.col("is_row") == 1, F.col("pos"))
    # Backwards, so that the frame grows instead of being recomputed per row.
    ahead = Window.partitionBy(group, ordered.CELL).orderBy(F.desc("pos"), F.desc("is_row")).rowsBetween(
        Window.unboundedPreceding, 0)
    local = line.withColumn("nxt", F.min(here).over(ahead)).where("is_row = 0")
    later = Window.partitionBy(group).orderBy(F.desc(ordered.CELL)).rowsBetween(Window.unboundedPreceding, -1)
    cells = line.groupBy(group, ordered.CELL).agg(F.min(here).alias("first_row")).select(
        F.col(group).alias("_g"), F.col(ordered.CELL).alias("_c"),
        F.min("first_row").over(later).alias("later_row"))
    same = (F.col(group) == F.col("_g")) & (F.col(ordered.CELL) == F.col("_c"))
    return local.join(cells, same).select(
        group, F.col("asker").alias("at"), F.coalesce("nxt", "later_row").alias("nxt"))


def _cuts_by_doubling(run: DataFrame, group: str, shard_tokens: int, rows_per_cell: int) -> DataFrame:
    points = run.select(group, F.col("running").alias("at"))
    start = run.groupBy(group).agg(F.min(_START).alias("at"))
    jump = freeze(_next_cut(points.unionByName(start), group, shard_tokens, rows_per_cell)
                  .where(F.col("nxt").isNotNull()), "jump")
    longest = run.agg(F.max(F.col("running") - F.col(_START))).first()[0] or 0
    reached, span = freeze(start, "cuts"), 1
    while True:
        moved = reached.join(jump, [group, "at"]).select(group, F.col("nxt").alias("at"))
        reached = freeze(reached.unionByName(moved), "cuts")
        span *= 2
        if span > longest // shard_tokens + 1:
            break
        far = jump.select(group, F.col("at").alias("nxt"), F.col("nxt").alias("far"))
        jump = freeze(jump.join(far, [group, "nxt"]).select(group, "at", F.col("far").alias("nxt")), "jump")
    return reached.join(start, [group, "at"], "left_anti")


def _cuts_in_one_pass(run: DataFrame, group: str, shard_tokens: int) -> DataFrame:
    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        line = np.sort(rows["running"].to_numpy())
        cuts, at = [], int(rows[_START].iloc[0])
        while True:
            i = int(np.searchsorted(line, at + shard_tokens))
            if i == len(line):
                break
            at = int(line[i])
            cuts.append(at)
        return pd.DataFrame({group: rows[group].iloc[:1].repeat(len(cuts)).to_numpy(), "at": cuts})

    narrow = run.select(group, "running", _START)
    kind = dict(narrow.dtypes)[group]
    return narrow.groupBy(group).applyInPandas(chain, f"{group} {kind}, at bigint")


def greedy_bounds(run: DataFrame, shard_tokens: int, order_by: Sequence[str], group: str = "source",
                  n: str = "n_tok", small_table: int = SMALL_TABLE,
                  rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Last order key of every full shard and the running total there:
    ``(group, shard_id, last_key, closed_at)``.

    ``run`` is a stored table with the column ``running``. A table whose counted
    size fits one task is chained per source in one pass; larger ones go by
    pointer doubling. Rows without tokens never close a shard. A column
    ``shard_start`` may give, per group, where on the token line its open shard
    began; otherwise that is 0."""
    begin = F.col(_START) if _START in run.columns else F.lit(0)
    keyed = run.where(F.col(n) > 0).withColumn(_START, begin.cast("bigint"))
    if keyed.count() <= small_table:
        cuts = _cuts_in_one_pass(keyed, group, shard_tokens)
    else:
        cuts = _cuts_by_doubling(keyed, group, shard_tokens, rows_per_cell)
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(order_by)])
    ends = keyed.select(group, F.col("running").alias("at"), key.alias("last_key"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("at")).cast("bigint") - 1
    return cuts.join(ends, [group, "at"]).select(
        group, number.alias("shard_id"), "last_key", F.col("at").alias("closed_at"))


def last_keys(sharded: DataFrame, order_by: Sequence[str], group: str = "source") -> DataFrame:
    """The same bounds table from rows that already carry ``shard_id``."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(order_by)])
    return sharded.groupBy(group, "shard_id").agg(F.max(key).alias("last_key"))


def assign_shards(df: DataFrame, bounds: DataFrame, order_by: Sequence[str], group: str = "source",
                  max_bounds: int = MAX_BOUNDS, rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Give each row the shard of the first bound at or after its key; rows
    behind the last bound are in the shard after it.

    Up to ``max_bounds`` bounds (counted) are broadcast in two levels, blocks of
    consecutive bounds and the last key of each block, and searched by bisection: the
    documents are not shuffled, and a row meets arrays of the square root of the number
    of bounds only. Beyond that, the bounds are merged into the order of the rows
    and counted."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(order_by)])
    size = bounds.count()
    if size <= max_bounds:
        per = math.isqrt(size) + 1
        place = F.row_number().over(Window.partitionBy(group).orderBy("last_key")) - 1
        blocks = bounds.withColumn("_block", ordered.whole_div(place, per).cast("int")).groupBy(group, "_block").agg(
            F.sort_array(F.collect_list("last_key")).alias("_keys"),
            F.transform(F.sort_array(F.collect_list(F.struct("last_key", "shard_id"))), lambda e: e["shard_id"]).alias("_ids"))
        tops = blocks.groupBy(group).agg(F.sort_array(F.collect_list(F.element_at("_keys", -1))).alias("_tops"),
                                         F.sum(F.size("_keys")).alias("_size"))
        block = F.coalesce(ordered.bisect_left(F.col("_tops"), key, per), F.lit(0)).cast("int")
        near = df.join(F.broadcast(tops), group, "left").withColumn("_block", block).drop("_tops")
        found = near.join(F.broadcast(blocks), [group, "_block"], "left")
        shard = F.get("_ids", ordered.bisect_left(F.col("_keys"), key, per))
        return found.withColumn("shard_id", F.coalesce(shard, "_size", F.lit(0)).cast("bigint")).drop("_block", "_keys", "_ids", "_size")
    number = F.row_number().over(Window.partitionBy(group).orderBy("last_key")).cast("bigint") - 1
    ends = bounds.select(F.col(group).alias("_g"), F.col("last_key").alias("_k"),
                         F.lit(1).cast("bigint").alias("_end"))
    marked = df.withColumn("_key", key).join(
        ends, (F.col(group) == F.col("_g")) & (F.col("_key") == F.col("_k")), "left"
    ).drop("_g", "_k", "_key").fillna({"_end": 0})
    run = ordered.running_totals(marked, order_by, {"_closed": F.col("_end")}, [group], rows_per_cell)
    place = run.withColumn("_at", F.col("_closed") - F.col("_end")).drop("_closed", "_end")
    names = bounds.select(F.col(group).alias("_g"), number.alias("_n"), F.col("shard_id").alias("_s"))
    return place.join(names, (F.col(group) == F.col("_g")) & (F.col("_at") == F.col("_n")), "left").withColumn(
        "shard_id", F.coalesce("_s", "_at")).drop("_g", "_n", "_s", "_at")


def shard_progress(sharded: DataFrame, order_by: Sequence[str], group: str = "source",
                   n: str = "n_tok", rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Tokens in the current shard up to each row."""
    return ordered.running_totals(sharded, order_by, {"shard_tokens_so_far": F.col(n)},
                                  [group, "shard_id"], rows_per_cell)


def shard_summary(sharded: DataFrame, group: str = "source", n: str = "n_tok") -> DataFrame:
    """Documents, tokens and shards per source, with a total row (NULL source)."""
    per_shard = sharded.groupBy(group, "shard_id").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"))
    return per_shard.rollup(group).agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("shards"))
