"""Concatenate documents into one token stream and cut it into equal rows.

The stream position of a document is a running total, so its pieces know their
row without any loop. Token arrays are shuffled once, by cell of consecutive
documents; rows are put together inside the cell, and only the rows that
straddle two cells are shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ordered
from textloom.operators.ordered import CELL

TOKENS_PER_CELL = 1 << 25
_SMALL_CELL = 1 << 18


def _join_slices() -> Column:
    parts = F.array_sort(F.collect_list(F.struct("at", "slice")))
    return F.flatten(F.transform(parts, lambda p: p["slice"]))


def pack_rows(docs: DataFrame, order_by: Sequence[str], seq_len: int, ids: str = "ids", n: str = "n",
              tokens_per_cell: int | None = None) -> DataFrame:
    """``(row_idx, ids)``; every row has ``seq_len`` ids but perhaps the last.
    ``docs`` is a stored table of token arrays (end token included) with their
    sizes in ``n``, so that positions are settled without reading the arrays.

    A cell has less than twice ``tokens_per_cell`` ids whatever the sizes: documents longer than that are cut into
    pieces where they are read, and pieces go to cells by the ids before them."""
    if seq_len < 2:
        raise ValueError("seq_len must be at least 2")
    sized = docs.select(*order_by, F.col(ids).alias("ids"), F.col(n).cast("bigint").alias("n")).where("n > 0")
    total = sized.agg(F.sum("n").alias("tokens"), F.max("n").alias("most"), F.count(F.lit(1)).alias("docs")).first()
    if tokens_per_cell is None:  # smaller cells for small inputs, to use all cores
        cores = docs.sparkSession.sparkContext.defaultParallelism
        share = (total["tokens"] or 0) // (2 * cores)
        tokens_per_cell = min(TOKENS_PER_CELL, max(_SMALL_CELL, share))
    key = list(order_by)
    if (total["most"] or 0) > tokens_per_cell:
        cell = F.lit(tokens_per_cell).cast("bigint")
        begins = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, cell)
        cut = sized.select(*order_by, F.col("ids").alias("_all"), F.col("n").alias("_n"), F.explode(begins).alias("_at"))
        sized = cut.select(*order_by, "_at", F.slice("_all", (F.col("_at") + 1).cast("int"), F.lit(tokens_per_cell)).alias("ids"),
                           F.least(cell, F.col("_n") - F.col("_at")).alias("n"))
        key.append("_at")
    placed = ordered.cells_by_weight(sized, key, "n", tokens_per_cell)
    line = Window.partitionBy(CELL).orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("stop", F.col("_before") + F.sum("n").over(line))
    length = F.lit(seq_len).cast("bigint")
    start = F.col("stop") - F.col("n")
    first, last = ordered.whole_div(start, length), ordered.whole_div(F.col("stop") - 1, length)

    def piece(row: Column) -> Column:
        begin = F.greatest(start, row * length)
        end = F.least(F.col("stop"), (row + 1) * length)
        return F.struct(row.alias("row_idx"), begin.alias("at"), F.slice(
            F.col("ids"), (begin - start + 1).cast("int"), (end - begin).cast("int")).alias("slice"))

    pieces = run.select(CELL, F.inline(F.transform(
        F.sequence(first, last), piece)))
    in_cell = pieces.groupBy(CELL, "row_idx").agg(F.min("at").alias("at"), _join_slices().alias("slice"))
    whole = in_cell.where(F.size("slice") == seq_len).select("row_idx", F.col("slice").alias("ids"))
    straddling = in_cell.where(F.size("slice") < seq_len).groupBy("row_idx").agg(_join_slices().alias("ids"))
    return whole.unionByName(straddling)


def finish_rows(rows: DataFrame, seq_len: int, shard_tokens: int, pad_id: int = 0,
                mask: str = "nonzero", final: bool = True) -> DataFrame:
    """Apply the tail rule, add the attention mask and the shard.

    A tail of at least half a row is padded, a shorter one dropped. The default
    pads with id 0 and masks ``id != 0``, so unknown tokens are masked as well;
    ``mask='length'`` masks by position."""
    real = F.size("ids")
    keep = real >= (seq_len // 2 if final else seq_len)
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(seq_len) - real))
    if mask == "nonzero":
        flags = F.transform("input_ids", lambda x: (x != 0).cast("smallint"))
    elif mask == "length":
        flags = F.transform("input_ids", lambda x, i: (i < F.col("_real")).cast("smallint"))
    else:
        raise ValueError(f"mask: {mask}")
    rows_per_shard = -(-shard_tokens // seq_len)
    return (
        rows.where(keep)
        .select("row_idx", real.alias("_real"), padded.alias("input_ids"))
        .select("row_idx", "input_ids", flags.alias("attention_mask"),
                ordered.whole_div(F.col("row_idx"), rows_per_shard).alias("shard_id"))
    )


def audit(packed: DataFrame, seq_len: int) -> DataFrame:
    """Per shard: rows, rows of a wrong length, positions where the mask does not
    follow the ids, range of ids, real and padded positions."""
    wrong = F.size(F.filter(F.zip_with(
        "input_ids", "attention_mask", lambda i, m: (i != 0) != (m != 0)), lambda bad: bad))
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda acc, m: acc + m)
    return packed.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.size("input_ids") != seq_len) | (F.size("attention_mask") != seq_len)).alias("bad_length"),
        F.sum(wrong).alias("mask_mismatch"),
        F.min(F.array_min("input_ids")).alias("min_id"),
        F.max(F.array_max("input_ids")).alias("max_id"),
        F.sum(real).alias("tokens"),
        F.sum(F.size("attention_mask") - real).alias("pads"),
    )


def efficiency(packed: DataFrame, seq_len: int, eos_id: int) -> DataFrame:
    """Per shard: rows, share of real positions, document ends."""
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda acc, m: acc + m)
    ends = F.size(F.filter("input_ids", lambda i: i == eos_id))
    return packed.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum(real) / (F.count(F.lit(1)) * seq_len)).alias("fill"),
        F.sum(ends).alias("doc_ends"),
    )
