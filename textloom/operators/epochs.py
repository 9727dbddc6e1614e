"""Reproducible epoch orders over packed shards: shuffle files, split them over
workers, shuffle rows within a file, stack micro-batches.

Shuffles are orders by a keyed hash. They depend on seed, epoch and key only,
so any worker can recompute its own part. Rows of several roots carry the column
``root``; a file is then a (root, shard_id), and files go in that order unshuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ordered
from textloom.workspace import freeze


def shuffle_key(seed: int, epoch: int, *parts: str) -> Column:
    """Hash that orders the items of one epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed + epoch)), *[F.col(p).cast("string") for p in parts]))


def file_key(packed: DataFrame) -> list[str]:
    """The columns that name a file."""
    return [c for c in ("root", "shard_id") if c in packed.columns]


def file_order(files: DataFrame, seed: int = 42, epoch: int = 0, shuffle: bool = True,
               workers: int = 1) -> DataFrame:
    """Rank of each file in the epoch (from 0), its worker, and its turn with
    that worker. One row per file."""
    file = file_key(files)
    key = shuffle_key(seed, epoch, *file) if shuffle else F.lit("")
    ranked = ordered.ordinals(files.select(*file).distinct().withColumn("_key", key), ["_key", *file], name="_ord")
    rank = F.col("_ord") - 1
    return ranked.select(*file, rank.alias("file_rank"), F.pmod(rank, F.lit(workers)).alias("worker"),
                         ordered.whole_div(rank, workers).alias("turn"))


def row_order(packed: DataFrame, seed: int = 42, epoch: int = 0, shuffle: bool = False) -> DataFrame:
    """Add ``row_rank`` (from 0) within the shard. A shard has a fixed number of
    rows, so the window is bounded."""
    file = file_key(packed)
    keys = [shuffle_key(seed, epoch, *file, "row_idx")] if shuffle else []
    w = Window.partitionBy(*file).orderBy(*keys, "row_idx")
    return packed.withColumn("row_rank", F.row_number().over(w).cast("bigint") - 1)


def batch_slots(packed: DataFrame, batch_size: int, workers: int = 1, seed: int = 42, epoch: int = 0,
                shuffle_files: bool = True, shuffle_rows: bool = False) -> DataFrame:
    """Add worker, batch number and place in the batch to each row. A worker
    reads its files in order; where a file starts follows from the row counts of
    the files before it, a table with one row per shard."""
    file = file_key(packed)
    rows = row_order(packed, seed, epoch, shuffle_rows)
    sizes = freeze(packed.groupBy(*file).agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    files = file_order(sizes, seed, epoch, shuffle_files, workers).join(sizes, file)
    before = Window.partitionBy("worker").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(*file, "worker", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("row_rank")
    return (
        rows.join(starts, file)
        .withColumn("batch_no", ordered.whole_div(place, batch_size))
        .withColumn("slot", F.pmod(place, F.lit(batch_size)).cast("int"))
        .drop("_start")
    )


def batches(slots: DataFrame) -> DataFrame:
    """Stack rows into ``(worker, batch_no, input_ids, attention_mask)`` with
    64-bit matrices; the last batch of a worker may be short."""
    row = F.struct("slot", F.col("input_ids").cast("array<bigint>").alias("ids"),
                   F.col("attention_mask").cast("array<bigint>").alias("mask"))
    stacked = slots.groupBy("worker", "batch_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return stacked.select(
        "worker", "batch_no",
        F.transform("rows", lambda r: r["ids"]).alias("input_ids"),
        F.transform("rows", lambda r: r["mask"]).alias("attention_mask"))


def tokens_per_step(micro_batch: int, seq_len: int, processes: int) -> int:
    """Tokens one optimiser step sees over all processes."""
    return micro_batch * seq_len * processes
