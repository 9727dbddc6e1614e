"""Token budgets and shard rolls over a stream.

State per source: tokens taken, where the open shard began, its number, and
whether the source has ended. A refused row is not part of the total, so the
end of a source has to be remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as tx
from textloom.operators import ordered, shards
from textloom.operators.budget import OVERSHOOT
from textloom.plans.corpus import has_tokens
from textloom.streaming import state
from textloom.workspace import freeze


def take_batch(batch: DataFrame, before: DataFrame, shard_tokens: int, order_by: Sequence[str],
               counter: Callable[[Column], Column] = tx.count_tokens) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: its admitted documents with their shards, and the new
    state. ``before`` has ``source, budget, total, shard_start, shard_base,
    stopped`` with one row per source of the mix."""
    open_sources = F.broadcast(before.where(~F.col("stopped")))
    counts = batch.select("source", *order_by, counter(F.col("text")).alias("n_tok"))
    rows = freeze(counts.join(open_sources, "source").where("n_tok > 0"), "counts")
    run = ordered.running_totals(rows, order_by, {"_local": F.col("n_tok")}, ["source"])
    running = F.col("total") + F.col("_local")
    limit = (F.col("budget") * F.lit(OVERSHOOT)).cast("bigint")
    ok = (running - F.col("n_tok") < F.col("budget")) & (running <= limit)
    judged = freeze(run.withColumn("running", running).withColumn("ok", ok).drop("_local"), "judged")
    admitted = judged.where("ok")

    bounds = freeze(shards.greedy_bounds(admitted, shard_tokens, order_by), "bounds")
    cutoffs = freeze(ordered.key_cutoffs(admitted, order_by, ["source"]), "cutoffs")
    taken = ordered.take_prefix(batch, cutoffs, order_by, ["source"]).where(has_tokens(F.col("text"), counter))
    base = F.broadcast(before.select("source", "shard_base"))
    documents = shards.assign_shards(taken, bounds, order_by).join(base, "source").withColumn(
        "shard_id", F.col("shard_id") + F.col("shard_base")).drop("shard_base")

    seen = judged.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("running"))).alias("_total"),
                                        F.bool_or(~F.col("ok")).alias("_ended"))
    closed = bounds.groupBy("source").agg(F.max("closed_at").alias("_start"), F.count(F.lit(1)).alias("_closed"))
    after = before.join(seen, "source", "left").join(closed, "source", "left").select(
        "source", "budget",
        F.coalesce("_total", "total").alias("total"),
        F.coalesce("_start", "shard_start").alias("shard_start"),
        (F.col("shard_base") + F.coalesce("_closed", F.lit(0))).alias("shard_base"),
        (F.col("stopped") | F.coalesce("_ended", F.lit(False)) | (F.coalesce("_total", "total") >= F.col("budget"))).alias("stopped"))
    return documents, after


def initial_state(budgets: DataFrame) -> DataFrame:
    """Nothing taken yet; ``budgets`` has ``source_key, budget``."""
    zero = F.lit(0).cast("bigint")
    return freeze(budgets.select(
        F.col("source_key").alias("source"), "budget", zero.alias("total"), zero.alias("shard_start"),
        zero.alias("shard_base"), F.lit(False).alias("stopped")), "budget-state")


def budgeted_stream(cleaned: DataFrame, start: DataFrame, out_dir: str, state_dir: str, checkpoint: str,
                    shard_tokens: int, order_by: Sequence[str],
                    counter: Callable[[Column], Column] = tx.count_tokens) -> StreamingQuery:
    """Process everything that has arrived. Documents go to
    ``out_dir/batch_id=n``, the state to ``state_dir/batch_id=n``. Once all budgets
    are met, batches are not read any more and leave no documents."""

    def each(batch: DataFrame, batch_id: int) -> None:
        before = state.load(batch.sparkSession, state_dir, batch_id, start)
        if before.where(~F.col("stopped")).isEmpty():
            state.store(before, state_dir, batch_id)
            return
        documents, after = take_batch(batch, before, shard_tokens, order_by, counter)
        state.store(documents, out_dir, batch_id)
        state.store(after, state_dir, batch_id)

    return state.drain(cleaned.writeStream.foreachBatch(each), checkpoint)


def budgets_met(spark: SparkSession, state_dir: str) -> bool:
    """Whether every source has ended, so that the stream can be given up."""
    return state.latest(spark, state_dir).where(~F.col("stopped")).isEmpty()
