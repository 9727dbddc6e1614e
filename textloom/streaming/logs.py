"""Metrics of running jobs: last loss per step over arriving log lines.

A micro-batch leaves the points that it changed. Every ``COMPACT_EVERY``-th one also leaves all points so far, and what is older
than the compaction before that is removed; so reading costs the points and a bounded number of batches, however many there
were. A table counts once Spark has committed it, and a batch that runs again replaces its own tables only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import series
from textloom.streaming import state

COMPACT_EVERY = 10
_CHANGES, _WHOLE = "changes", "whole"


def _points(spark: SparkSession, out_dir: str, upto: int | None = None) -> DataFrame | None:
    """The newest version of each point after batch ``upto``, or after the last one; None before the first."""
    batches = [b for b in state.batches(spark, f"{out_dir}/{_CHANGES}") if upto is None or b <= upto]
    if not batches:
        return None
    # A compaction that is made again does not read itself.
    wholes = [b for b in state.batches(spark, f"{out_dir}/{_WHOLE}") if b <= batches[-1] and b != upto]
    base = wholes[-1] if wholes else -1
    parts = [state.read(spark, f"{out_dir}/{_WHOLE}", base).withColumn("_batch", F.lit(base))] if wholes else []
    parts += [state.read(spark, f"{out_dir}/{_CHANGES}", b).withColumn("_batch", F.lit(b)) for b in batches if b > base]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if len(parts) == 1:
        return rows.drop("_batch")
    newest = F.max_by(F.struct("loss", "first_pos"), "_batch").alias("p")
    return rows.groupBy("run", "step").agg(newest).select("run", "step", "p.loss", "p.first_pos")


def keep_changes(changed: DataFrame, batch_id: int, out_dir: str, every: int = COMPACT_EVERY) -> None:
    """Store one micro-batch's points, and all of them when its turn has come."""
    spark = changed.sparkSession
    state.store(changed, f"{out_dir}/{_CHANGES}", batch_id)
    if (batch_id + 1) % every:
        return
    state.store(_points(spark, out_dir, batch_id), f"{out_dir}/{_WHOLE}", batch_id)
    # The compaction before this one stays: this batch may run again.
    old = [b for b in state.batches(spark, f"{out_dir}/{_WHOLE}") if b < batch_id]
    for kind, last in ((_WHOLE, old[-1] if old else -1), (_CHANGES, old[-1] + 1 if old else -1)):
        state.remove_before(spark, f"{out_dir}/{kind}", last)


def metric_stream(lines: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Keep the last loss of every step in the state store and the points
    that changed in a micro-batch below ``out_dir``."""
    points = series.last_per_step(series.parse_lines(lines))
    return state.drain(points.writeStream.outputMode("update").foreachBatch(
        lambda changed, batch_id: keep_changes(changed, batch_id, out_dir)), checkpoint)


def current_points(spark: SparkSession, out_dir: str) -> DataFrame:
    """The series so far: the newest version of each point, read from the last compaction and the batches after it."""
    rows = _points(spark, out_dir)
    if rows is None:
        raise FileNotFoundError(f"no batch has ended in {out_dir}")
    return rows
