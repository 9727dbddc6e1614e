"""Training-log lines to metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import ordered

# Fixed value: a step number followed later on the line by a loss value.
STEP_AND_LOSS = r"(?iUd)\bstep\b\s*(\d+).*?\bloss\b\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(run, line_no, step, loss)`` from the first match on each line; lines
    without one, or with a step beyond 64 bits, are left out. Only a line feed
    ends a line (flag ``d``)."""
    return (
        lines.withColumn("step", F.regexp_extract("line", STEP_AND_LOSS, 1).try_cast("bigint"))
        .where(F.col("step").isNotNull())
        .select("run", "line_no", "step", F.regexp_extract("line", STEP_AND_LOSS, 2).try_cast("double").alias("loss"))
    )


def last_per_step(points: DataFrame) -> DataFrame:
    """The last loss logged for each step, with the place where the step was
    first seen: that place orders the series."""
    return points.groupBy("run", "step").agg(
        F.max_by("loss", "line_no").alias("loss"), F.min("line_no").alias("first_pos"))


def index_points(points: DataFrame, every: int = 1, rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Number the points of each run in order of first appearance and keep the
    first of every ``every``; ``point`` counts the kept ones from 1."""
    numbered = ordered.ordinals(points, ["first_pos"], ["run"], "point", rows_per_cell)
    if every <= 1:
        return numbered
    before = F.col("point") - 1
    return numbered.where(F.pmod(before, F.lit(every)) == 0).withColumn(
        "point", ordered.whole_div(before, every) + 1)


def smooth(points: DataFrame, moving_average: int = 0, decay: float | None = None,
           rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Add ``smoothed``: trailing mean, else exponential mean, else the raw loss.
    The trailing mean wins when both are asked for; a decay outside (0, 1) is
    ignored."""
    if moving_average > 1:
        return ordered.trailing_average(points, moving_average, "loss", "point", ["run"], "smoothed", rows_per_cell)
    if not moving_average and decay is not None and 0.0 < decay < 1.0:
        return ordered.exponential_average(points, decay, "loss", ["point"], "run", "smoothed", rows_per_cell)
    return points.withColumn("smoothed", F.col("loss"))


def clip(points: DataFrame, steps: tuple[int, int] | None = None,
         values: tuple[float, float] | None = None, value: str = "smoothed") -> DataFrame:
    """Points inside the given ranges."""
    if steps:
        points = points.where(F.col("step").between(*steps))
    if values:
        points = points.where(F.col(value).between(*values))
    return points


def window_means(points: DataFrame, width: int) -> DataFrame:
    """Mean loss of each full window of ``width`` steps, labelled by its last
    step."""
    window: Column = ordered.whole_div(F.col("step") + (width - 1), width)
    return (
        points.groupBy("run", (window * width).alias("step"))
        .agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == width).drop("_n")
    )


def sample_steps(points: DataFrame, width: int) -> DataFrame:
    """Points at multiples of ``width`` steps."""
    return points.where(F.pmod("step", F.lit(width)) == 0)
