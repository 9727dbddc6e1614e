"""Training log to loss curve."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textloom.operators import series
from textloom.workspace import freeze


def loss_series(lines: DataFrame, every: int = 1, moving_average: int = 0, decay: float | None = None) -> DataFrame:
    """``(run, step, loss, first_pos, point, smoothed)``: parse, keep the last
    value per step, downsample, smooth. ``loss`` stays unsmoothed, for the CSV."""
    points = freeze(series.last_per_step(series.parse_lines(lines)), "points")
    return series.smooth(series.index_points(points, every), moving_average, decay)
