"""Training-log series over lines printed from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import series
from textloom.plans.training_log import loss_series
from textloom.queries.registry import query, table
from textloom.sources import readers, sinks
from textloom.workspace import freeze, new_path

EVERY, WINDOW, DECAY, WIDTH = 3, 7, 0.9, 10


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One run per event type; step and loss printed as a trainer prints them."""
    line = F.format_string("step %7d | loss %.4f | tokens/step ~ 24576", F.col("user_id"), F.col("value"))
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("line_no"), line.alias("line"))


POINTS = """points AS (SELECT event_type AS run, user_id AS step, arg_max(value, event_id) AS loss,
  min(event_id) AS first_pos FROM events GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first_pos) - 1 AS i FROM points)"""
THINNED = f"{POINTS}, thin AS (SELECT *, i // {EVERY} AS j FROM numbered WHERE i % {EVERY} = 0)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return freeze(series.last_per_step(series.parse_lines(log_lines(spark, sf))), "points")


@query("A1", "SELECT event_type AS run, event_id AS line_no, user_id AS step, value AS loss FROM events")
def parsed_log(spark, sf):
    return series.parse_lines(log_lines(spark, sf))


@query("S9 A1", "SELECT event_type AS run, user_id AS step, value AS loss, count(*) AS lines FROM events GROUP BY ALL")
def scanned_log_files(spark, sf):
    path = new_path(spark, "logs")
    log_lines(spark, sf).select("run", "line").write.partitionBy("run").text(path)
    parsed = series.parse_lines(readers.read_log(spark, path))
    run = F.regexp_extract("run", "run=([^/]+)/", 1)
    return parsed.groupBy(run.alias("run"), "step", "loss").agg(F.count(F.lit(1)).alias("lines"))


@query("A2", f"WITH {POINTS} SELECT run, step, loss, first_pos FROM points")
def last_loss_per_step(spark, sf):
    return points(spark, sf)


@query("A5", f"WITH {THINNED} SELECT run, step, loss, j + 1 AS point FROM thin")
def downsampled_series(spark, sf):
    return series.index_points(points(spark, sf), EVERY).select("run", "step", "loss", "point")


@query("A3", f"""WITH {POINTS} SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY i
ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 6) AS smoothed FROM numbered""")
def moving_average(spark, sf):
    rows = series.smooth(series.index_points(points(spark, sf)), moving_average=WINDOW)
    return rows.select("run", "step", F.round("smoothed", 6).alias("smoothed"))


@query("A4", f"""WITH RECURSIVE {POINTS}, fold(run, i, step, smoothed) AS (
  SELECT run, i, step, loss FROM numbered WHERE i = 0
  UNION ALL SELECT n.run, n.i, n.step, {DECAY}::DOUBLE * f.smoothed + (1 - {DECAY}::DOUBLE) * n.loss
  FROM fold f JOIN numbered n ON n.run = f.run AND n.i = f.i + 1)
SELECT run, step, round(smoothed, 6) AS smoothed FROM fold""")
def exponential_average(spark, sf):
    rows = series.smooth(series.index_points(points(spark, sf)), decay=DECAY)
    return rows.select("run", "step", F.round("smoothed", 6).alias("smoothed"))


@query("A6", f"""WITH {THINNED} SELECT run, step, loss, round(avg(loss) OVER (PARTITION BY run ORDER BY j
ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 6) AS smoothed FROM thin""")
def loss_curve(spark, sf):
    rows = loss_series(log_lines(spark, sf), EVERY, WINDOW, DECAY)
    return rows.select("run", "step", "loss", F.round("smoothed", 6).alias("smoothed"))


@query("A7", f"WITH {POINTS} SELECT run, step, loss FROM points WHERE step BETWEEN 20 AND 120 AND loss BETWEEN 5 AND 60")
def clipped_series(spark, sf):
    return series.clip(points(spark, sf), (20, 120), (5.0, 60.0), "loss").select("run", "step", "loss")


@query("A8", f"""WITH {POINTS} SELECT run, (step + {WIDTH - 1}) // {WIDTH} * {WIDTH} AS step, round(avg(loss), 6) AS mean_loss
FROM points GROUP BY 1, 2 HAVING count(*) = {WIDTH}""")
def window_mean_loss(spark, sf):
    return series.window_means(points(spark, sf), WIDTH).withColumn("mean_loss", F.round("mean_loss", 6))


@query("A9", f"WITH {POINTS} SELECT run, step, loss FROM points WHERE step % {WIDTH} = 0")
def sampled_steps(spark, sf):
    return series.sample_steps(points(spark, sf), WIDTH).select("run", "step", "loss")


@query("K4 A6", f"WITH {THINNED} SELECT step, loss FROM thin")
def series_csv_written(spark, sf):
    path = new_path(spark, "csv")
    rows = loss_series(log_lines(spark, sf), EVERY, WINDOW)
    sinks.write_series(rows.select("run", "point", "step", "loss"), path, ["run", "point"])
    back = spark.read.option("header", True).schema("run string, point bigint, step bigint, loss double").csv(path)
    return back.select("step", "loss")
