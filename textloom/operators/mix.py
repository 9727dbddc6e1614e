"""Weighted mix of sources: text -> weights -> token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip


def mix_entries(spark: SparkSession, mix: str) -> DataFrame:
    """The parts ``key=weight`` of a mix text, in order. Parts without ``=`` or
    with a weight that is no number are skipped."""
    part = strip(F.col("part"))
    halves = F.split(part, "=", 2)
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(mix), ",")).alias("pos", "part"))
        .where(F.contains(part, F.lit("=")))
        .select("pos", strip(F.get(halves, F.lit(0))).alias("source_key"),
                strip(F.get(halves, F.lit(1))).try_cast("double").alias("weight"))
        .where(F.col("weight").isNotNull())
    )


def unknown_keys(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Mix keys the registry does not have, for a warning."""
    return entries.join(registry, "source_key", "left_anti").select("source_key").distinct()


def parse_mix(spark: SparkSession, mix: str, registry: DataFrame) -> DataFrame:
    """Normalised weight per known source. The last entry of a repeated key wins.
    Fails when no known key has weight. A mix has a handful of entries."""
    known = mix_entries(spark, mix).join(F.broadcast(registry.select("source_key")), "source_key", "left_semi")
    entry = F.struct("first_pos", "source_key", "weight")
    whole = (
        known.groupBy("source_key")
        .agg(F.min("pos").alias("first_pos"), F.max_by("weight", "pos").alias("weight"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .withColumn("total", F.aggregate("entries", F.lit(0.0), lambda acc, e: acc + e["weight"]))
    )
    checked = F.when(F.col("total") > 0, F.col("entries")).otherwise(
        F.raise_error(F.lit("mix has no known source with a positive weight")))
    return (
        whole.select("total", F.explode(checked).alias("e"))
        .select("e.source_key", (F.col("e.weight") / F.col("total")).alias("weight"))
    )


def token_budgets(mix: DataFrame, total_tokens: int | float | Column) -> DataFrame:
    """Budget per source: weight times the total, cut to a whole number."""
    total = total_tokens if isinstance(total_tokens, Column) else F.lit(float(total_tokens))
    return mix.withColumn("budget", (F.col("weight") * total).cast("bigint"))


def mix_with_registry(mix: DataFrame, registry: DataFrame) -> DataFrame:
    """Budget rows together with path, field, language and cleaner."""
    return mix.join(F.broadcast(registry), "source_key")


def attach_budgets(counts: DataFrame, budgets: DataFrame, on: str = "source") -> DataFrame:
    """Documents of the sources in the mix, each with its source's budget."""
    small = budgets.select(F.col("source_key").alias(on), "budget")
    return counts.join(F.broadcast(small), on)
