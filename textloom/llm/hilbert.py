"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits by borders of equal depth, the cell of
a row is its place in the grid of all dimensions, and rows are ordered by the
cell's index on the Hilbert curve. Runs of equal length along that order are the
shards: rows of one shard lie close together in *every* dimension, so minimum and
maximum per file let a reader skip files whichever dimension it filters on.

A global order of all rows is never sorted. The curve index is computed for
the grid's cells (at most 2^(dims * bits), whatever the data), cell counts
give each cell its place, and rows are numbered within (cell, bucket), where a
hash of the key spreads a hot cell over ``BUCKETS`` buckets. Native expressions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ordered import bisect_right
from textloom.workspace import freeze

BITS = 5
BUCKETS = 64


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve through a grid of ``2^bits`` per axis: undo the
    excess rotations from the top bit down, Gray-encode, and interleave."""
    n = len(axes)
    place = F.array(*[a.cast("int") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        head, own, low = F.get(x, F.lit(0)), F.get(x, step["i"]), step["q"] - 1
        swap = head.bitwiseXOR(own).bitwiseAND(low)
        invert = own.bitwiseAND(step["q"]) != 0
        return F.transform(x, lambda v, j: F.when(
            invert, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v),
        ).otherwise(F.when((j == 0) | (j == step["i"]), F.when(step["i"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)))

    turned = F.aggregate(steps, place, turn)
    # Gray code: each axis takes on the exclusive or of all axes up to itself.
    gray = F.aggregate(turned, F.array().cast("array<int>"), lambda out, v: F.concat(
        out, F.array(F.coalesce(F.element_at(F.when(F.size(out) > 0, out), -1), F.lit(0)).bitwiseXOR(v))))
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    flip = lambda g: F.aggregate(masks, F.lit(0), lambda t, q: F.when(
        F.element_at(g, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    final = F.aggregate(F.array(gray), F.array().cast("array<int>"),
                        lambda _, g: F.transform(g, lambda v: v.bitwiseXOR(flip(g))))
    picks = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i"))
                      for b in range(bits - 1, -1, -1) for i in range(n)])
    # One fold over an array of one element binds the axes to a name.
    return F.aggregate(F.array(final), F.lit(0).cast("bigint"), lambda _, x: F.aggregate(
        picks, F.lit(0).cast("bigint"),
        lambda acc, p: acc * 2 + F.call_function("getbit", F.get(x, p["i"]), p["b"]).cast("bigint")))


def as_number(value: Column, data_type: str) -> Column:
    """A sortable number of any simple column: text by its first six bytes."""
    if data_type in ("string", "binary"):
        head = F.rpad(F.substring(F.hex(value), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("bigint")
    return value.cast("double")


def curve_shards(df: DataFrame, key: str, dims: Mapping[str, Column], shards: int, bits: int = BITS) -> DataFrame:
    """Add ``shard`` (0 to ``shards - 1``), ``slot`` (gapless from 0 in each shard)
    and ``curve`` (the cell's index) to every row; the sizes of any two shards
    differ by one row at most. ``dims`` names the dimensions, each a number
    (see ``as_number``).

    Defined results: NULL in a dimension is the lowest coordinate; rows of one cell are
    ordered by a hash of the key, the key and the other columns, so equal rows are told
    apart by their places alone; an empty table gives no rows; NULL keys are rows like
    any other. Columns named like the three new ones are replaced."""
    if bits * len(dims) > 30:
        raise ValueError("the grid has more than 2^30 cells")
    df = df.drop("shard", "slot", "curve")
    names = list(dims)
    side = 1 << bits
    borders = df.agg(*[F.percentile_approx(expr, [i / side for i in range(1, side)], 10_000).alias(name)
                       for name, expr in dims.items()]).first()
    axes = {}
    for i, name in enumerate(names):
        cuts = sorted(set(borders[name] or ()))
        at = bisect_right(F.array(*[F.lit(c) for c in cuts]), dims[name], len(cuts)) if cuts else F.lit(0)
        axes[f"_a{i}"] = F.coalesce(F.when(dims[name].isNull(), 0).otherwise(at), F.lit(0)).cast("int")
    cell = F.lit(0).cast("bigint")
    for i in range(len(names)):
        cell = cell * side + F.col(f"_a{i}")
    rows = freeze(df.withColumns(axes).withColumn("_cell", cell).drop(*axes).withColumn(
        "_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), "curve")

    counts = rows.groupBy("_cell", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_cell").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = freeze(counts.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))), "cells")
    # At most one row for each cell of the grid.
    coords = [F.shiftright("_cell", bits * (len(names) - 1 - i)).bitwiseAND(F.lit(side - 1)) for i in range(len(names))]
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        buckets.groupBy("_cell").agg(F.sum("_n").alias("_n"))
        .withColumn("curve", hilbert_index(coords, bits))
        .withColumn("_start", F.coalesce(F.sum("_n").over(along), F.lit(0)))
        .select(F.col("_cell").alias("_c"), "curve", "_start")
    )
    starts = buckets.join(cells, F.col("_cell") == F.col("_c")).select(
        F.col("_cell").alias("_c"), F.col("_bucket").alias("_b"), "curve", (F.col("_start") + F.col("_before")).alias("_at"))
    total = buckets.agg(F.sum("_n")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("_cell", "_bucket").orderBy(key, *[c for c in df.columns if c != key]))
    place = F.col("_at") + rank - 1
    shard = F.call_function("div", F.col("_place") * shards, F.lit(max(total, 1)))
    # The first place of shard s is the least p with p * shards >= s * total.
    first = F.call_function("div", F.col("shard") * total + (shards - 1), F.lit(shards))
    return (
        rows.join(starts, (F.col("_cell") == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_place", place)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_place") - first)
        .drop("_cell", "_bucket", "_c", "_b", "_at", "_place")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, so that Parquet's minima and
    maxima are narrow in every dimension."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").option("partitionOverwriteMode", "static").mode("overwrite").parquet(path))
