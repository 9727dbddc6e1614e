"""Writers. Every sink leaves one directory of plain files.

Shards can be *published*: each run writes a set of its own below the root and then a manifest that names it, with the files, rows and
tokens of every shard. A manifest counts from the moment Spark has committed it, so readers see the previous set or the new one,
whole; what a killed or a longer earlier run left behind is in no manifest that counts.

A file costs as much as many thousand rows, so shards far below ``FILE_TOKENS`` share one: consecutive whole shards, sorted, in a folder
``shard_group=n``, with ``shard_id`` as a column of the file. Shards of that size or more have a folder and a file each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.ordered import whole_div
from textloom.workspace import committed


#: Tokens below which whole shards share a file.
FILE_TOKENS = 1 << 20
GROUP = "shard_group"


def together(shard_tokens: float) -> int:
    """How many consecutive shards of this size share a file."""
    return max(1, int(FILE_TOKENS // max(1, shard_tokens)))


def _grouped(rows: DataFrame, shards_a_file: int) -> tuple[DataFrame, str]:
    """The rows and the column that names their folder."""
    if shards_a_file <= 1:
        return rows, "shard_id"
    return rows.withColumn(GROUP, whole_div(F.col("shard_id").cast("bigint"), shards_a_file)), GROUP


def _writers(df: DataFrame) -> int:
    """Number of writing tasks. Given outright, so that adaptive execution does
    not put many small shards on one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_shards(docs: DataFrame, path: str, clean: bool = False, source: str = "source") -> None:
    """Text shards, one directory per (source, shard), one file each. A shard
    holds a bounded number of tokens, so the shuffle key cannot be hot. Rewrites
    only the shards it has; ``clean`` also removes older ones."""
    mode = "static" if clean else "dynamic"
    (
        docs.repartition(_writers(docs), source, "shard_id")
        .write.mode("overwrite").option("partitionOverwriteMode", mode)
        .partitionBy(source, "shard_id").parquet(path)
    )


_SETS, _MANIFESTS = "_sets", "_manifests"


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests that count, in order."""
    return sorted(int(name[1:9]) for name in committed(spark, f"{root}/{_MANIFESTS}") if re.fullmatch(r"v\d{8}-[0-9a-f]+", name))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """``(source, shard_id, set, files, rows, tokens)`` of a version, the last one by default; None before the first."""
    known = versions(spark, root)
    if not known:
        return None
    wanted = f"v{known[-1] if version is None else version:08d}-"
    # Two runs that end together have one number: the first name counts, for all readers.
    name = next(n for n in committed(spark, f"{root}/{_MANIFESTS}") if n.startswith(wanted))
    return spark.read.parquet(f"{root}/{_MANIFESTS}/{name}")


def publish_shards(docs: DataFrame, root: str, planned: DataFrame, source: str = "source", rows_a_file: int = 0) -> DataFrame:
    """Write text shards as a new set below ``root``, publish it, and return its manifest. ``planned`` has the rows and tokens of each shard,
    ``(source, shard_id, rows, tokens)``, counted before (``shard_summary``): it gives the mean size of a shard, by which small shards share
    files, and one writer per file, at least one; it becomes the manifest together with the files that were written. ``rows_a_file`` cuts a
    shard's file in several; shards share none then. A run whose rows differ from its plan is not published."""
    spark = docs.sparkSession
    name = uuid.uuid4().hex[:12]
    place = f"{root}/{_SETS}/{name}"
    plan = planned.select(source, F.col("shard_id").cast("bigint").alias("shard_id"), F.col("rows").cast("bigint").alias("rows"),
                          F.col("tokens").cast("bigint").alias("tokens"))
    size = plan.agg(F.count(F.lit(1)).alias("shards"), F.sum("tokens").alias("tokens")).first()
    shards_a_file = 1 if rows_a_file else together((size["tokens"] or 0) / max(1, size["shards"]))
    rows, folder = _grouped(docs, shards_a_file)
    writers = _grouped(plan, shards_a_file)[0].select(source, folder).distinct().count()
    (rows.repartition(max(1, writers), source, folder).sortWithinPartitions(*dict.fromkeys([source, folder, "shard_id"]))
     .write.option("maxRecordsPerFile", rows_a_file).partitionBy(source, folder).parquet(place))
    key = [F.col(source).cast("string").alias("_source"), F.col("shard_id").cast("bigint").alias("_shard")]
    if _files(spark, place) in ([], ["_SUCCESS"]):
        written = spark.createDataFrame([], "_source string, _shard bigint, files bigint, _rows bigint")
    else:
        written = spark.read.option("basePath", place).parquet(place).groupBy(*key).agg(
            F.count_distinct("_metadata.file_path").alias("files"), F.count(F.lit(1)).alias("_rows"))
    same = (F.col(source).cast("string").eqNullSafe(F.col("_source"))) & (F.col("shard_id") == F.col("_shard"))
    both = plan.join(written, same, "full").select(
        source, "shard_id", F.lit(name).alias("set"), "files", "rows", "tokens", F.col("rows").eqNullSafe(F.col("_rows")).alias("_same"))
    if not both.where("not _same").isEmpty():
        raise RuntimeError(f"the rows written to {place} are not those planned; the set is not published")
    number = (versions(spark, root) or [0])[-1] + 1
    both.drop("_same").coalesce(1).write.parquet(f"{root}/{_MANIFESTS}/v{number:08d}-{name}")
    return manifest(spark, root, number)


def remove_old_sets(spark: SparkSession, root: str) -> list[str]:
    """Delete the sets that the last manifest does not name; their names. Not while another run writes."""
    last = manifest(spark, root)
    kept = set() if last is None else {r[0] for r in last.select("set").distinct().collect()}
    old = [name for name in _files(spark, f"{root}/{_SETS}") if name not in kept]
    for name in old:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{_SETS}/{name}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return old


def write_packed(rows: DataFrame, path: str, one_file_per_shard: bool = True, shards_a_file: int = 1) -> None:
    """Packed rows, one directory per shard, or per ``shards_a_file`` consecutive shards. By default each directory is one sorted
    file; without that, tasks write the rows they hold, which saves a shuffle of
    the rows and leaves a few files per shard. Shards of an earlier run are
    removed."""
    rows, folder = _grouped(rows, shards_a_file)
    if one_file_per_shard:
        rows = rows.repartition(_writers(rows), folder).sortWithinPartitions(*dict.fromkeys([folder, "shard_id", "row_idx"]))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
     .partitionBy(folder).parquet(path))


def write_lines(lines: DataFrame, path: str, order_by: Sequence[str], column: str = "line") -> None:
    """One line per document in order; part files sort like their content."""
    lines.orderBy(*order_by).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_series(series: DataFrame, path: str, order_by: Sequence[str]) -> None:
    """Metric series as CSV with a header."""
    series.orderBy(*order_by).write.mode("overwrite").option("header", True).csv(path)


def write_generations(records: DataFrame, path: str, literal_prompt_key: bool = False) -> None:
    """Generation records as JSON lines in UTF-8. ``literal_prompt_key`` names
    the first field ``prompt:``, as older record files do."""
    if literal_prompt_key:
        records = records.withColumnRenamed("prompt", "prompt:")
    records.write.mode("overwrite").json(path)


def read_shards(spark: SparkSession, root: str, columns: Sequence[str] | None = ("text",)) -> DataFrame:
    """Text shards under one root, those of the last manifest if it has one; only the named columns are read, or all of them."""
    last = manifest(spark, root)
    if last is not None:
        one = last.select("set").first()
        if one is None:  # a published set without shards
            return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns or ("text",)))
        root = f"{root}/{_SETS}/{one[0]}"
    rows = spark.read.parquet(root)
    return rows.select(*columns) if columns else rows.drop(GROUP)
