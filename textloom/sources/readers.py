"""Readers for text lines, logs, prompts, evaluation sets and packed rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.ordered import head, ordinals
from textloom.sources.sinks import GROUP


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly work on an input with fewer splits than cores (a
    small file, perhaps with a single row group). Larger inputs pass through
    untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Log lines as ``(run, line_no, line)``. Line feeds, carriage returns and
    both end a line; bad bytes are tolerated. The run is the file unless named.
    ``line_no`` orders lines by file, by the offset of the split they were read
    in, and by place within the split."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(
        (F.lit(run) if run else F.col("file")).alias("run"),
        F.struct("file", "block", within.alias("at")).alias("line_no"),
        F.col("value").alias("line"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt per line, stripped, blanks dropped."""
    return prompts(spark.read.text(path).withColumnRenamed("value", "prompt"), "prompt")


def prompts(lines: DataFrame, column: str) -> DataFrame:
    """Strip ``column`` and drop rows where nothing is left."""
    return lines.withColumn(column, tx.strip(F.col(column))).where(F.col(column) != "")


def generation_records(spark: SparkSession, path: str) -> DataFrame:
    """``(prompt, output, sec)`` of JSON lines; the first field may be named ``prompt:``."""
    rows = spark.read.schema("prompt string, `prompt:` string, output string, sec double").json(path)
    return rows.select(F.coalesce("prompt", F.col("`prompt:`")).alias("prompt"), "output", "sec")


def evaluation_set(rows: DataFrame, order_by: Sequence[str], text_field: str = "text",
                   max_samples: int = 0) -> DataFrame:
    """Evaluation texts, NULL or missing as ``''``; ``max_samples`` first rows
    when it is set."""
    text = tx.as_text(F.col(text_field)) if text_field in rows.columns else F.lit("")
    picked = rows.select(*order_by, text.alias("text"))
    return head(picked, max_samples, order_by) if max_samples else picked


def preview(rows: DataFrame, key: str, text_fields: Sequence[str] = (),
            json_fields: Sequence[str] = ()) -> DataFrame:
    """Readable ``(key, field, key, value)`` lines of a few sample rows: texts
    cut to one short line, JSON fields one line per entry, or raw when they do
    not parse, everything else as text."""
    entries = []
    for f in rows.schema:
        column = F.col(f.name)
        if f.name == key:
            continue
        if f.name in json_fields:
            parsed = F.from_json(column, "map<string,string>")
            items = F.transform(F.map_entries(parsed), lambda e: F.struct(
                F.lit(f.name).alias("field"), e["key"].alias("key"), e["value"].alias("value")))
            raw = F.array(F.struct(F.lit(f.name).alias("field"), F.lit("").alias("key"), column.alias("value")))
            entries.append(F.when(parsed.isNotNull(), items).otherwise(raw))
        else:
            value = tx.as_text(column, f.dataType)
            shown = tx.preview(value) if f.name in text_fields else value
            entries.append(F.array(F.struct(F.lit(f.name).alias("field"), F.lit("").alias("key"), shown.alias("value"))))
    return rows.select(key, F.inline(F.concat(*entries)))


_PLACE = {"_file": "_metadata.file_path", "_row": "_metadata.row_index"}


def read_packed(spark: SparkSession, *roots: str, pattern: str = "*.parquet", places: bool = False) -> DataFrame:
    """Packed rows of several roots: ``root`` is the place of the root in the
    order given, ``shard_id`` the shard within it. The order of the files is that
    of (root, shard_id); ``ranked_packed`` gives each row its place in it. ``places`` adds
    the file and the row of the file. Fails when no root has a matching file."""
    parts = []
    for i, root in enumerate(roots):
        try:
            rows = spark.read.option("pathGlobFilter", pattern).option("basePath", root).parquet(root)
        except AnalysisException as error:
            if error.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            continue
        rows = rows.select("*", *[F.col(m).alias(n) for n, m in _PLACE.items()]) if places else rows
        parts.append(rows.drop(GROUP).withColumn("root", F.lit(i)).withColumn("shard_id", F.col("shard_id").cast("bigint")))
    if not parts:
        raise FileNotFoundError(f"no packed files in {list(roots)} (pattern={pattern})")
    return reduce(DataFrame.unionByName, parts)


def ranked_packed(spark: SparkSession, *roots: str, pattern: str = "*.parquet") -> DataFrame:
    """``read_packed`` with ``rank``: the place of a row, from 0, in the order of (root, shard, file, row of the file), taken from the files'
    metadata and not from the rows. It is verified: the job ends if the files of a root do not hold its rows in
    the order of ``row_idx``, or hold a row twice."""
    place = ["root", "shard_id", *_PLACE]
    rows = read_packed(spark, *roots, pattern=pattern, places=True)
    narrow = rows.select(*place, "row_idx")
    by_place = ordinals(narrow, place, name="_rank")
    by_content = ordinals(narrow, ["root", "row_idx"], name="_right").select(
        F.col("root").alias("_r"), F.col("row_idx").alias("_i"), "_right")
    wrong = F.raise_error(F.concat(F.lit("row "), F.col("row_idx").cast("string"), F.lit(" is out of order in "), F.col("_file"))).cast("bigint")
    checked = by_place.join(by_content, (F.col("root") == F.col("_r")) & (F.col("row_idx") == F.col("_i"))).select(
        *[F.col(c).alias(f"_{c}") for c in place], F.when(F.col("_rank") == F.col("_right"), F.col("_rank") - 1).otherwise(wrong).alias("rank"))
    same = [F.col(c) == F.col(f"_{c}") for c in place]
    return rows.join(checked, same).drop(*[f"_{c}" for c in place], *_PLACE)
