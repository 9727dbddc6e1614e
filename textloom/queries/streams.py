"""Streams over documents and log lines that arrive in three parts, each part
processed by a fresh run from the same checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import mix as mx
from textloom.queries import fragments as sql
from textloom.queries.budgets import share_of_corpus, source_registry, token_counts
from textloom.queries.logs import POINTS, log_lines
from textloom.queries.packs import L, ROWS_PER_SHARD
from textloom.queries.registry import query, texts
from textloom.queries.tokens import vocabulary
from textloom.streaming import budget, ingest, logs, pack
from textloom.workspace import new_path

DOCS = "doc_id bigint, source string, text string"


def arrive(df: DataFrame, key: str, path: str, run: Callable[[], object]) -> list:
    """Append three consecutive key ranges one by one, running the stream after
    each."""
    cuts = df.approxQuantile(key, [1 / 3, 2 / 3], 0.01)
    ranges = [F.col(key) < cuts[0], (F.col(key) >= cuts[0]) & (F.col(key) < cuts[1]), F.col(key) >= cuts[1]]
    results = []
    for part in ranges:
        df.where(part).write.mode("append").parquet(path)
        results.append(run())
    return results


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "doc_id", "source", "text")


@query("X1", f"WITH {sql.CLEANED_DOCS} SELECT doc_id, source, text FROM docs")
def streamed_cleaning(spark, sf):
    path, out, check = (new_path(spark, n) for n in ("arriving", "cleaned", "check"))
    arrive(documents(spark, sf), "doc_id", path, lambda: ingest.append_to(
        ingest.cleaned_stream(ingest.arriving(spark, path, DOCS)), out, check))
    return spark.read.schema(DOCS).parquet(out)


@query("X2", f"""WITH RECURSIVE {sql.BUDGETED_SQL}, {sql.greedy_sql('admitted', sql.SHARD_TOKENS)}
SELECT source, doc_id, text, shard_id FROM sharded""")
def streamed_budget(spark, sf):
    path, out, state_dir, check = (new_path(spark, n) for n in ("arriving", "taken", "state", "check"))
    total = share_of_corpus(token_counts(spark, sf))
    start = budget.initial_state(mx.token_budgets(mx.parse_mix(spark, sql.MIX, source_registry(spark, sf)), total))
    arrive(documents(spark, sf), "doc_id", path, lambda: budget.budgeted_stream(
        ingest.cleaned_stream(ingest.arriving(spark, path, DOCS)), start, out, state_dir, check, sql.SHARD_TOKENS, ["doc_id"]))
    return spark.read.parquet(out).select("source", "doc_id", "text", "shard_id")


@query("X3", f"WITH {sql.PACKED} SELECT row_idx, shard_id, input_ids FROM packed")
def streamed_packing(spark, sf):
    path, out, state_dir, check = (new_path(spark, n) for n in ("arriving", "packed", "state", "check"))
    words = vocabulary(spark, sf)
    arrive(documents(spark, sf), "doc_id", path, lambda: pack.packed_stream(
        ingest.arriving(spark, path, DOCS), words, out, state_dir, check, L, L * ROWS_PER_SHARD, ["doc_id"]))
    tail = pack.finish_stream(spark, state_dir, L, L * ROWS_PER_SHARD)
    rows = spark.read.parquet(out).select(*tail.columns).unionByName(tail)
    return rows.select("row_idx", "shard_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query("X4", f"WITH {POINTS} SELECT run, step, loss, first_pos FROM points")
def streamed_log_points(spark, sf):
    path, out, check = (new_path(spark, n) for n in ("arriving", "points", "check"))
    arrive(log_lines(spark, sf), "line_no", path, lambda: logs.metric_stream(
        ingest.arriving(spark, path, "run string, line_no bigint, line string"), out, check))
    return logs.current_points(spark, out)


@query("X5", f"WITH {sql.CLEANED_DOCS} SELECT count(*) AS docs, sum(n_tok)::BIGINT AS tokens FROM docs")
def streamed_progress(spark, sf):
    path, out, check = (new_path(spark, n) for n in ("arriving", "cleaned", "check"))

    def run():
        cleaned = ingest.cleaned_stream(ingest.arriving(spark, path, DOCS))
        counted = ingest.observed(cleaned, "progress", docs=F.count(F.lit(1)),
                                  tokens=F.sum(tx.count_tokens(F.col("text"))))
        return ingest.append_to(counted, out, check)

    with ingest.recorded(spark, "progress") as log:
        queries = arrive(documents(spark, sf), "doc_id", path, run)
        rows = [(p["docs"], p["tokens"]) for q in queries for p in log.rows(q)]
    return spark.createDataFrame(rows, "docs bigint, tokens bigint").agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
