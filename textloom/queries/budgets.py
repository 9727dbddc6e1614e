"""Mix, budgets, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import budget, mix as mx, ordered, shards
from textloom.plans.corpus import Corpus, line_corpus, mixed_corpus, quality_subset
from textloom.queries import fragments as sql
from textloom.queries.registry import query, table, texts
from textloom.queries.sources import crawl_rows, CRAWL_SQL
from textloom.sources import sinks
from textloom.sources.registry import Source, clean_documents, registry_frame, tag_sources
from textloom.workspace import freeze, new_path


def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of the documents table, in the order of their names."""
    path = f"{sf}/documents.parquet"
    names = spark.read.parquet(path).select("source").distinct().orderBy("source").collect()
    return registry_frame(spark, [Source(r[0], path, lang="en") for r in names])


def share_of_corpus(counts: DataFrame) -> int:
    """Sixty percent of all tokens, so that budgets grow with the tables."""
    return counts.agg(F.sum("n_tok")).first()[0] * 6 // 10


def corpus(spark: SparkSession, sf: str, shard_mode: str = "greedy") -> Corpus:
    return mixed_corpus(table(spark, sf, "documents").select("doc_id", "source", "text"),
                        source_registry(spark, sf), sql.MIX, share_of_corpus, sql.SHARD_TOKENS,
                        shard_mode=shard_mode)


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored table (source, doc_id, n_tok) of the cleaned documents."""
    docs = texts(spark, sf, "source", "doc_id", "text").withColumn("cleaner", F.lit("plain"))
    cleaned = clean_documents(docs, cleaners_used={"plain"})
    return freeze(cleaned.select("source", "doc_id", tx.count_tokens(F.col("text")).alias("n_tok")), "counts")


@query("B1 J2", f"WITH {sql.MIX_SQL} SELECT source_key, round(weight, 12) AS weight FROM mix")
def mix_weights(spark, sf):
    mix = mx.parse_mix(spark, sql.MIX, source_registry(spark, sf))
    return mix.select("source_key", F.round("weight", 12).alias("weight"))


@query("J2", f"""WITH {sql.MIX_SQL} SELECT DISTINCT source_key FROM entries
WHERE weight IS NOT NULL AND source_key NOT IN (SELECT source_key FROM registry)""")
def mix_unknown_keys(spark, sf):
    return mx.unknown_keys(mx.mix_entries(spark, sql.MIX), source_registry(spark, sf))


@query("B2 J1", f"""WITH {sql.BUDGETED_SQL}
SELECT source_key, budget, 'text' AS text_field, 'en' AS lang FROM budgets""")
def source_budgets(spark, sf):
    registry = source_registry(spark, sf)
    total = share_of_corpus(token_counts(spark, sf))
    budgets = mx.token_budgets(mx.parse_mix(spark, sql.MIX, registry), total)
    return mx.mix_with_registry(budgets, registry).select("source_key", "budget", "text_field", "lang")


@query("J3 B3", f"WITH {sql.BUDGETED_SQL} SELECT source, doc_id, n_tok, running FROM admitted")
def budget_capped(spark, sf):
    counts = token_counts(spark, sf)
    weights = mx.parse_mix(spark, sql.MIX, source_registry(spark, sf))
    rows = mx.attach_budgets(counts, mx.token_budgets(weights, share_of_corpus(counts)))
    return budget.admit_capped(rows, F.col("budget"), ["doc_id"]).select("source", "doc_id", "n_tok", "running")


@query("B4", f"""WITH {CRAWL_SQL}, good AS (SELECT doc_id, lang, raw_content, {sql.n_tokens('raw_content')} AS n_tok FROM crawl
  WHERE length({sql.strip('raw_content')}) >= 32 AND ppl <= 400),
run AS (SELECT *, sum(n_tok) OVER (ORDER BY doc_id)::BIGINT AS running FROM good)
SELECT doc_id, n_tok, running FROM run WHERE running - n_tok < (SELECT sum(n_tok) * 5 // 10 FROM good)""")
def budget_crossing(spark, sf):
    good = crawl_rows(spark, sf).where(accept_crawl()).select(
        "doc_id", tx.count_tokens(F.col("raw_content")).alias("n_tok"))
    counts = freeze(good, "counts")
    target = counts.agg(F.sum("n_tok")).first()[0] * 5 // 10
    return budget.admit_crossing(counts, F.lit(target), ["doc_id"])


def accept_crawl():
    from textloom.functions import metadata

    return metadata.accept(F.col("raw_content"), metadata.perplexity(F.col("quality_signals")))


@query("B8", f"""WITH {sql.CLEANED_DOCS} SELECT source, doc_id,
count(*) OVER w::BIGINT AS docs_so_far, sum(n_tok) OVER w::BIGINT AS tokens_so_far
FROM docs WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def source_progress(spark, sf):
    return budget.progress(token_counts(spark, sf), ["doc_id"]).select(
        "source", "doc_id", "docs_so_far", "tokens_so_far")


@query("B7", f"""WITH RECURSIVE {sql.BUDGETED_SQL}, {sql.greedy_sql('admitted', sql.SHARD_TOKENS)}
SELECT source, doc_id, n_tok, shard_id FROM sharded""")
def greedy_shards(spark, sf):
    return corpus(spark, sf).sharded_counts().select("source", "doc_id", "n_tok", "shard_id")


@query("B7", f"""WITH {sql.BUDGETED_SQL}
SELECT source, doc_id, n_tok, ((running - n_tok) // {sql.SHARD_TOKENS})::BIGINT AS shard_id FROM admitted""")
def uniform_shards(spark, sf):
    return corpus(spark, sf, "uniform").sharded_counts().select("source", "doc_id", "n_tok", "shard_id")


@query("B8", f"""WITH RECURSIVE {sql.BUDGETED_SQL}, {sql.greedy_sql('admitted', sql.SHARD_TOKENS)}
SELECT source, doc_id, shard_id,
  sum(n_tok) OVER (PARTITION BY source, shard_id ORDER BY doc_id)::BIGINT AS shard_tokens_so_far FROM sharded""")
def shard_progress(spark, sf):
    rows = shards.shard_progress(corpus(spark, sf).sharded_counts(), ["doc_id"])
    return rows.select("source", "doc_id", "shard_id", "shard_tokens_so_far")


@query("K6", f"""WITH RECURSIVE {sql.BUDGETED_SQL}, {sql.greedy_sql('admitted', sql.SHARD_TOKENS)},
per_shard AS (SELECT source, shard_id, count(*) AS docs, sum(n_tok) AS tokens FROM sharded GROUP BY ALL)
SELECT source, sum(docs)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS shards
FROM per_shard GROUP BY ROLLUP (source)""")
def corpus_summary(spark, sf):
    return corpus(spark, sf).summary()


@query("K1 S7", f"""WITH RECURSIVE {sql.BUDGETED_SQL}, {sql.greedy_sql('admitted', sql.SHARD_TOKENS)}
SELECT source, shard_id, doc_id, text, 'en' AS lang FROM sharded""")
def corpus_shards_written(spark, sf):
    path, built = new_path(spark, "corpus"), corpus(spark, sf)
    sinks.publish_shards(built.documents, path, built.shard_sizes())
    back = sinks.read_shards(spark, path, ["source", "shard_id", "doc_id", "text", "lang"])
    return back.withColumn("shard_id", F.col("shard_id").cast("bigint"))


@query("K1 K6", f"""WITH RECURSIVE {sql.BUDGETED_SQL}, {sql.greedy_sql('admitted', sql.SHARD_TOKENS)}
SELECT source, shard_id, 1::BIGINT AS files, count(*) AS rows, sum(n_tok)::BIGINT AS tokens FROM sharded
WHERE source IN ('src1', 'src2') GROUP BY ALL""")
def shard_manifest(spark, sf):
    """A run over all sources and a shorter one after it: the manifest names the second set alone."""
    path, built = new_path(spark, "corpus"), corpus(spark, sf)
    sinks.publish_shards(built.documents, path, built.shard_sizes())
    some = F.col("source").isin("src1", "src2")
    last = sinks.publish_shards(built.documents.where(some), path, built.shard_sizes().where(some))
    return last.drop("set")


@query("T10 B4 B7", f"""WITH RECURSIVE {CRAWL_SQL}, good AS (
  SELECT 'crawl' AS source, doc_id, lang, raw_content AS text, {sql.n_tokens('raw_content')} AS n_tok FROM crawl
  WHERE length({sql.strip('raw_content')}) >= 32 AND ppl <= 400),
run AS (SELECT *, sum(n_tok) OVER (ORDER BY doc_id)::BIGINT AS running FROM good),
taken AS (SELECT * FROM run WHERE running - n_tok < (SELECT sum(n_tok) * 6 // 10 FROM good)), {sql.greedy_sql('taken', 20000)}
SELECT doc_id, lang, text, shard_id FROM sharded""")
def quality_corpus(spark, sf):
    rows = quality_subset(crawl_rows(spark, sf), target_tokens=share_of_corpus, shard_tokens=20000).documents
    return rows.select("doc_id", "lang", "text", "shard_id")


_TURNS = f"""turns AS (SELECT *, dense_rank() OVER (ORDER BY source) - 1 AS ordinal,
    row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS turn,
    replace({sql.strip('text')}, chr(10), ' ') AS line FROM documents),
lines AS (SELECT *, row_number() OVER w::BIGINT AS line_no,
    sum(octet_length(encode(line)) + 1) OVER w::BIGINT AS running
    FROM turns WHERE line <> '' WINDOW w AS (ORDER BY turn, ordinal))"""


def ordered_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    return tag_sources(docs, source_registry(spark, sf)).select("source", "doc_id", "text", "ordinal")


@query("U1", f"WITH {_TURNS} SELECT line_no, doc_id FROM lines")
def interleaved_order(spark, sf):
    from textloom.operators.interleave import interleave

    rows = ordered_documents(spark, sf).select(
        "source", "ordinal", "doc_id", (tx.strip(F.col("text")) == "").alias("blank"))
    turns = freeze(interleave(rows, "doc_id"), "turns").where(~F.col("blank"))
    return ordered.ordinals(turns, ["turn", "ordinal"], name="line_no").select("line_no", "doc_id")


@query("B5 T12 T13", f"""WITH {_TURNS}, total AS (SELECT max(running) * 6 // 10 AS b FROM lines)
SELECT line_no, line FROM lines WHERE running - octet_length(encode(line)) - 1 < (SELECT b FROM total)""")
def byte_budget_lines(spark, sf):
    docs = ordered_documents(spark, sf)
    line = tx.flatten_lines(F.col("text"))
    size = docs.where(line != "").agg(F.sum(tx.line_bytes(line))).first()[0]
    return line_corpus(docs, max_bytes=size * 6 // 10)


@query("B6 L2", f"""WITH {_TURNS} SELECT line_no, line FROM lines
WHERE line_no <= (SELECT count(*) // 2 FROM documents)""")
def line_budget_lines(spark, sf):
    docs = ordered_documents(spark, sf)
    return line_corpus(docs, max_lines=docs.count() // 2)


@query("K3", f"WITH {_TURNS} SELECT line AS value FROM lines")
def line_corpus_written(spark, sf):
    path = new_path(spark, "lines")
    sinks.write_lines(line_corpus(ordered_documents(spark, sf), max_bytes=None), path, ["line_no"])
    return spark.read.text(path)


@query("K6 T14", f"""WITH {_TURNS} SELECT source, count(*)::BIGINT AS lines,
  sum(octet_length(encode(line)) + 1)::BIGINT AS bytes, {sql.human_size('sum(octet_length(encode(line)) + 1)')} AS size
FROM lines GROUP BY source""")
def line_corpus_summary(spark, sf):
    line = tx.flatten_lines(F.col("text"))
    return (
        table(spark, sf, "documents").where(line != "").groupBy("source")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(tx.line_bytes(line)).alias("bytes"))
        .withColumn("size", tx.human_size(F.col("bytes")))
    )
