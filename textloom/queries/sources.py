"""Scans, metadata and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import metadata, text as tx
from textloom.operators import ordered
from textloom.queries import fragments as sql
from textloom.queries.registry import query, table
from textloom.sources import readers
from textloom.sources.registry import (Source, cleaned_sources, registry_frame, scan_sources,
                                       split_slice, tag_sources)

# Web-crawl rows derived from documents: language in a JSON meta field, a
# perplexity list in a JSON signal field.
CRAWL_SQL = """crawl AS (SELECT doc_id, lang, text AS raw_content, n_chars,
  CAST((doc_id * 37) % 800 AS DOUBLE) AS ppl FROM documents)"""


def crawl_rows(spark: SparkSession, sf: str) -> DataFrame:
    ppl = F.pmod(F.col("doc_id") * 37, F.lit(800)).cast("double")
    entry = F.array(F.lit(0.0), F.col("n_chars").cast("double"), ppl)
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("raw_content"),
        F.to_json(F.struct(F.col("lang").alias("language"))).alias("meta"),
        F.to_json(F.struct(F.array(entry).alias("ccnet_perplexity"))).alias("quality_signals"))


def three_sources(sf: str) -> list[Source]:
    """Prose, web pages (HTML, by its key) and the evaluation items."""
    return [
        Source("prose", f"{sf}/documents.parquet", "text", "mul", "doc_id"),
        Source("stackoverflow_pages", f"{sf}/pages.parquet", "html", "en", "page_id"),
        Source("items", f"{sf}/benchmark.parquet", "text", "en", "item_id"),
        Source("turns", f"{sf}/conversations.parquet", "no_such_field", "en", "conv_id"),
    ]


@query("S1 T17", """WITH r AS (SELECT source, dense_rank() OVER (ORDER BY source)::INTEGER - 1 AS ordinal FROM documents)
SELECT d.doc_id, d.source, 'l' || r.ordinal AS lang, CASE WHEN r.ordinal % 2 = 0 THEN 'plain' ELSE 'none' END AS cleaner
FROM documents d JOIN (SELECT DISTINCT * FROM r) r USING (source)""")
def source_registry_lookup(spark, sf):
    path = f"{sf}/documents.parquet"
    names = [r[0] for r in spark.read.parquet(path).select("source").distinct().orderBy("source").collect()]
    registry = registry_frame(spark, [Source(n, path, lang=f"l{i}", cleaner="none" if i % 2 else "plain")
                                      for i, n in enumerate(names)])
    rows = tag_sources(table(spark, sf, "documents").select("doc_id", "source"), registry)
    return rows.select("doc_id", "source", F.col("source_lang").alias("lang"), "cleaner")


_SCAN_SQL = """raw AS (
  SELECT 'prose' AS source, doc_id AS ord_key, coalesce(text, '') AS text, 'mul' AS lang FROM documents
  UNION ALL SELECT 'stackoverflow_pages', page_id, coalesce(html, ''), 'en' FROM pages
  UNION ALL SELECT 'items', item_id, coalesce(text, ''), 'en' FROM benchmark
  UNION ALL SELECT 'turns', conv_id, '', 'en' FROM conversations)"""


@query("S2 S4 U2", f"WITH {_SCAN_SQL} SELECT * FROM raw")
def multi_source_scan(spark, sf):
    return scan_sources(spark, three_sources(sf))


@query("T7 T8 T9 T6 S2", f"""WITH {_SCAN_SQL}, cleaned AS (SELECT source, ord_key, lang,
  CASE WHEN starts_with(source, 'stackoverflow') THEN {sql.clean_html('text')} ELSE {sql.clean_plain('text')} END AS text
  FROM raw WHERE text <> '')
SELECT source, ord_key, text, lang FROM cleaned WHERE length(text) >= 32""")
def cleaned_multi_source(spark, sf):
    return cleaned_sources(spark, three_sources(sf))


@query("S3", """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o,
  count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE o <= round(n * 0.1)""")
def split_slice_per_source(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return split_slice(docs, 10, ["doc_id"], ["source"])


@query("S4", """SELECT event_id, coalesce(CAST(user_id AS VARCHAR), '') AS user_text, coalesce(props, '') AS props_text,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS nullable_text FROM events""")
def text_coercion(spark, sf):
    events = table(spark, sf, "events")
    types = {f.name: f.dataType for f in events.schema}
    holes = F.when(F.col("event_type") != "error", F.col("event_type"))
    return events.select("event_id", tx.as_text(F.col("user_id"), types["user_id"]).alias("user_text"),
                         tx.as_text(F.col("props"), types["props"]).alias("props_text"),
                         tx.as_text(holes).alias("nullable_text"))


@query("S5", f"WITH {CRAWL_SQL} SELECT doc_id, lang, lang AS lang_from_struct FROM crawl")
def metadata_language(spark, sf):
    rows = crawl_rows(spark, sf)
    parsed = rows.withColumn("meta_struct", F.from_json("meta", "language string"))
    return parsed.select("doc_id", metadata.language(F.col("meta")).alias("lang"), metadata.language(
        F.col("meta_struct"), parsed.schema["meta_struct"].dataType).alias("lang_from_struct"))


@query("S6", f"WITH {CRAWL_SQL} SELECT doc_id, ppl FROM crawl")
def quality_perplexity(spark, sf):
    return crawl_rows(spark, sf).select("doc_id", metadata.perplexity(F.col("quality_signals")).alias("ppl"))


@query("T10", f"""WITH {CRAWL_SQL} SELECT doc_id, lang, raw_content AS text FROM crawl
WHERE length({sql.strip('raw_content')}) >= 32 AND ppl <= 400""")
def quality_accept(spark, sf):
    ok = metadata.accept(F.col("raw_content"), metadata.perplexity(F.col("quality_signals")))
    return crawl_rows(spark, sf).where(ok).select(
        "doc_id", metadata.language(F.col("meta")).alias("lang"), F.col("raw_content").alias("text"))


_PREVIEW = "CASE WHEN length({0}) > 200 THEN substr({0}, 1, 200) || ' ...[truncated]' ELSE {0} END"


@query("S12 L2", f"""WITH {CRAWL_SQL}, firsts AS (SELECT *, replace(raw_content, chr(10), ' ') AS flat FROM crawl ORDER BY doc_id LIMIT 5)
SELECT doc_id, 'raw_content' AS field, '' AS key, {_PREVIEW.format('flat')} AS value FROM firsts
UNION ALL SELECT doc_id, 'meta', 'language', lang FROM firsts
UNION ALL SELECT doc_id, 'quality_signals', CASE WHEN doc_id % 2 = 0 THEN 'ccnet_perplexity' ELSE '' END,
CASE WHEN doc_id % 2 = 0 THEN signal ELSE '{{"ccnet_perplexity":' || signal END FROM (SELECT *, '[[0.0,' || n_chars || '.0,' || ppl || ']]' AS signal FROM firsts)""")
def sample_preview(spark, sf):
    # Every other value lacks its end, so it is shown as it is.
    signals = F.col("quality_signals")
    broken = F.when(F.col("doc_id") % 2 == 0, signals).otherwise(F.substring(signals, F.lit(1), F.length(signals) - 1))
    rows = ordered.head(crawl_rows(spark, sf).withColumn("quality_signals", broken), 5, ["doc_id"])
    return readers.preview(rows, "doc_id", text_fields=["raw_content"], json_fields=["meta", "quality_signals"])


@query("S10", f"""SELECT conv_id, turn, line_no, p AS prompt FROM (
  SELECT conv_id, turn, {sql.strip('line')} AS p, line_no - 1 AS line_no FROM (SELECT conv_id, turn,
    unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no
    FROM conversations)) WHERE p <> ''""")
def prompt_lines(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.prompts(lines, "line").withColumnRenamed("line", "prompt")


@query("S11", "SELECT item_id, coalesce(text, '') AS text FROM benchmark ORDER BY item_id LIMIT 2000")
def evaluation_scan(spark, sf):
    return readers.evaluation_set(table(spark, sf, "benchmark"), ["item_id"], max_samples=2000)
