"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import html, text as tx
from textloom.functions.cleaners import clean_by_name, cleaner_name
from textloom.queries import fragments as sql
from textloom.queries.registry import query, table


def over(spark, sf, name, key, **columns):
    return table(spark, sf, name).select(key, *[c.alias(n) for n, c in columns.items()])


@query("T1", f"SELECT page_id, {sql.collapse('html')} AS text FROM pages")
def collapse_spaces(spark, sf):
    return over(spark, sf, "pages", "page_id", text=tx.collapse_spaces(F.col("html")))


@query("T2", f"SELECT doc_id, {sql.strip('text')} AS text FROM documents")
def strip_text(spark, sf):
    return over(spark, sf, "documents", "doc_id", text=tx.strip(F.col("text")))


@query("T3", f"SELECT doc_id, {sql.clean_plain('text')} AS text FROM documents")
def clean_plain(spark, sf):
    return over(spark, sf, "documents", "doc_id", text=tx.clean_plain(F.col("text")))


@query("T4", f"SELECT page_id, {sql.unescape('html')} AS text FROM pages")
def unescape_html(spark, sf):
    return over(spark, sf, "pages", "page_id", text=html.unescape(F.col("html")))


@query("T5", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def strip_tags(spark, sf):
    return over(spark, sf, "pages", "page_id", text=tx.strip_tags(F.col("html")))


@query("T6", f"SELECT page_id, {sql.clean_html('html')} AS text FROM pages")
def clean_html(spark, sf):
    return over(spark, sf, "pages", "page_id", text=html.clean_html(F.col("html")))


@query("T7", f"""WITH keyed AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'stackoverflow_en' ELSE 'wiki' END AS source, html FROM pages)
SELECT page_id, source, CASE WHEN source = 'wiki' THEN {sql.clean_plain('html')} ELSE {sql.clean_html('html')} END AS text FROM keyed""")
def cleaner_dispatch(spark, sf):
    source = F.when(F.col("page_id") % 2 == 0, "stackoverflow_en").otherwise("wiki")
    keyed = table(spark, sf, "pages").withColumn("source", source)
    return keyed.select("page_id", "source", clean_by_name(F.col("html"), cleaner_name(F.col("source"))).alias("text"))


@query("T8 T9", f"""SELECT * FROM (SELECT doc_id, {sql.clean_plain('text')} AS text FROM documents WHERE text <> '')
WHERE length(text) >= 32""")
def minimum_length(spark, sf):
    rows = table(spark, sf, "documents").where("text <> ''").select("doc_id", tx.clean_plain(F.col("text")).alias("text"))
    return rows.where(F.length("text") >= tx.MIN_CHARS)


@query("T11 N5", f"SELECT * FROM (SELECT doc_id, {sql.n_tokens('text')} AS n_tok FROM documents) WHERE n_tok > 0")
def positive_token_count(spark, sf):
    return over(spark, sf, "documents", "doc_id", n_tok=tx.count_tokens(F.col("text"))).where("n_tok > 0")


@query("T12", f"SELECT doc_id, replace({sql.strip('text')}, chr(10), ' ') AS line FROM documents")
def flatten_lines(spark, sf):
    return over(spark, sf, "documents", "doc_id", line=tx.flatten_lines(F.col("text")))


@query("T13", "SELECT doc_id, length(text)::INTEGER AS chars, (octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents")
def text_lengths(spark, sf):
    return over(spark, sf, "documents", "doc_id", chars=F.length("text"), bytes=tx.line_bytes(F.col("text")))


@query("T14", f"""SELECT doc_id, {sql.human_size('octet_length(encode(text))')} AS size,
{sql.human_size('octet_length(encode(text)) * 123457')} AS scaled FROM documents""")
def human_sizes(spark, sf):
    n = F.octet_length("text").cast("bigint")
    return over(spark, sf, "documents", "doc_id", size=tx.human_size(n), scaled=tx.human_size(n * 123457))


@query("T15", f"""SELECT doc_id, CASE WHEN {sql.strip('text')} = '' THEN 0 ELSE len(string_split(trim({sql.collapse('text')}), ' ')) END::INTEGER AS n_words,
md5({sql.strip(sql.collapse('text'))}) AS words_md5 FROM documents""")
def whitespace_words(spark, sf):
    words = tx.split_words(F.col("text"))
    return over(spark, sf, "documents", "doc_id", n_words=F.size(words), words_md5=F.md5(F.array_join(words, " ")))


@query("T16", "SELECT event_id, round(value / 7, 4) AS rounded FROM events")
def round_four(spark, sf):
    # Sevenths have no exact ties; those are in the unit test, where the engines' rules differ.
    return table(spark, sf, "events").select("event_id", tx.round4(F.col("value") / 7).alias("rounded"))
