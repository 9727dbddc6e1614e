"""Evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ngrams as ng, text as tx
from textloom.operators import evaluation as ev
from textloom.queries import fragments as sql
from textloom.queries.registry import query, table, texts
from textloom.sources import readers, sinks
from textloom.workspace import freeze, new_path

BLOCK, WARMUP = 16, 3

_SPLIT = f"""CASE WHEN {sql.strip('text')} = '' THEN []::VARCHAR[] ELSE string_split(trim({sql.collapse('text')}), ' ') END"""


def _ratio(n: int) -> str:
    gram = "w[i]" if n == 1 else "array_to_string(w[i:i + {}], ' ')".format(n - 1)
    return (f"CASE WHEN len(w) < {n} THEN 0 ELSE len(list_distinct([{gram} for i in range(1, len(w) - {n - 2})]))"
            f" / (len(w) - {n - 1}) END::DOUBLE")


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """All turns stand in for generated texts."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("output"))


@query("A10 T15", f"""WITH words AS (SELECT doc_id, {_SPLIT} AS w FROM documents)
SELECT doc_id, round({_ratio(1)}, 9) AS d1, round({_ratio(2)}, 9) AS d2, round({_ratio(3)}, 9) AS d3 FROM words""")
def distinct_ngram_ratios(spark, sf):
    words = texts(spark, sf, "doc_id", "text").select("doc_id", tx.split_words(F.col("text")).alias("w"))
    return words.select("doc_id", *[F.round(ng.distinct_ratio(F.col("w"), n), 9).alias(f"d{n}") for n in (1, 2, 3)])


@query("A11", f"""WITH words AS (SELECT conv_id, turn, {_SPLIT} AS w FROM conversations)
SELECT conv_id, turn, round({_ratio(1)}, 9) AS distinct_1, round({_ratio(2)}, 9) AS distinct_2 FROM words""")
def diversity_report(spark, sf):
    rows = ev.diversity(generations(spark, sf))
    return rows.select("conv_id", "turn", F.round("distinct_1", 9).alias("distinct_1"),
                       F.round("distinct_2", 9).alias("distinct_2"))


@query("U3 A10", f"""WITH words AS (SELECT lang, {_SPLIT} AS w FROM documents),
grams AS (SELECT lang, w[i] || ' ' || w[i + 1] AS g FROM words, unnest(range(1, len(w))) AS r(i))
SELECT lang, count(*) AS ngrams, count(DISTINCT g) AS distinct_ngrams, round(count(DISTINCT g) / count(*), 9) AS ratio
FROM grams GROUP BY lang""")
def corpus_distinct_bigrams(spark, sf):
    rows = ev.corpus_distinct(texts(spark, sf, "lang", "text"), 2, ["lang"])
    return rows.withColumn("ratio", F.round("ratio", 9))


@query("K5 A11 T16", f"""WITH words AS (SELECT text, conv_id, turn, {_SPLIT} AS w FROM conversations)
SELECT conv_id || '/' || turn AS "prompt:", text AS output, round(length(text) / 7, 4) AS sec, round({_ratio(1)}, 9) AS distinct_1,
round({_ratio(2)}, 9) AS distinct_2 FROM words""")
def generation_records_written(spark, sf):
    path = new_path(spark, "generations")
    records = ev.diversity(generations(spark, sf)).select(
        F.concat_ws("/", "conv_id", "turn").alias("prompt"), "output",
        tx.round4(F.length("output") / 7).alias("sec"),
        F.round("distinct_1", 9).alias("distinct_1"), F.round("distinct_2", 9).alias("distinct_2"))
    sinks.write_generations(records, path, literal_prompt_key=True)
    return spark.read.schema("`prompt:` string, output string, sec double, distinct_1 double, distinct_2 double").json(path)


_BLOCKS = f"""pieces AS (SELECT doc_id, regexp_extract_all({sql.strip('text')}, '{sql.WORD}') AS w FROM documents),
blocks AS (SELECT doc_id, b AS block_no, w[b * {BLOCK} + 1:(b + 1) * {BLOCK}] AS block
  FROM pieces, unnest(range(0, (len(w) + {BLOCK - 1}) // {BLOCK})) AS r(b))"""


@query("A12", f"""WITH {_BLOCKS} SELECT doc_id, block_no::INTEGER AS block_no, len(block)::INTEGER AS n_tok,
array_to_string(block, ' ') AS block FROM blocks""")
def token_blocks(spark, sf):
    rows = ev.text_blocks(texts(spark, sf, "doc_id", "text"), ["doc_id"], BLOCK)
    return rows.select("doc_id", "block_no", F.size("block").alias("n_tok"), F.array_join("block", " ").alias("block"))


_LOSSES = f"""train AS (SELECT regexp_extract_all(text, '{sql.WORD}') AS w FROM documents),
bigrams AS (SELECT w[i] AS l, w[i + 1] AS r, count(*) AS c FROM train, unnest(range(1, len(w))) AS x(i) GROUP BY 1, 2),
lefts AS (SELECT l, sum(c) AS n FROM bigrams GROUP BY l),
types AS (SELECT count(*) AS v FROM (SELECT l FROM bigrams UNION SELECT r FROM bigrams)),
evals AS (SELECT item_id, regexp_extract_all({sql.strip('text')}, '{sql.WORD}') AS w FROM benchmark),
eblocks AS (SELECT item_id, b AS block_no, w[b * {BLOCK} + 1:(b + 1) * {BLOCK}] AS block
  FROM evals, unnest(range(0, (len(w) + {BLOCK - 1}) // {BLOCK})) AS r(b)),
preds AS (SELECT item_id, block_no, block[i] AS l, block[i + 1] AS r FROM eblocks, unnest(range(1, len(block))) AS x(i)),
losses AS (SELECT item_id, block_no::INTEGER AS block_no, count(*) + 1 AS n_tok,
  avg(-ln((coalesce(b.c, 0) + 1) / (coalesce(f.n, 0) + 1.0::DOUBLE * (SELECT v FROM types)))) AS loss
  FROM preds p LEFT JOIN bigrams b ON p.l = b.l AND p.r = b.r LEFT JOIN lefts f ON p.l = f.l GROUP BY 1, 2)"""


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """Bigram model of the documents, evaluated on the benchmark items."""
    bigrams = freeze(ev.bigram_counts(texts(spark, sf, "text"), tx.tokens(F.col("text"))), "bigrams")
    items = readers.evaluation_set(table(spark, sf, "benchmark"), ["item_id"])
    return ev.block_losses(ev.text_blocks(items, ["item_id"], BLOCK), bigrams, ["item_id"])


@query("A14 S11", f"WITH {_LOSSES} SELECT item_id, block_no, n_tok, round(loss, 6) AS loss FROM losses")
def bigram_block_loss(spark, sf):
    return losses(spark, sf).withColumn("loss", F.round("loss", 6))


@query("A13", f"""WITH {_LOSSES} SELECT sum(n_tok - 1)::BIGINT AS predicted_tokens,
round(exp(sum(loss * (n_tok - 1)) / sum(n_tok - 1)), 6) AS perplexity FROM losses""")
def perplexity(spark, sf):
    return ev.perplexity(losses(spark, sf)).withColumn("perplexity", F.round("perplexity", 6))


@query("A13", f"""WITH {_LOSSES} SELECT item_id, sum(n_tok - 1)::BIGINT AS predicted_tokens,
round(exp(sum(loss * (n_tok - 1)) / sum(n_tok - 1)), 6) AS perplexity FROM losses GROUP BY item_id""")
def perplexity_per_item(spark, sf):
    return ev.perplexity(losses(spark, sf), ["item_id"]).withColumn("perplexity", F.round("perplexity", 6))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Timed runs: seconds, tokens in and out, from the events."""
    out = F.pmod("event_id", F.lit(200))
    return table(spark, sf, "events").select(
        "event_id", "event_type", F.col("value").alias("sec"), ev.new_tokens(F.col("user_id"), out).alias("new_tokens"))


@query("A16", "SELECT event_id, greatest(0, event_id % 200 - user_id) AS new_tokens FROM events")
def new_token_counts(spark, sf):
    return runs(spark, sf).select("event_id", "new_tokens")


_RUNS = """runs AS (SELECT event_id, event_type, value AS sec, greatest(0, event_id % 200 - user_id) AS new_tokens,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS o FROM events)"""


@query("A17", f"WITH {_RUNS} SELECT event_type, event_id, sec FROM runs WHERE o > {WARMUP}")
def measured_runs(spark, sf):
    return ev.measured_runs(runs(spark, sf), WARMUP, ["event_id"], ["event_type"]).select("event_type", "event_id", "sec")


@query("A15 A16 A17", f"""WITH {_RUNS} SELECT event_type, count(*) AS runs, round(avg(sec), 6) AS avg_latency_s,
round(avg(CASE WHEN sec > 0 THEN new_tokens / sec ELSE 0 END), 6) AS avg_tokens_per_s FROM runs WHERE o > {WARMUP} GROUP BY event_type""")
def latency_summary(spark, sf):
    rows = ev.latency_summary(ev.measured_runs(runs(spark, sf), WARMUP, ["event_id"], ["event_type"]), ["event_type"])
    return rows.withColumns({c: F.round(c, 6) for c in ("avg_latency_s", "avg_tokens_per_s")})
