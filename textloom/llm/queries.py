"""The package's queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.benchmark_scan import contamination
from textloom.llm.best_fit import pack_documents
from textloom.llm.catalogue import RUNS, SQL, query, table  # noqa: F401
from textloom.llm.field_tokens import section_tokens
from textloom.llm.fingerprints import neighbour_fingerprints
from textloom.llm.hilbert import as_number, curve_shards
from textloom.llm.language_model import backoff_scores
from textloom.llm.near_dups import near_duplicates
from textloom.llm.spelling import MIN_COUNT, MIN_LENGTH, letter_runs, spelling_groups, without_letter
from textloom.llm.substrings import remove_repeats
from textloom.llm.token_files import read_token_files, write_token_files
from textloom.llm.toxicity import LIMIT, held_out, score_documents, train
from textloom.llm.url_rules import judge_urls
from textloom.llm.whitening import whiten
from textloom.workspace import new_path

SHARDS = 16
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The state of a CRC-32 after one more byte: ``s`` the state, ``b`` the byte; eight steps of the reflected polynomial.
CRC_STEP = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, step: xor(t >> 1, (t & 1) * 3988292384))"


@query(rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
patterns AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM sized, unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM patterns),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT doc_id, i, n, item FROM windows JOIN patterns USING (n, p)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against every window of the benchmark."""
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_key")



@query()
def op4_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 16 shards along a Hilbert curve over size, source and language."""
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "source", "lang")
    dims = {"size": F.col("size").cast("double"), "source": as_number(F.col("source"), "string"),
            "lang": as_number(F.col("lang"), "string")}
    return curve_shards(docs, "doc_id", dims, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


# The rules that the query's contract names.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("""
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
parts AS (
  SELECT row_number() OVER () AS row_no, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT row_no, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (row_no)
""")
def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's URL against the block and allow rules."""
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    return judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules)


@query()
def op8_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its next document."""
    return neighbour_fingerprints(table(spark, sf, "documents"))


@query()
def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as tokens in sequences of at most 1024."""
    return pack_documents(table(spark, sf, "documents"))


@query()
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's near-duplicate component."""
    return near_duplicates(table(spark, sf, "documents"))


@query(r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS p FROM docs, unnest(range(1, len(w) - 11)) AS t(i)),
firsts AS (SELECT p, min(doc_id) AS first_id FROM windows GROUP BY p),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN firsts USING (p) WHERE first_id < doc_id),
lost AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
       sha256(array_to_string([x FOR x, k IN w IF NOT list_contains(coalesce(ks, []), k)], ' ')) AS kept_sha256
FROM docs LEFT JOIN lost USING (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the windows that an earlier document has."""
    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


@query()
def op2_section_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of each document."""
    return section_tokens(table(spark, sf, "documents"))


@query(rf"""
WITH docs AS (
  SELECT doc_id, doc_id % 2 AS f, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (
  SELECT doc_id, f, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM docs, unnest(range(1, len(w) + 1)) AS t(i)),
totals AS (SELECT f, count(*) AS n FROM words GROUP BY f),
singles AS (SELECT x, f, count(*) AS c FROM words GROUP BY x, f),
pairs AS (SELECT u, x, f, count(*) AS c FROM words WHERE u IS NOT NULL GROUP BY u, x, f),
logs AS (
  SELECT t.doc_id, p.c IS NOT NULL AS found,
         CASE WHEN p.c IS NOT NULL THEN ln(p.c / a.c)
              ELSE CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END + ln(coalesce(b.c, 0.4) / n.n) END AS s
  FROM words t JOIN totals n ON n.f = 1 - t.f
  LEFT JOIN singles b ON b.x = t.x AND b.f = 1 - t.f
  LEFT JOIN singles a ON a.x = t.u AND a.f = 1 - t.f
  LEFT JOIN pairs p ON p.x = t.x AND p.u = t.u AND p.f = 1 - t.f)
SELECT doc_id, len(w) AS n_words, coalesce(n_found, 0) AS n_found, round(score, 6) AS score
FROM docs LEFT JOIN (SELECT doc_id, CAST(count(*) FILTER (found) AS BIGINT) AS n_found, avg(s) AS score FROM logs GROUP BY doc_id) USING (doc_id)
""")
def op6_backoff_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's mean log score under the counts of the other half of the documents."""
    return backoff_scores(table(spark, sf, "documents")).withColumn("score", F.round("score", 6))


@query(rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run FROM documents),
in_docs AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, count(*) AS c FROM runs GROUP BY ALL),
summed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode(k)), '..'), lambda b: ('0x' || b)::BIGINT)), lambda s, b: {CRC_STEP})) AS h FROM in_docs),
edited AS (
  SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                 ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND r = 1),
walk AS (
  SELECT word, word AS at, form AS ahead FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.ahead)
SELECT forms.word, form, walk.at AS root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word AND walk.ahead IS NULL
""")
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every frequent word, after the contract's deletions, with its more frequent near word."""
    docs = table(spark, sf, "documents")
    # Shorter runs cannot become words.
    runs = docs.select("doc_id", F.explode(letter_runs(F.col("text"), MIN_LENGTH)).alias("run"))
    drawn = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    word = F.when(F.col("h") % 199 == 0, without_letter(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    counts = runs.select("run", drawn.alias("h")).select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)
    return spelling_groups(counts)


@query()
def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids, written to packed files and read back from them."""
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), path)
    return read_token_files(spark, path)


@query()
def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable embedding along the leading principal components, with unit variance."""
    # An entry that is not finite, or has no long because it is 2^56 or more, becomes NULL, and the operator leaves its row out.
    longs = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.when(
        F.abs(c) < float(1 << 56), F.floor(c * 64) + F.lit(1000000).cast("bigint")))
    rows = table(spark, sf, "embeddings").select("vec_id", longs.alias("x"))
    return whiten(rows, "vec_id", "x").withColumn("deviation", F.col("deviation").try_cast("bigint"))
