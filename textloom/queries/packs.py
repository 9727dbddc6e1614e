"""Packed rows, epoch orders, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import epochs, pack, vocab
from textloom.plans.packing import packed_rows as pack_documents
from textloom.queries import fragments as sql
from textloom.queries.registry import query, table
from textloom.queries.tokens import vocabulary
from textloom.sources import readers, sinks
from textloom.workspace import freeze, new_path

L, ROWS_PER_SHARD = sql.SEQ_LEN, sql.ROWS_PER_SHARD
SHARDS_A_FILE = sinks.together(L * ROWS_PER_SHARD)
SEED, EPOCH, WORKERS, BATCH = 42, 3, 4, 16


def packs(spark: SparkSession, sf: str, docs: DataFrame | None = None, **options) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text") if docs is None else docs
    return pack_documents(rows, vocabulary(spark, sf), seq_len=L, shard_tokens=L * ROWS_PER_SHARD, **options)


def shown(rows: DataFrame) -> DataFrame:
    """Arrays as text, for comparison."""
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ")
                             for c in ("input_ids", "attention_mask")})


@query("P3 P4 P5 P6 N6", f"WITH {sql.PACKED} SELECT row_idx, shard_id, input_ids, attention_mask FROM packed")
def packed_rows(spark, sf):
    return shown(packs(spark, sf)).select("row_idx", "shard_id", "input_ids", "attention_mask")


_CAPPED = sql.PACKED.replace("picked AS (SELECT doc_id FROM documents)", """picked AS (
  SELECT doc_id FROM documents WHERE lang <> 'es' ORDER BY doc_id LIMIT (SELECT count(*) // 2 FROM documents))""")


@query("P1 P2 P3 P4", f"WITH {_CAPPED} SELECT row_idx, shard_id, input_ids, attention_mask FROM packed")
def packed_rows_capped(spark, sf):
    docs = table(spark, sf, "documents")
    holes = docs.select("doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("text"))
    rows = packs(spark, sf, holes, max_rows=docs.count() // 2)
    return shown(rows).select("row_idx", "shard_id", "input_ids", "attention_mask")


@query("P7", f"""WITH {sql.PACKED} SELECT shard_id, count(*) AS rows, 0::BIGINT AS bad_length, 0::BIGINT AS mask_mismatch,
min(CASE WHEN n < {L} THEN 0 ELSE lo END)::INTEGER AS min_id, max(hi)::INTEGER AS max_id,
sum(n)::BIGINT AS tokens, sum({L} - n)::BIGINT AS pads FROM packed GROUP BY shard_id""")
def packed_audit(spark, sf):
    return pack.audit(packs(spark, sf), L)


@query("P8", f"""WITH {sql.PACKED} SELECT shard_id, count(*) AS rows, round(sum(n) / (count(*) * {L}), 9) AS fill,
sum(ends)::BIGINT AS doc_ends FROM packed GROUP BY shard_id""")
def packed_efficiency(spark, sf):
    rows = pack.efficiency(packs(spark, sf), L, vocab.EOS_ID)
    return rows.withColumn("fill", F.round("fill", 9))


@query("N8", f"""WITH {sql.PACKED} SELECT 32000::BIGINT AS model_size, (SELECT count(*) + 5 FROM vocab) AS vocab_size,
(SELECT max(id) FROM vocab)::INTEGER AS max_vocab_id, (SELECT max(hi) FROM packed)::INTEGER AS max_used_id,
greatest(32000, (SELECT count(*) + 5 FROM vocab))::BIGINT AS needed_size, (SELECT count(*) + 5 FROM vocab) = 32000 AS matches""")
def vocabulary_size_check(spark, sf):
    return vocab.reconcile(vocabulary(spark, sf), packs(spark, sf), 32000)


@query("K2 S8 U2 L1", f"""WITH {sql.PACKED}, other AS (SELECT 1 AS root, row_idx, shard_id, input_ids FROM packed)
SELECT 0 AS root, row_idx, shard_id, input_ids FROM packed UNION ALL SELECT * FROM other""")
def packed_roots_read_back(spark, sf):
    rows = freeze(packs(spark, sf), "packed")
    roots = [new_path(spark, "pack-a"), new_path(spark, "pack-b")]
    for root in roots:
        sinks.write_packed(rows, root, shards_a_file=SHARDS_A_FILE)
    return shown(readers.read_packed(spark, *roots)).select("root", "row_idx", "shard_id", "input_ids")


@query("L1 S8 U2", f"""WITH {sql.PACKED}, other AS (SELECT 1 AS root, row_idx, shard_id, input_ids FROM packed WHERE row_idx % 3 > 0),
all_rows AS (SELECT 0 AS root, row_idx, shard_id, input_ids FROM packed UNION ALL SELECT * FROM other)
SELECT root, shard_id, row_idx, row_number() OVER (ORDER BY root, shard_id, row_idx) - 1 AS rank FROM all_rows""")
def packed_row_ranks(spark, sf):
    """Places of rows by the files of two roots; the second lacks every third row."""
    rows = freeze(packs(spark, sf), "packed")
    roots = [new_path(spark, "pack-a"), new_path(spark, "pack-b")]
    for root, some in zip(roots, (rows, rows.where("row_idx % 3 > 0"))):
        sinks.write_packed(some, root, shards_a_file=SHARDS_A_FILE)
    return readers.ranked_packed(spark, *roots).select("root", "shard_id", "row_idx", "rank")


def two_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The packed rows stored once and seen as two roots, the second with the odd rows only."""
    rows = freeze(packs(spark, sf), "packed")
    return rows.withColumn("root", F.lit(0)).unionByName(rows.where("row_idx % 2 = 1").withColumn("root", F.lit(1)))


_FILES = f"""roots AS (SELECT 0 AS root, * FROM packed UNION ALL SELECT 1, * FROM packed WHERE row_idx % 2 = 1),
files AS (SELECT root, shard_id, row_number() OVER (ORDER BY md5('{SEED + EPOCH}|' || root || '|' || shard_id), root, shard_id) - 1 AS file_rank
  FROM (SELECT DISTINCT root, shard_id FROM roots)),
split AS (SELECT root, shard_id, file_rank, file_rank % {WORKERS} AS worker, file_rank // {WORKERS} AS turn FROM files)"""


@query("E1 E2", f"WITH {sql.PACKED}, {_FILES} SELECT root, shard_id, file_rank, worker, turn FROM split")
def epoch_file_order(spark, sf):
    return epochs.file_order(two_roots(spark, sf), SEED, EPOCH, True, WORKERS)


@query("E3", f"""WITH {sql.PACKED}, {_FILES} SELECT root, shard_id, row_idx, row_number() OVER (PARTITION BY root, shard_id
  ORDER BY md5('{SEED + EPOCH}|' || root || '|' || shard_id || '|' || row_idx), row_idx) - 1 AS row_rank FROM roots""")
def epoch_row_order(spark, sf):
    return epochs.row_order(two_roots(spark, sf), SEED, EPOCH, True).select("root", "shard_id", "row_idx", "row_rank")


_SLOTS = f"""{_FILES}, slots AS (SELECT p.*, worker, row_number() OVER (PARTITION BY worker ORDER BY turn, row_idx) - 1 AS place
  FROM roots p JOIN split USING (root, shard_id))"""


@query("E4 E2", f"""WITH {sql.PACKED}, {_SLOTS}
SELECT worker, place // {BATCH} AS batch_no, (place % {BATCH})::INTEGER AS slot, root, row_idx FROM slots""")
def batch_slots(spark, sf):
    rows = epochs.batch_slots(two_roots(spark, sf), BATCH, WORKERS, SEED, EPOCH)
    return rows.select("worker", "batch_no", "slot", "root", "row_idx")


@query("E4 E5 E6", f"""WITH {sql.PACKED}, {_SLOTS}
SELECT worker, place // {BATCH} AS batch_no, count(*)::INTEGER AS rows, (count(*) * {L})::BIGINT AS batch_tokens,
({BATCH * L * WORKERS})::BIGINT AS tokens_per_step, 'array<array<bigint>>' AS kind,
string_agg(input_ids, '|' ORDER BY place) AS input_ids, string_agg(attention_mask, '|' ORDER BY place) AS attention_mask
FROM slots GROUP BY worker, place // {BATCH}""")
def micro_batches(spark, sf):
    stacked = epochs.batches(epochs.batch_slots(two_roots(spark, sf), BATCH, WORKERS, SEED, EPOCH))
    kind = stacked.schema["input_ids"].dataType.simpleString()
    text = {c: F.array_join(F.transform(c, lambda r: F.array_join(r.cast("array<string>"), " ")), "|")
            for c in ("input_ids", "attention_mask")}
    return stacked.select(
        "worker", "batch_no", F.size("input_ids").alias("rows"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda acc, r: acc + F.size(r)).alias("batch_tokens"),
        F.lit(epochs.tokens_per_step(BATCH, L, WORKERS)).cast("bigint").alias("tokens_per_step"),
        F.lit(kind).alias("kind"), *[e.alias(c) for c, e in text.items()])
