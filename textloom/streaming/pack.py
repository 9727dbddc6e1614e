"""Packing over a stream: the unfinished row waits for the next micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import encode as enc, pack
from textloom.operators.vocab import EOS_ID
from textloom.streaming import state
from textloom.workspace import freeze

# Number of finished rows, and the ids (fewer than one row) left over.
STATE = "next_row bigint, rest array<int>"


def pack_batch(stored: DataFrame, before: DataFrame, seq_len: int,
               order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Full rows ``(row_idx, ids)`` of one micro-batch and the new state. The
    left-over ids go in front of the batch like a document of their own; they
    begin at a row border, so positions need no shift within the row."""
    types = {f.name: f.dataType for f in stored.schema}
    carried = before.where(F.size("rest") > 0).select(
        F.lit(0).alias("_late"), *[F.lit(0).cast(types[k]).alias(k) for k in order_by],
        F.col("rest").alias("ids"), F.size("rest").cast("bigint").alias("n"))
    line = carried.unionByName(stored.select(F.lit(1).alias("_late"), *order_by, "ids", "n"))
    rows = freeze(pack.pack_rows(line, ["_late", *order_by], seq_len), "rows")
    old = before.first()
    full = rows.where(F.size("ids") == seq_len)
    rest = rows.where(F.size("ids") < seq_len).select("ids").first()
    # One row of bounded size: fewer ids than a packed row.
    after = stored.sparkSession.createDataFrame(
        [(old["next_row"] + full.count(), rest["ids"] if rest else [])], STATE)
    return full.withColumn("row_idx", F.col("row_idx") + F.lit(old["next_row"])), after


def packed_stream(docs: DataFrame, model: enc.Model | DataFrame, out_dir: str, state_dir: str, checkpoint: str,
                  seq_len: int, shard_tokens: int, order_by: Sequence[str],
                  eos_id: int | None = EOS_ID) -> StreamingQuery:
    """Pack everything that has arrived; full rows go to ``out_dir/batch_id=n``."""
    empty = docs.sparkSession.createDataFrame([(0, [])], STATE)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        present = batch.where(F.col("text").isNotNull())
        present = enc.encode_documents(present, model, order_by, F.col("text")).withColumn(
            "ids", enc.append_eos(F.col("ids"), eos_id))
        stored = freeze(present.withColumn("n", F.size("ids").cast("bigint")), "token-ids")
        full, after = pack_batch(stored, state.load(spark, state_dir, batch_id, empty), seq_len, order_by)
        state.store(pack.finish_rows(full, seq_len, shard_tokens, final=False), out_dir, batch_id)
        state.store(after, state_dir, batch_id)

    return state.drain(docs.writeStream.foreachBatch(each), checkpoint)


def finish_stream(spark: SparkSession, state_dir: str, seq_len: int, shard_tokens: int) -> DataFrame:
    """The last row, by the tail rule, once no more documents will come."""
    rest = state.latest(spark, state_dir, STATE).where(F.size("rest") > 0)
    return pack.finish_rows(rest.select(F.col("next_row").alias("row_idx"), F.col("rest").alias("ids")),
                            seq_len, shard_tokens)
