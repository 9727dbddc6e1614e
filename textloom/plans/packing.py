"""Text shards to packed training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import encode as enc, ordered, pack
from textloom.operators.vocab import EOS_ID
from textloom.sources.readers import spread
from textloom.workspace import freeze


def packed_rows(
    docs: DataFrame,
    model: enc.Model | DataFrame,
    order_by: Sequence[str] = ("doc_id",),
    seq_len: int = 2048,
    shard_tokens: int = 50_000_000,
    max_rows: int = 0,
    eos_id: int | None = EOS_ID,
    mask: str = "nonzero",
    text: str = "text",
    tokens_per_cell: int | None = None,
) -> DataFrame:
    """Encode, append the end token, concatenate, cut, shard. NULL texts are
    skipped; ``max_rows`` takes only the first documents. ``model`` may be a word
    vocabulary table. Encoding is the costly step: its result is stored once and
    read twice."""
    present = spread(docs).where(F.col(text).isNotNull())
    if max_rows > 0:
        present = ordered.prefix(present, max_rows, order_by)
    encoded = enc.encode_documents(present, model, order_by, F.col(text).cast("string"))
    encoded = encoded.withColumn("ids", enc.append_eos(F.col("ids"), eos_id))
    stored = freeze(encoded.withColumn("n", F.size("ids").cast("bigint")), "token-ids")
    rows = pack.pack_rows(stored, order_by, seq_len, tokens_per_cell=tokens_per_cell)
    return pack.finish_rows(rows, seq_len, shard_tokens, mask=mask)
