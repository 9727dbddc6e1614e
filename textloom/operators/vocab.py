"""Word frequencies, word vocabulary and the special tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import ordered
from textloom.workspace import freeze

# Special tokens in id order; text that is not in the vocabulary
# becomes UNK, documents end with EOS.
SPECIAL_TOKENS = ("<unk>", "<pad>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
UNK_ID, PAD_ID, EOS_ID = 0, 1, 2
FIRST_ID = len(SPECIAL_TOKENS)


def special_tokens(spark: SparkSession) -> DataFrame:
    """The first rows of every vocabulary."""
    return spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "id int, token string")


def word_counts(docs: DataFrame, text: Column,
                split: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """How often each word or punctuation run occurs; counted map-side first, so
    a frequent word is a small number of partial counts."""
    return docs.select(F.explode(split(text)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("freq"))


def word_vocabulary(counts: DataFrame, rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Ids for whole words, most frequent first, ties by the word; the special
    tokens keep theirs."""
    ranked = freeze(counts.select("word", (-F.col("freq")).alias("_less")), "words")
    numbered = ordered.ordinals(ranked, ["_less", "word"], rows_per_cell=rows_per_cell)
    words = numbered.select((F.col("ord") + FIRST_ID - 1).cast("int").alias("id"), F.col("word").alias("token"))
    return freeze(special_tokens(counts.sparkSession).unionByName(words), "vocabulary")


def reconcile(vocabulary: DataFrame, packed: DataFrame, model_size: int) -> DataFrame:
    """Configured model size against the vocabulary and the ids in use."""
    have = vocabulary.agg(F.count(F.lit(1)).alias("vocab_size"), F.max("id").alias("max_vocab_id"))
    used = packed.agg(F.max(F.array_max("input_ids")).alias("max_used_id"))
    one = F.lit(1).alias("_one")
    return have.select("*", one).join(used.select("*", one), "_one").select(
        F.lit(model_size).cast("bigint").alias("model_size"), "vocab_size", "max_vocab_id", "max_used_id",
        F.greatest(F.lit(model_size).cast("bigint"), "vocab_size").alias("needed_size"),
        (F.col("vocab_size") == model_size).alias("matches"))
