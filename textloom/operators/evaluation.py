"""Perplexity, diversity and latency aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import ngrams as ng, text as tx
from textloom.operators import ordered

SALTS = 16
TASKS_PER_SPLIT = 8


def text_blocks(texts: DataFrame, key: Sequence[str], block_size: int, tokens: Column | None = None) -> DataFrame:
    """``(key, block_no, block)``: tokens of each non-blank text cut into blocks."""
    words = tx.tokens(tx.strip(F.col("text"))) if tokens is None else tokens
    split = texts.where(tx.strip(F.col("text")) != "").select(*key, words.alias("_words"))
    return split.select(*key, F.posexplode(ng.blocks(F.col("_words"), block_size)).alias("block_no", "block"))


def bigram_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """How often a token follows another, counted map-side first."""
    return _pairs(docs.select(tokens.alias("block")), []).groupBy("left", "right").agg(
        F.count(F.lit(1)).alias("pair_count"))


def _pairs(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    length = F.size("block") - 1
    both = F.arrays_zip(F.slice("block", F.lit(1), length).alias("left"),
                        F.slice("block", F.lit(2), length).alias("right"))
    return blocks.where(F.size("block") > 1).select(*key, F.explode(both).alias("p")).select(
        *key, F.col("p.left").alias("left"), F.col("p.right").alias("right"))


def block_losses(blocks: DataFrame, bigrams: DataFrame, key: Sequence[str], add_k: float = 1.0) -> DataFrame:
    """Mean negative log probability of each block under a bigram model with
    add-k smoothing: ``(key, block_no, n_tok, loss)``. Blocks of one token have
    nothing to predict and are left out. ``bigrams`` is a stored table. A context that
    many blocks have is spread over ``SALTS`` partitions by the token after it."""
    place = [*key, "block_no"]
    contexts = bigrams.groupBy("left").agg(F.sum("pair_count").alias("left_count"))
    types = bigrams.select(F.col("left").alias("t")).unionByName(bigrams.select(F.col("right").alias("t")))
    vocabulary = types.distinct().count()
    seen = _pairs(blocks, place).groupBy(*place, "left", "right").agg(F.count(F.lit(1)).alias("times"))
    salted = seen.withColumn("_salt", F.pmod(F.xxhash64("right"), F.lit(SALTS)).cast("int"))
    scored = salted.join(bigrams, ["left", "right"], "left").join(
        ordered.with_salts(contexts, SALTS), ["left", "_salt"], "left")
    p = (F.coalesce("pair_count", F.lit(0)) + add_k) / (F.coalesce("left_count", F.lit(0)) + add_k * vocabulary)
    return scored.groupBy(*place).agg(
        (F.sum("times") + 1).alias("n_tok"),
        (F.sum(-F.log(p) * F.col("times")) / F.sum("times")).alias("loss"))


def perplexity(losses: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """``exp`` of the loss per predicted token; infinite when there is none."""
    predicted = F.col("n_tok") - 1
    usable = F.when(F.col("n_tok") >= 2, predicted).otherwise(0)
    total, nll = F.coalesce(F.sum(usable), F.lit(0)), F.sum(F.when(F.col("n_tok") >= 2, F.col("loss") * predicted))
    value = F.when(total == 0, F.lit(float("inf"))).otherwise(F.exp(nll / total))
    return losses.groupBy(*group_by).agg(total.alias("predicted_tokens"), value.alias("perplexity"))


def diversity(records: DataFrame, text: str = "output") -> DataFrame:
    """Add ``distinct_1`` and ``distinct_2`` of each generated text."""
    words = tx.split_words(F.col(text))
    return records.withColumn("_words", words).withColumns({
        "distinct_1": ng.distinct_ratio(F.col("_words"), 1),
        "distinct_2": ng.distinct_ratio(F.col("_words"), 2),
    }).drop("_words")


def corpus_distinct(texts: DataFrame, n: int, group_by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """n-grams and different n-grams over all texts of a group. Texts are dealt to ``TASKS_PER_SPLIT`` times as many tasks as they have
    splits: most n-grams are rare, and those of a whole split do not fit the memory of the map-side count, which then sorts on disk."""
    words = texts.repartition(TASKS_PER_SPLIT * max(1, texts.rdd.getNumPartitions())).select(*group_by, tx.split_words(F.col(text)).alias("_words"))
    grams = words.select(*group_by, F.explode(ng.ngrams(F.col("_words"), n)).alias("gram"))
    counted = grams.groupBy(*group_by, "gram").agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy(*group_by).agg(
        F.sum("times").alias("ngrams"), F.count(F.lit(1)).alias("distinct_ngrams"),
        (F.count(F.lit(1)) / F.sum("times")).alias("ratio"))


def new_tokens(tokens_in: Column, tokens_out: Column) -> Column:
    """Generated tokens, never negative."""
    return F.greatest(F.lit(0), tokens_out - tokens_in)


def measured_runs(runs: DataFrame, warmup: int, order_by: Sequence[str], group_by: Sequence[str],
                  rows_per_cell: int = ordered.ROWS_PER_CELL) -> DataFrame:
    """Runs after the first ``warmup`` of each group."""
    if warmup <= 0:
        return runs
    return ordered.ordinals(runs, order_by, group_by, "_ord", rows_per_cell).where(
        F.col("_ord") > warmup).drop("_ord")


def latency_summary(runs: DataFrame, group_by: Sequence[str], seconds: str = "sec",
                    tokens: str = "new_tokens") -> DataFrame:
    """Mean latency and the mean of each run's tokens per second (0 for a run
    that took no time)."""
    rate = F.when(F.col(seconds) > 0, F.col(tokens) / F.col(seconds)).otherwise(0.0)
    return runs.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("avg_latency_s"), F.avg(rate).alias("avg_tokens_per_s"))
