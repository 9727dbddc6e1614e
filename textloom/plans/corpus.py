"""Corpus jobs: weighted mix, quality subset, interleaved text lines.

Each job first writes a narrow table of counts (source, key, n), decides on it
which ordered prefix of every source is taken, and only then touches the texts
again: admitted rows are recognised where they are read, by their source's last
admitted key, and go straight to their shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import metadata, text as tx
from textloom.operators import budget, mix as mx, ordered, shards
from textloom.operators.interleave import interleave
from textloom.sources.readers import spread
from textloom.sources.registry import clean_documents, tag_sources
from textloom.workspace import freeze

Counter = Callable[[Column], Column]
STEPS = 64


@dataclass(frozen=True)
class Corpus:
    """``admitted``: narrow stored table (source, keys, n_tok, running);
    ``bounds``: last key of every full shard; ``documents``: the text rows;
    ``order_by``: the key columns."""

    admitted: DataFrame
    bounds: DataFrame
    documents: DataFrame
    order_by: tuple[str, ...]

    def sharded_counts(self) -> DataFrame:
        return shards.assign_shards(self.admitted, self.bounds, self.order_by)

    def shard_sizes(self) -> DataFrame:
        """Rows and tokens of each shard, as ``publish_shards`` takes them."""
        return self.sharded_counts().groupBy("source", "shard_id").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n_tok").alias("tokens"))

    def summary(self) -> DataFrame:
        return shards.shard_summary(self.sharded_counts())


def counts_until(rows: DataFrame, count: Callable[[DataFrame], DataFrame], budgets: dict[str, float],
                 order_by: Sequence[str]) -> DataFrame:
    """The stored counts of each source's rows up to a key where its budget is met. Sums only grow, so
    no row behind that key can be admitted. ``count`` makes ``(source, keys, n_tok)`` of rows.

    A first 64th of each source tells how many tokens its keys hold; the next range is chosen
    by that, and what is past half of the source is taken whole. Quantiles of the first key
    cut the ranges, and each range filters the scan. Keys that are not numbers are
    counted in one go, as are sources without quantiles."""
    key = order_by[0]
    if not isinstance(rows.schema[key].dataType, T.NumericType):
        return freeze(count(rows), "counts")
    marks = [i / STEPS for i in range(1, STEPS)]
    edges = {r[0]: r[1] or [] for r in rows.where(F.col("source").isin(list(budgets))).groupBy("source").agg(
        F.percentile_approx(key, marks, 1000)).collect()}
    totals, upto, rows_of = dict.fromkeys(edges, 0), dict.fromkeys(edges, 0), dict.fromkeys(edges, 0)
    goal = {s: 1 if e else STEPS for s, e in edges.items()}
    parts: list[DataFrame] = []
    while goal:
        ranges = []
        for source, end in goal.items():
            inside = F.col("source") == source
            if upto[source]:
                inside &= F.col(key) > edges[source][upto[source] - 1]
            if end < STEPS:
                low = F.col(key) <= edges[source][end - 1]
                inside &= low if upto[source] else low | F.col(key).isNull()
            ranges.append(inside)
        parts.append(freeze(count(rows.where(reduce(or_, ranges))), "counts"))
        sums = {r[0]: r[1:] for r in parts[-1].groupBy("source").agg(F.sum("n_tok"), F.count(F.lit(1))).collect()}
        for source, end in list(goal.items()):
            tokens, found = sums.get(source, (0, 0))
            totals[source] += tokens or 0
            rows_of[source] += found
            upto[source] = end
            # One row at least: a rule may take the first whatever its budget.
            if totals[source] >= budgets[source] and rows_of[source] or end == STEPS:
                del goal[source]
                continue
            need = math.ceil(1.25 * end * budgets[source] / totals[source]) if totals[source] else STEPS
            goal[source] = max(2 * end, need) if max(2 * end, need) <= STEPS // 2 else STEPS
    return reduce(DataFrame.unionByName, parts) if parts else freeze(count(rows), "counts")


def has_tokens(text: Column, counter: Counter) -> Column:
    """Texts to which the counter gives a token; for words and punctuation a search tells it without a count."""
    return text.rlike(tx.WORD) if counter is tx.count_tokens else counter(text) > 0


def _bounds(admitted: DataFrame, shard_tokens: int, order_by: Sequence[str], mode: str) -> DataFrame:
    if mode == "greedy":
        return freeze(shards.greedy_bounds(admitted, shard_tokens, order_by), "bounds")
    if mode == "uniform":
        return freeze(shards.last_keys(shards.uniform_shards(admitted, shard_tokens), order_by), "bounds")
    raise ValueError(f"shard mode: {mode}")


def mixed_corpus(
    docs: DataFrame,
    registry: DataFrame,
    mix: str,
    total_tokens: float | Callable[[DataFrame], float] = 9e9,
    shard_tokens: int = 100_000_000,
    order_by: Sequence[str] = ("doc_id",),
    min_chars: int = tx.MIN_CHARS,
    counter: Counter = tx.count_tokens,
    shard_mode: str = "greedy",
    rows_per_cell: int = ordered.ROWS_PER_CELL,
) -> Corpus:
    """Sample every source of the mix up to its token budget and shard it.

    ``docs`` has ``source``, the key columns and ``text``. ``total_tokens`` may
    be a function of the stored counts table."""
    spark = docs.sparkSession
    weights = freeze(mx.parse_mix(spark, mix, registry), "mix")
    wanted = spread(docs).join(F.broadcast(weights.select(F.col("source_key").alias("source"))), "source", "left_semi")
    tagged = tag_sources(wanted, registry).withColumn("lang", F.col("source_lang"))
    used = {r[0] for r in registry.select("cleaner").distinct().collect()}
    raw = tagged.select("source", *order_by, "text", "lang", "cleaner")

    def count(rows: DataFrame) -> DataFrame:
        return clean_documents(rows, min_chars, used).select("source", *order_by, counter(F.col("text")).alias("n_tok"))

    if callable(total_tokens):
        counts = freeze(count(raw), "counts")
        budgets = mx.token_budgets(weights, total_tokens(counts))
    else:
        budgets = mx.token_budgets(weights, total_tokens)
        counts = counts_until(raw, count, {r.source_key: r.budget for r in budgets.collect()}, order_by)
    admitted = freeze(
        budget.admit_capped(mx.attach_budgets(counts, budgets), F.col("budget"), order_by,
                            rows_per_cell=rows_per_cell).drop("budget"), "admitted")
    bounds = _bounds(admitted, shard_tokens, order_by, shard_mode)
    cutoffs = freeze(ordered.key_cutoffs(admitted, order_by, ["source"]), "cutoffs")
    near = clean_documents(ordered.take_prefix(raw, cutoffs, order_by, ["source"]), min_chars, used)
    documents = shards.assign_shards(near.where(has_tokens(F.col("text"), counter)), bounds, order_by)
    return Corpus(admitted, bounds, documents, tuple(order_by))


def quality_subset(
    crawl: DataFrame,
    target_tokens: float | Callable[[DataFrame], float] = 3e9,
    shard_tokens: int = 100_000_000,
    order_by: Sequence[str] = ("doc_id",),
    source: str = "crawl",
    counter: Counter = tx.count_tokens,
    max_ppl: float = tx.MAX_PERPLEXITY,
    on_missing: str = "drop",
    shard_mode: str = "greedy",
    rows_per_cell: int = ordered.ROWS_PER_CELL,
) -> Corpus:
    """Web-crawl rows that pass the quality filter, raw text kept, up to the row
    that reaches the target. ``crawl`` has ``raw_content, meta, quality_signals``."""
    fields = {f.name: f.dataType for f in crawl.schema}
    good = spread(crawl).where(metadata.accept(
        F.col("raw_content"), metadata.perplexity(F.col("quality_signals")),
        max_ppl=max_ppl, on_missing=on_missing,
    )).select(F.lit(source).alias("source"), *order_by, F.col("raw_content").alias("text"),
              metadata.language(F.col("meta"), fields["meta"]).alias("lang"))

    def count(rows: DataFrame) -> DataFrame:
        return rows.select("source", *order_by, counter(F.col("text")).alias("n_tok"))

    if callable(target_tokens):
        counts = freeze(count(good), "counts")
        target = target_tokens(counts)
    else:
        target = target_tokens
        counts = counts_until(good, count, {source: target}, order_by)
    admitted = freeze(
        budget.admit_crossing(counts, F.lit(float(target)), order_by, ["source"],
                              rows_per_cell=rows_per_cell), "admitted")
    bounds = _bounds(admitted, shard_tokens, order_by, shard_mode)
    cutoffs = freeze(ordered.key_cutoffs(admitted, order_by, ["source"]), "cutoffs")
    documents = shards.assign_shards(
        ordered.take_prefix(good, cutoffs, order_by, ["source"]), bounds, order_by)
    return Corpus(admitted, bounds, documents, tuple(order_by))


def line_corpus(
    docs: DataFrame,
    max_bytes: int | None = 100 * 1024 * 1024,
    max_lines: int | None = None,
    order_by: str = "doc_id",
    source_ordinal: str = "ordinal",
    rows_per_cell: int = ordered.ROWS_PER_CELL,
) -> DataFrame:
    """Interleave the sources and take one line per document up to a byte budget
    or, when ``max_lines`` is set, a line budget. Returns ``(line_no, line)``.

    ``docs`` has ``source``, its ordinal, the key and ``text``."""
    lined = docs.withColumn("line", tx.flatten_lines(F.col("text")))
    turns = interleave(
        lined.select("source", source_ordinal, order_by, tx.line_bytes(F.col("line")).alias("n_bytes"),
                     (F.col("line") == "").alias("blank")),
        order_by, source_ordinal, rows_per_cell)
    turns = freeze(turns.where(~F.col("blank")), "turns")
    place = ["turn", source_ordinal]
    if max_lines:
        taken = ordered.ordinals(turns, place, name="line_no", rows_per_cell=rows_per_cell).where(
            F.col("line_no") <= max_lines)
    else:
        numbered = ordered.running_totals(
            turns, place, {"line_no": F.lit(1).cast("bigint"), "running": F.col("n_bytes")},
            rows_per_cell=rows_per_cell)
        taken = numbered.where(F.col("running") - F.col("n_bytes") < max_bytes) if max_bytes else numbered
    taken = freeze(taken.select("source", order_by, "line_no"), "lines")
    cutoffs = freeze(ordered.key_cutoffs(taken, [order_by], ["source"]), "cutoffs")
    near = ordered.take_prefix(lined, cutoffs, [order_by], ["source"])
    return near.join(taken, ["source", order_by]).select("line_no", "line")
