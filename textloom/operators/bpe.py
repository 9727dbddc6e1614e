"""Byte-pair vocabulary from a word-frequency table, as an iterative Spark job.

A word is kept as a string with one code point per symbol (``BASE + id``), so sorting pairs as
strings sorts them by their two ids. Pairs are ranked by count, ties to the smaller pair.

Merging changes few words and few counts, so a round works on differences:

* ``counts``: one row per pair that is frequent enough, kept by adding what the changed words lose and gain;
* the words are an index by their *best-ranked pair*. No later pair of a word can outrank it: counts only fall, and a pair with
  a new symbol is at most as frequent as the old pair in its place, with a larger id. A word that is read is written
  again under its new best pair, behind all ranks read so far, so the index is read once from top to bottom and
  older entries need no deletion.

A round takes the ``k`` top pairs. Their words are cut into *segments*, the longest runs in which every neighbouring pair is
one of the ``k``, and equal segments are added up. Whatever happens to a pair of these ranks happens inside segments, so
the driver merges there, one pair after the other, until the best pair ranks behind the ``k``. This is exact; ``k`` is
halved when the distinct segments have more than ``SEGMENT_SYMBOLS`` symbols, so what the driver holds is bounded.

Symbols that spell a token do so by the same merges everywhere, so a merge gives a new token with a larger id. The exception is a
merge that spells a special token: its small id breaks the order of ranks, so the round ends there, and counts and index are built anew.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.vocab import FIRST_ID, SPECIAL_TOKENS, UNK_ID
from textloom.workspace import Tables, freeze

BASE = 0x10000
TOP_PAIRS = 256
MOST_PAIRS = 1 << 16
SEGMENT_SYMBOLS = 1 << 20


def _symbol(token_id: int) -> str:
    return chr(BASE + token_id)


def merge_symbols(parts: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the pair of the least rank, the leftmost first, until no pair has a rank; ``ranks`` maps pairs to ``(rank, result)``."""
    parts = list(parts)
    # A chain of symbols and a heap of mergeable pairs by rank, then place:
    # n log n for a word of n letters.
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (found := ranks.get((parts[i], parts[j]))):
            heappush(heap, (found[0], i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if parts[i] != left or j >= len(parts) or parts[j] != right:
            continue  # merged with another symbol meanwhile
        parts[i], parts[j] = ranks[(left, right)][1], -1
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p >= 0]


@dataclass
class BpeModel:
    """Vocabulary (token by id) and merges ``(left, right, result)`` by rank."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]
    ranks: dict[tuple[int, int], tuple[int, int]] = field(init=False, repr=False)
    ids: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.ranks = {}
        for rank, (a, b, c) in enumerate(self.merges):
            self.ranks[(a, b)] = (rank, c)

    def encode_word(self, word: str) -> list[int]:
        """Merge the best-ranked pair until none is left; unknown characters
        stay one unknown token each."""
        if word in SPECIAL_TOKENS:
            return [self.ids[word]]
        parts = [self.ids.get(ch, UNK_ID) for ch in word]
        return merge_symbols(parts, self.ranks)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, a, b, c) for r, (a, b, c) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, id_a int, id_b int, id_merged int")


def pair_counts(words: DataFrame, word: str = "word", freq: str = "freq") -> DataFrame:
    """Weighted count of neighbouring symbols, aggregated map-side first."""
    long = words.where(F.length(word) > 1)
    places = long.select(word, freq, F.explode(F.sequence(F.lit(1), F.length(word) - 1)).alias("_at"))
    return places.groupBy(F.substring(F.col(word), F.col("_at"), F.lit(2)).alias("pair")).agg(
        F.sum(freq).alias("pair_freq"))


def top_pairs(counts: DataFrame, k: int) -> DataFrame:
    """Most frequent pairs, ties to the smaller pair."""
    return counts.orderBy(F.desc("pair_freq"), "pair").limit(k)


def alphabet(words: DataFrame) -> list[str]:
    """All characters in code point order; at most as many as Unicode has."""
    chars = words.select(F.explode(F.array_distinct(F.regexp_extract_all(
        "word", F.lit("(?s)."), F.lit(0)))).alias("ch")).distinct()
    return [r["ch"] for r in chars.orderBy("ch").collect()]


class _Vocabulary:
    """Tokens and merges so far."""

    def __init__(self, letters: list[str], size: int, min_frequency: int):
        self.tokens = list(SPECIAL_TOKENS) + letters
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.merges: list[tuple[int, int, int]] = []
        self.size, self.min_frequency = size, min_frequency

    def full(self) -> bool:
        return len(self.tokens) >= self.size

    def merge(self, a: int, b: int) -> tuple[int, bool]:
        """The token of a pair, and whether it is a new one."""
        text = self.tokens[a] + self.tokens[b]
        new = text not in self.ids
        if new:
            self.ids[text] = len(self.tokens)
            self.tokens.append(text)
        self.merges.append((a, b, self.ids[text]))
        return self.ids[text], new


def merge_segments(segments: list[tuple[str, int]], vocabulary: _Vocabulary, last: tuple[int, int, int] | None) -> bool:
    """Merge the best pair of all segments, again and again, while it does not rank behind ``last`` (minus count and pair). True if
    that ended at a token that was there before, a special one."""
    parts = [[ord(ch) - BASE for ch in text] for text, _ in segments]
    freqs = [freq for _, freq in segments]
    counts: dict[tuple[int, int], int] = defaultdict(int)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for n, (own, freq) in enumerate(zip(parts, freqs)):
        for pair in zip(own, own[1:]):
            counts[pair] += freq
            holders[pair].add(n)
    heap = [(-count, *pair) for pair, count in counts.items()]
    heapify(heap)
    while heap and not vocabulary.full():
        best = heappop(heap)
        a, b = pair = best[1:]
        count = counts[pair]
        if count != -best[0]:  # it has lost some to other merges
            if count > 0:
                heappush(heap, (-count, a, b))
            continue
        if count < vocabulary.min_frequency or last is not None and best > last:
            break
        merged, new = vocabulary.merge(a, b)
        if not new:
            return True
        fresh = set()
        for n in holders.pop(pair):
            old, freq = parts[n], freqs[n]
            for p in zip(old, old[1:]):
                counts[p] -= freq
            own, i = [], 0
            while i < len(old):
                if old[i] == a and i + 1 < len(old) and old[i + 1] == b:
                    own.append(merged)
                    i += 2
                else:
                    own.append(old[i])
                    i += 1
            parts[n] = own
            for p in zip(own, own[1:]):
                counts[p] += freq
                if merged in p:
                    holders[p].add(n)
                    fresh.add(p)
        for p in fresh:
            heappush(heap, (-counts[p], *p))
    return False


#: Behind every frequent pair.
_ALL = (-1, chr(0x10FFFF))
_SET = "word string, freq bigint, neg bigint, pair string"


def _indexed(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``words`` under their best-ranked pair; those without a frequent pair stay under rank 0, behind all others."""
    pairs = words.select("word", "freq", F.explode_outer(F.when(F.length("word") > 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))))).alias("pair"))
    best = pairs.join(counts.select("pair", (-F.col("pair_freq")).alias("neg")), "pair", "left").groupBy("word").agg(
        F.first("freq").alias("freq"), F.min(F.when(F.col("neg").isNotNull(), F.struct("neg", "pair"))).alias("best"))
    return best.select("word", "freq", F.coalesce("best.neg", F.lit(0).cast("bigint")).alias("neg"),
                       F.coalesce("best.pair", F.lit("")).alias("pair")).sortWithinPartitions("neg", "pair")


def _between(words: DataFrame, after: tuple[int, str] | None, upto: tuple[int, str] | None) -> DataFrame:
    """Words whose best pair ranks behind ``after`` and not behind ``upto``; bounds on the count reach the scan."""
    if after is not None:
        words = words.where((F.col("neg") > after[0]) | (F.col("neg") == after[0]) & (F.col("pair") > after[1])).where(F.col("neg") >= after[0])
    if upto is not None:
        words = words.where((F.col("neg") < upto[0]) | (F.col("neg") == upto[0]) & (F.col("pair") <= upto[1])).where(F.col("neg") <= upto[0])
    return words


def _cut(batches: Iterator[pa.RecordBatch], heavy: set[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, freqs = [], []
        for word, freq in zip(batch.column("word").to_pylist(), batch.column("freq").to_pylist()):
            start = 0
            for i in range(1, len(word) + 1):
                if i == len(word) or word[i - 1:i + 1] not in heavy:
                    if i - start > 1:
                        texts.append(word[start:i])
                        freqs.append(freq)
                    start = i
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(freqs, pa.int64())], ["segment", "freq"])


def _apply(batches: Iterator[pa.RecordBatch], merges: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    ranks = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
    for batch in batches:
        words = batch.column("word").to_pylist()
        new = ["".join(map(_symbol, merge_symbols([ord(ch) - BASE for ch in word], ranks))) for word in words]
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(new, pa.string()), batch.column("freq")], ["old", "word", "freq"])


def induce(counts: DataFrame, vocab_size: int = 32000, min_frequency: int = 2, min_word_freq: int = 1,
           top: int = TOP_PAIRS, segment_symbols: int = SEGMENT_SYMBOLS) -> BpeModel:
    """Learn merges from ``counts (word, freq)`` until the vocabulary is full or
    no pair is frequent enough. ``min_word_freq`` above 1 leaves rare words out,
    which is an approximation and off by default. ``top`` pairs are looked at in the first round."""
    spark = counts.sparkSession
    tables = Tables(spark)
    source = counts.where(F.col("freq") >= min_word_freq) if min_word_freq > 1 else counts
    source = tables.freeze(source.select("word", F.col("freq").cast("bigint").alias("freq")), "bpe-source")
    letters = alphabet(source)
    vocabulary = _Vocabulary(letters, vocab_size, min_frequency)
    coded = F.translate("word", "".join(letters), "".join(_symbol(FIRST_ID + i) for i in range(len(letters))))
    words = source.select(coded.alias("word"), "freq").where(F.length("word") > 1)

    def frequent(counted: DataFrame) -> DataFrame:
        return tables.freeze(counted.where(F.col("pair_freq") >= min_frequency), "bpe-pairs")

    def index_of(new: DataFrame) -> str:
        tables.freeze(_indexed(new, pairs), "bpe-words")
        return tables.paths[-1]

    pairs = frequent(pair_counts(words))
    index, done = [index_of(words)], None
    while not vocabulary.full():
        of_round = [p for p in tables.paths if p not in index]  # replaced by this round's
        ranked = top_pairs(pairs, top).collect()
        if not ranked:
            break
        rest = len(ranked) == top
        upto = (-ranked[-1]["pair_freq"], ranked[-1]["pair"]) if rest else _ALL
        everything = spark.read.schema(_SET).parquet(*index)
        touched = _between(everything, done, upto)
        heavy = {r["pair"] for r in ranked}
        segments = tables.freeze(touched.select("word", "freq").mapInArrow(lambda batches: _cut(batches, heavy), "segment string, freq bigint")
                                 .groupBy("segment").agg(F.sum("freq").alias("freq")), "bpe-segments")
        size = segments.agg(F.sum(F.length("segment"))).first()[0]
        if size > segment_symbols and top > 1:
            top = max(1, min(top, len(ranked)) // 2)
            continue
        begun, rows = len(vocabulary.merges), segments.toArrow()
        again = merge_segments(list(zip(rows["segment"].to_pylist(), rows["freq"].to_pylist())), vocabulary,
                               (upto[0], *(ord(ch) - BASE for ch in upto[1])) if rest else None)
        merges = vocabulary.merges[begun:]
        if vocabulary.full() or not rest and not again:
            break
        new = tables.freeze(touched.select("word", "freq").mapInArrow(
            lambda batches: _apply(batches, merges), "old string, word string, freq bigint"), "bpe-merged")
        if again:
            words = tables.freeze(_between(everything, upto, None).select("word", "freq").unionByName(new.select("word", "freq")), "bpe-merged")
            of_round, index = [*of_round, *index], []
            pairs, done = frequent(pair_counts(words)), None
            index = [index_of(words)]
        else:
            changed = new.where("old <> word")
            lost = pair_counts(changed.select(F.col("old").alias("word"), (-F.col("freq")).alias("freq")))
            gained = pair_counts(changed.select("word", "freq"))
            pairs = frequent(pairs.unionByName(lost).unionByName(gained).groupBy("pair").agg(F.sum("pair_freq").alias("pair_freq")))
            index, done = [*index, index_of(new.select("word", "freq"))], upto
        tables.drop(of_round)
        if size * 4 < segment_symbols:
            top = min((4 if size * 16 < segment_symbols else 2) * top, MOST_PAIRS)
    tables.drop()
    return BpeModel(vocabulary.tokens, vocabulary.merges)


def save(model: BpeModel, spark: SparkSession, path: str) -> None:
    """Vocabulary and merges as two small tables."""
    model.vocabulary(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.merge_table(spark).write.mode("overwrite").parquet(f"{path}/merges")


def load(spark: SparkSession, path: str) -> BpeModel:
    """A saved model; both tables are bounded by the vocabulary size."""
    tokens = spark.read.parquet(f"{path}/vocabulary").orderBy("id").toArrow()["token"].to_pylist()
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    return BpeModel(tokens, [(r["id_a"], r["id_b"], r["id_merged"]) for r in merges])
