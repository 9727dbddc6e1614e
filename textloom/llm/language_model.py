"""Stupid-backoff scores of documents from the n-gram counts of other documents.

The corpus is split in two folds by doc_id; each document is scored with the counts of the other fold, so
its own words do not vouch for it. With ``c`` the other fold's counts and ``N`` its words,

    S(w | u) = c(u w) / c(u)      if c(u w) > 0
             = a * S(w)           otherwise
    S(w)     = c(w) / N           if c(w) > 0, else a / N

and a document's score is the mean logarithm of its words' S; the first word has no context.

1. Word counts are pre-aggregated in tasks and summed by hash. Only words of both folds can be found in the other
   fold; the table of those is broadcast while it has at most ``MOST_WORDS`` rows, else it is joined to the exploded words.
2. Pairs of the ``FREQUENT`` most frequent words are counted in a dense table (``FREQUENT`` squared entries
   at most) and scored where they are read. A pair is no more frequent than its rarer word, so
   no pair that is left is hot.
3. All other pairs whose two words the other fold has are dealt out by hash, as packed columns: the numbers of both words by
   frequency if the tasks hold the words' table, else a digest and both counts. Each part counts its pairs in
   both folds and joins the counts back to the pairs by sorting; gains are summed per document and part, dealt out by document, and summed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.ragged import by_part, gathered
from textloom.llm.words import LOWER_BLANKS, find_words, mix, pieces
from textloom.workspace import freeze

BACKOFF = 0.4
MOST_WORDS = 6_000_000
FREQUENT = 512
PAIRS_PER_PART = 4_000_000
PAIRS_AT_ONCE = 1_000_000
_PAIRS = "part int, n int, row_key binary, first binary, second binary"


@dataclass(frozen=True)
class Lexicon:
    """Words of both folds by code; ``counts`` has a row per fold. ``rank`` is the place among the frequent words, else -1;
    ``number`` is 0 for the most frequent word and counts on, ``by_number`` the words in that order."""

    codes: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    totals: np.ndarray
    number: np.ndarray
    by_number: np.ndarray

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts in fold 0 and fold 1, the rank, and the number of each code; a word that is not held has the number 0."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), np.full(len(codes), -1), np.zeros(len(codes), np.int32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        return np.where(known, self.counts[0][at], 0), np.where(known, self.counts[1][at], 0), np.where(known, self.rank[at], -1), np.where(known, self.number[at], 0)


@dataclass
class Text:
    """All words of a batch, with what the other fold knows of them."""

    row: np.ndarray
    codes: np.ndarray
    fold: np.ndarray  # of each word
    count: np.ndarray  # in the other fold
    rank: np.ndarray
    first: np.ndarray
    number: np.ndarray | None = None  # in the held lexicon


def _texts(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Words with their counts, from the broadcast table or from the joined columns."""
    for batch in batches:
        if "codes" in batch.schema.names:
            listed = batch.column("codes")
            sizes = np.asarray(pc.list_value_length(listed))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            codes, c0, c1, rank = (np.asarray(batch.column(n).flatten()) for n in ("codes", "c0", "c1", "rank"))
            fold = np.asarray(batch.column("fold"))[row]
            yield batch, Text(row, codes.view(np.uint64), fold, np.where(fold == 0, c1, c0), rank, np.concatenate([[0], np.cumsum(sizes)]))
            continue
        for part in pieces(batch, "text"):
            words = find_words(part.column("text"), LOWER_BLANKS)
            row = words.text_of()
            c0, c1, rank, number = lexicon.find(words.codes)
            fold = np.asarray(part.column("fold"))[row]
            yield part, Text(row, words.codes, fold, np.where(fold == 0, c1, c0), rank, words.first, number)


def _pairs(t: Text) -> np.ndarray:
    """Places of second words whose pair may be in the other fold."""
    later = np.ones(len(t.codes), bool)
    later[t.first[:-1][np.diff(t.first) > 0]] = False
    at = np.flatnonzero(later)
    return at[(t.count[at] > 0) & (t.count[at - 1] > 0)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, counts = [], []
        for part in pieces(batch, "text"):
            words = find_words(part.column("text"), LOWER_BLANKS)
            fold = np.asarray(part.column("fold"))[words.text_of()]
            codes, number = np.unique(words.codes, return_inverse=True)
            seen.append(codes)
            counts.append(np.stack([np.bincount(number[fold == f], minlength=len(codes)) for f in (0, 1)]))
        if seen:
            codes, number = np.unique(np.concatenate(seen), return_inverse=True)
            both = [np.bincount(number, c, len(codes)).astype(np.int64) for c in np.concatenate(counts, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(both[0]), pa.array(both[1])], ["code", "c0", "c1"])


def _explode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = find_words(part.column("text"), LOWER_BLANKS)
            row = words.text_of()
            yield pa.RecordBatch.from_arrays([
                part.column("row_key").take(pa.array(row)), pa.array(np.arange(len(row)) - words.first[row]), pa.array(words.codes.view(np.int64)),
            ], ["row_key", "place", "code"])


def _count_frequent(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, frequent: int) -> Iterator[pa.RecordBatch]:
    for _, t in _texts(batches, lexicon):
        at = _pairs(t)
        at = at[(t.rank[at] >= 0) & (t.rank[at - 1] >= 0)]
        pair = (t.rank[at - 1] * frequent + t.rank[at]) * 2 + t.fold[at]
        keys, counts = np.unique(pair, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "n"])


def _logs(t: Text, at: np.ndarray, pair_count: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """What a found pair adds to its word's backed-off logarithm."""
    return _gain(pair_count, t.count[at - 1], t.count[at], totals[1 - t.fold[at]])


def _gain(pair: np.ndarray, first: np.ndarray, second: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log(pair / first) - np.log(BACKOFF) - np.log(second / total)


def _base(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per row: the sum as if no pair were found, and what the frequent pairs add."""
    side = int(np.sqrt(len(frequent) // 2))
    for part, t in _texts(batches, lexicon):
        total = lexicon.totals[1 - t.fold].astype(np.float64)
        logs = np.log(np.where(t.count > 0, t.count, BACKOFF) / total) + np.log(BACKOFF)
        n = part.num_rows
        sums = np.bincount(t.row, logs, n) - np.where(np.diff(t.first) > 0, np.log(BACKOFF), 0.0)
        at = _pairs(t)
        at = at[(t.rank[at] >= 0) & (t.rank[at - 1] >= 0)]
        counts = frequent[(t.rank[at - 1] * side + t.rank[at]) * 2 + 1 - t.fold[at]]
        at, counts = at[counts > 0], counts[counts > 0]
        sums += np.bincount(t.row[at], _logs(t, at, counts, lexicon.totals), n)
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("row_key"), pa.array(np.diff(t.first)), pa.array(sums), pa.array(np.bincount(t.row[at], minlength=n)),
        ], ["doc_id", "row_key", "n_words", "base", "n_frequent"])


def _pair_rows(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, parts: int) -> Iterator[pa.RecordBatch]:
    waiting: list[dict[str, np.ndarray]] = []

    def dealt() -> pa.RecordBatch:
        """Many pairs at once, so that each part's share is worth compressing."""
        columns = {name: np.concatenate([w[name] for w in waiting]) for name in waiting[0]}
        waiting.clear()
        return by_part(columns.pop("part"), columns)

    for part, t in _texts(batches, lexicon):
        at = _pairs(t)
        at = at[(t.rank[at] < 0) | (t.rank[at - 1] < 0)]
        pair = mix(t.codes[at - 1] * np.uint64(3) + mix(t.codes[at]))
        columns = {"part": (pair % np.uint64(parts)).astype(np.int32), "row_key": np.asarray(part.column("row_key"))[t.row[at]]}
        if t.number is not None:
            # Both numbers name the pair, and its words' counts are known where it is counted. The lowest bit tells the fold.
            columns |= {"first": t.number[at - 1].astype(np.uint32) * np.uint32(2) + t.fold[at].astype(np.uint32), "second": t.number[at].astype(np.uint32)}
        else:
            first = np.where(t.fold[at] == 1, -t.count[at - 1], t.count[at - 1])  # the sign tells the fold
            columns |= {"pair": pair, "first": first.astype(np.int64), "second": t.count[at].astype(np.int64)}
        waiting.append(columns)
        if sum(len(w["part"]) for w in waiting) >= PAIRS_AT_ONCE:
            yield dealt()
    if waiting:
        yield dealt()


def _join_counts(group: pa.Table, lexicon: Lexicon, parts: int) -> pa.Table:
    """Counts of this part's pairs, joined to the pairs and summed per row; the sums dealt out by row."""
    row_key, totals = gathered(group, "row_key", np.int64), lexicon.totals
    if "pair" in group.column_names:
        pair, first, second = (gathered(group, n, k) for n, k in (("pair", np.uint64), ("first", np.int64), ("second", np.int64)))
        fold, first = (first < 0).astype(np.int64), np.abs(first)
    else:
        one, two = (gathered(group, n, np.uint32) for n in ("first", "second"))
        fold, one = (one & np.uint32(1)).astype(np.int64), one >> np.uint32(1)
        pair = (one.astype(np.uint64) << np.uint64(32)) | two
        first, second = (lexicon.counts[1 - fold, lexicon.by_number[n]] for n in (one, two))
    codes, number = np.unique(pair, return_inverse=True)
    other = np.stack([np.bincount(number[fold == f], minlength=len(codes)) for f in (1, 0)])[fold, number]
    found = other > 0
    gain = _gain(other[found], first[found], second[found], totals[1 - fold[found]].astype(np.float64))
    keys, number = np.unique(row_key[found], return_inverse=True)
    return pa.Table.from_batches([by_part((keys.view(np.uint64) % np.uint64(parts)).astype(np.int32), {
        "row_key": keys, "gain": np.bincount(number, gain, len(keys)).astype(np.float64), "found": np.bincount(number, minlength=len(keys)).astype(np.int64)})])


def _sum_rows(group: pa.Table) -> pa.Table:
    keys, number = np.unique(gathered(group, "row_key", np.int64), return_inverse=True)
    sums = [np.bincount(number, gathered(group, n, k), len(keys)) for n, k in (("gain", np.float64), ("found", np.int64))]
    return pa.table({"row_key": pa.array(keys, pa.int64()), "gain": sums[0].astype(np.float64), "n": sums[1].astype(np.int64)})


def backoff_scores(docs: DataFrame, most_words: int = MOST_WORDS, frequent: int = FREQUENT, pairs_per_part: int = PAIRS_PER_PART) -> DataFrame:
    """``(doc_id, n_words, n_found, score)`` for every row: words in lower case (A-Z), how many of its pairs the other fold
    has, and the mean logarithm.

    Defined results: NULL, empty and blank texts have no words and the score NULL; a NULL doc_id is in fold 0; if the other
    fold is empty, N is 1 and no word is known; repeated rows count again and score alike; no rows give no rows; other columns are not read."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    fold = F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)).cast("int")
    rows = docs.select("doc_id", "text", fold.alias("fold"), F.xxhash64("doc_id", "text").alias("row_key"))
    counts = freeze(rows.select("text", "fold").mapInArrow(_count_words, "code bigint, c0 bigint, c1 bigint")
                    .groupBy("code").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "words")
    sums = counts.agg(F.sum("c0"), F.sum("c1")).first()
    totals = np.maximum(np.array([sums[0] or 0, sums[1] or 0]), 1)
    words = (sums[0] or 0) + (sums[1] or 0)
    shared = counts.where("c0 > 0 and c1 > 0")
    top = shared.orderBy((F.col("c0") + F.col("c1")).desc(), "code").limit(frequent).collect()
    top_codes = np.array([r.code for r in top], np.int64)
    if shared.count() <= most_words:
        held = shared.toArrow()
        codes = np.asarray(held.column("code").combine_chunks()).view(np.uint64)
        order = np.argsort(codes)
        rank = np.full(len(codes), -1, np.int32)
        rank[np.searchsorted(codes[order], top_codes.view(np.uint64))] = np.arange(len(top))
        both = np.stack([np.asarray(held.column(c).combine_chunks())[order] for c in ("c0", "c1")])
        by_number = np.argsort(-both.sum(0), kind="stable").astype(np.int32)
        number = np.empty_like(by_number)
        number[by_number] = np.arange(len(by_number), dtype=np.int32)
        lexicon, pair_rows = Lexicon(codes[order], both, rank, totals, number, by_number), _PAIRS
    else:
        ranks = spark.createDataFrame([(int(c), i) for i, c in enumerate(top_codes)], "code bigint, rank int")
        known = shared.join(F.broadcast(ranks), "code", "left")
        listed = rows.select("row_key", "text").dropDuplicates(["row_key"]).mapInArrow(_explode_words, "row_key bigint, place bigint, code bigint").join(known, "code", "left")
        word = F.struct("place", "code", F.coalesce("c0", F.lit(0)).alias("c0"), F.coalesce("c1", F.lit(0)).alias("c1"),
                        F.coalesce("rank", F.lit(-1)).cast("bigint").alias("rank"))
        joined = listed.groupBy("row_key").agg(F.array_sort(F.collect_list(word)).alias("w"))
        nothing = F.array().cast("array<bigint>")
        rows = freeze(rows.drop("text").join(joined, "row_key", "left").select(
            "doc_id", "fold", "row_key", F.coalesce("w.code", nothing).alias("codes"),
            *[F.coalesce(f"w.{n}", nothing).alias(n) for n in ("c0", "c1", "rank")]), "joined")
        lexicon = Lexicon(np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(0, np.int64), totals, np.zeros(0, np.int32), np.zeros(0, np.int32))
        pair_rows = "part int, n int, row_key binary, pair binary, first binary, second binary"
    model = sc.broadcast(lexicon)
    # At most frequent * frequent * 2 rows.
    dense = np.zeros(frequent * frequent * 2, np.int64)
    for pair, n in rows.mapInArrow(lambda b: _count_frequent(b, model.value, frequent), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n")).collect():
        dense[pair] = n
    table = sc.broadcast(dense)
    base = freeze(rows.mapInArrow(lambda b: _base(b, model.value, table.value),
                                  "doc_id bigint, row_key bigint, n_words bigint, base double, n_frequent bigint"), "base")
    parts = max(-(-words // pairs_per_part), int(spark.conf.get("spark.sql.shuffle.partitions")))
    gains = rows.mapInArrow(lambda b: _pair_rows(b, model.value, parts), pair_rows).groupBy("part").applyInArrow(
        lambda g: _join_counts(g, model.value, parts), "part int, n int, row_key binary, gain binary, found binary")
    summed = freeze(gains.groupBy("part").applyInArrow(_sum_rows, "row_key bigint, gain double, n bigint"), "gains")
    # Repeated rows have one key and so one sum for all of them.
    times = base.groupBy("row_key").agg(F.count(F.lit(1)).alias("times"))
    scored = base.join(times.join(summed, "row_key", "left"), "row_key")
    own = lambda c: F.coalesce(F.col(c) / F.col("times"), F.lit(0))
    return scored.select("doc_id", "n_words", (F.col("n_frequent") + own("n")).cast("bigint").alias("n_found"),
                         F.when(F.col("n_words") > 0, (F.col("base") + own("gain")) / F.col("n_words")).alias("score"))
