"""Test-set passages in documents, by Wu-Manber search over words.

The patterns are the windows of ``WINDOW`` words of all benchmark items; an item of fewer
words is one pattern. For each pattern length a *shift table* says, for the block of the last two words
under the search position, how far the search may move on because no pattern has that block
nearer to its end. Where the shift is zero, the hash of the last block, together with that of the
first, selects a bucket of patterns, and comparing the words' bytes confirms an occurrence.

The scan runs as map tasks without a shuffle. Within a batch all documents are searched
side by side, long ones in stretches, as lanes of arrays that skip on their own. The
patterns are broadcast in blocks of at most ``BLOCK_BYTES`` bytes of text, whatever the size
of the benchmark; if there are several blocks, spans are put together per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import LOWER_ALNUM, find_words, joined, mix, pieces

WINDOW = 13
BLOCK_BYTES = 8 << 20
STRETCH = 256
_SCANNED = "doc_id bigint, n_words bigint, text_key bigint, spans array<struct<lo:int,hi:int>>, items array<string>"


class Patterns:
    """All patterns of one length: shift table, buckets, codes, bytes and items."""

    def __init__(self, codes: np.ndarray, texts: list[bytes], items: list[list[str]]):
        self.length = codes.shape[1]
        self.block = min(2, self.length)
        self.mask = np.uint64((1 << max(12, int(codes.size * 4).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, self.length - self.block + 1, np.uint8)
        for end in range(self.block, self.length + 1):
            at = (self._blocks(codes[:, end - self.block:end]) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, at, self.length - end)
        keys = self._keys(codes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.codes = keys[order], codes[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]

    def _blocks(self, columns: np.ndarray) -> np.ndarray:
        return mix(columns[:, 0]) if self.block == 1 else mix(columns[:, 0] * np.uint64(3) + columns[:, 1])

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """Bucket by the last block, narrowed by the first."""
        return mix(self._blocks(rows[:, -self.block:]) * np.uint64(5) + self._blocks(rows[:, :self.block]))

    def search(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (first word) and pattern numbers where all codes agree."""
        sizes = np.maximum(np.diff(first) - self.length + 1, 0)
        lanes = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[:-1][text] + nth * STRETCH + self.length  # one past the window's last word
        end = np.minimum(at + STRETCH, first[1:][text] + 1)
        found = []
        while len(at):
            blocks = self._blocks(np.stack([codes[at - 2], codes[at - 1]], 1) if self.block == 2 else codes[at - 1][:, None])
            shift = self.shift[(blocks & self.mask).astype(np.int64)]
            found.append(at[shift == 0] - self.length)
            at = at + np.maximum(shift, 1)
            going = at < end
            at, end = at[going], end[going]
        places = np.concatenate(found) if found else np.zeros(0, np.int64)
        windows = codes[places[:, None] + np.arange(self.length)]
        keys = self._keys(windows) if len(places) else np.zeros(0, np.uint64)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        which = np.repeat(np.arange(len(places)), hi - lo)
        pattern = np.repeat(lo, hi - lo) + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        same = (windows[which] == self.codes[pattern]).all(1)
        return places[which[same]], pattern[same]


def build_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Patterns of ``(name, text)`` pairs, by length."""
    words = find_words(pa.array([text for _, text in items], pa.large_string()), LOWER_ALNUM)
    folded = LOWER_ALNUM.folded()[words.data]
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for i, (name, _) in enumerate(items):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        size = min(window, hi - lo)
        for at in range(lo, hi - size + 1) if size else ():
            text = joined(words, at, at + size, folded)
            by_length.setdefault(size, {}).setdefault(text, (words.codes[at:at + size], set()))[1].add(name)
    return [Patterns(np.stack([c for c, _ in found.values()]), list(found), [sorted(n) for _, n in found.values()])
            for _, found in sorted(by_length.items())]


def _scan(batches: Iterator[pa.RecordBatch], patterns: list[Patterns]) -> Iterator[pa.RecordBatch]:
    fold = LOWER_ALNUM.folded()
    for batch in batches:
        for part in pieces(batch, "text"):
            words = find_words(part.column("text"), LOWER_ALNUM)
            folded = fold[words.data]
            rows: dict[int, tuple[set[tuple[int, int]], set[str]]] = {}
            for p in patterns:
                places, numbers = p.search(words.codes, words.first)
                texts = np.searchsorted(words.first, places, "right") - 1
                for place, number, text in zip(places.tolist(), numbers.tolist(), texts.tolist()):
                    if joined(words, place, place + p.length, folded) == p.texts[number]:
                        spans, items = rows.setdefault(text, (set(), set()))
                        at = place - int(words.first[text])
                        spans.add((at, at + p.length))
                        items.update(p.items[number])
            none: tuple[set, set] = (set(), set())
            got = [rows.get(i, none) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": np.diff(words.first), "text_key": part.column("text_key"),
                "spans": pa.array([[{"lo": a, "hi": b} for a, b in sorted(s)] for s, _ in got],
                                  pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                "items": pa.array([sorted(i) for _, i in got], pa.list_(pa.string()))})


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, each read on its own."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where(
        F.col("text").isNotNull())
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for i in range(blocks):
        yield [tuple(r) for r in named.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == i).collect()]


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text_key, n_words, spans, items)`` for every row of ``docs``: ``spans`` are the
    word ranges covered by benchmark windows, merged; ``items`` the names of items found.

    Defined results: NULL and word-free texts have no words, spans or items; NULL or word-free items are
    never found; items of one name are one item, and a NULL name is the name ``''``; repeated rows
    are each scanned; no benchmark leaves all documents clean; other columns are not read."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    scans = []
    for items in _item_blocks(benchmark, block_bytes):
        model = sc.broadcast(build_patterns(items, window))
        scans.append(rows.mapInArrow(lambda batches, model=model: _scan(batches, model.value), _SCANNED))
    if not scans:
        scans.append(rows.mapInArrow(lambda batches: _scan(batches, []), _SCANNED))
    found = scans[0]
    for more in scans[1:]:
        found = found.unionByName(more)
    if len(scans) > 1:
        found = found.groupBy("doc_id", "text_key").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count(F.lit(1)).alias("_n"),
        ).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.call_function("div", "_n", F.lit(len(scans)))))).drop("_n", "_copy")
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    merge = lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, F.greatest(F.size(out), F.lit(1)))["hi"] >= s["lo"]),
        F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(
            F.element_at(out, F.greatest(F.size(out), F.lit(1)))["lo"].alias("lo"),
            F.greatest(F.element_at(out, F.greatest(F.size(out), F.lit(1)))["hi"], s["hi"]).alias("hi")))),
    ).otherwise(F.concat(out, F.array(s)))
    return found.withColumn("spans", F.aggregate(F.array_sort("spans"), empty, merge))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document how many of its words benchmark windows cover, by which items, and whether
    that is a twentieth of its words or more. ``scan_documents`` defines the odd cases."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["hi"] - s["lo"]))
    counted = scan_documents(docs, benchmark, window).withColumn("n_hit", hit)
    return counted.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))

