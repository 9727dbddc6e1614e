"""Passages that repeat across documents, by prefix-partitioned suffix trees over words.

Every window of ``WINDOW`` words is the start of a suffix; two suffixes that share their first
``WINDOW`` words meet in an internal node of that depth. To partition the suffixes, each window has
a *prefix key*: its least run of ``ANCHOR`` words by hash, which equal windows
have in common and which neighbouring windows share, so text goes along in segments of
a few windows and not once per window.

1. Prefix keys are counted by hash; those that only one document has cannot lead to a shared
   node, and their suffixes are left out before any text moves.
2. Segments of the other keys are dealt to groups of bounded size by key. Equal segments of a
   batch are one row with a list of places. Keys with more than ``HOT`` places get the whole window as
   their prefix: each window is a node by its digest, and an aggregation finds the node's least document. So
   no group holds a row per document of a common passage, whatever words stand before and behind it.
3. In a group the trees' nodes are named level by level, for depths 1, 2, 4, 8 and so on up to
   ``WINDOW``: the name of a node is the pair of the names of its two halves. Suffixes with equal names
   at the last depth lie below one deep node, whose least document keeps its copy.
4. Places come back to their documents and cover words there.

Words are compared as bytes in the trees, where hashes only choose keys; windows of hot keys by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.ragged import by_part, gathered, list_array, offsets_of, spaced, spread_ranges, string_array
from textloom.llm.words import BLANKS, Words, find_words, pieces, runs
from textloom.workspace import freeze

WINDOW, ANCHOR = 13, 6
KEYS_PER_GROUP = 400_000
HOT = 1000
NO_ID = (1 << 63) - 1
_COUNTED = "doc_id bigint, id bigint, text_key bigint, n_words bigint, all_sha256 string"
_KEYS = "part int, n int, codes binary, ids binary, places binary"
_SEGMENTS = ("part int, hot boolean, k1 bigint, k2 bigint, k3 bigint, id bigint, many boolean, text string, "
             "held array<struct<id:bigint,text_key:bigint,at:int>>")
_TREE_KEY = ["k1", "k2", "k3"]


@dataclass
class Anchors:
    """Prefix keys of all windows: ``lo`` to ``hi`` are the first words of the windows that share one."""

    text: np.ndarray
    code: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def find_anchors(words: Words, window: int, size: int) -> Anchors:
    total = max(0, len(words.codes) - window + 1)
    codes = runs(words.codes, size)
    best, place = codes[:total].copy(), np.arange(total)
    for shift in range(1, window - size + 1):
        other = codes[shift:total + shift]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + shift
    whole = np.flatnonzero(words.left()[:total] >= window)
    at = place[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)
    heads = np.flatnonzero(new)
    lo, hi = whole[heads], whole[np.append(heads[1:], len(whole))[:len(heads)] - 1]
    return Anchors(np.searchsorted(words.first, lo, "right") - 1, best[lo], lo, hi)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = find_words(part.column("text"), BLANKS)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("id"), part.column("text_key"), pa.array(np.diff(words.first)),
                 pa.array(_digests(*spaced(words), words.first))], ["doc_id", "id", "text_key", "n_words", "all_sha256"])


def _digests(line: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[str]:
    held = line.tobytes()
    return [hashlib.sha256(held[begin[a]:end[b - 1]] if b > a else b"").hexdigest()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _key_rows(batches: Iterator[pa.RecordBatch], parts: int, window: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            a = find_anchors(find_words(part.column("text"), BLANKS), window, size)
            ids = np.asarray(part.column("id"))[a.text]
            nth = np.arange(len(a.text)) - np.searchsorted(a.text, np.arange(part.num_rows))[a.text]
            yield by_part((a.code % np.uint64(parts)).astype(np.int32), {"codes": a.code, "ids": ids, "places": nth.astype(np.int32)})


def _repeated_keys(group: pa.Table, hot: int) -> pa.Table:
    """Per document the numbers of its prefix keys that another document has too, and the hot ones among the keys."""
    codes, ids, places = (gathered(group, n, k) for n, k in (("codes", np.uint64), ("ids", np.int64), ("places", np.int32)))
    order = np.argsort(codes, kind="stable")
    codes, ids, places = codes[order], ids[order], places[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sizes = np.diff(np.append(heads, len(codes)))
    shared = np.repeat(np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads), sizes)
    heated = np.repeat(sizes > hot, sizes)[shared]
    codes, ids, places = codes[shared], ids[shared], places[shared]
    order = np.argsort(ids, kind="stable")
    owner, counts = np.unique(ids[order], return_counts=True)
    n_hot = np.bincount(np.searchsorted(owner, ids[heated]), minlength=len(owner))
    return pa.table({"id": pa.array(owner, pa.int64()), "places": list_array(places[order].astype(np.int32), counts),
                     "hot": list_array(codes[order][heated[order]].view(np.int64), n_hot)})


def _segment_rows(batches: Iterator[pa.RecordBatch], parts: int, window: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = find_words(part.column("text"), BLANKS)
            a = find_anchors(words, window, size)
            listed = part.column("places")
            nth = np.asarray(listed.flatten()).astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(listed)))
            first = np.searchsorted(a.text, np.arange(part.num_rows + 1))
            here = nth < np.diff(first)[row]  # another text of the same id may have more
            chosen = np.unique((first[row] + nth)[here])
            if not len(chosen):
                continue
            # A key is hot in all documents or in none. Its segments are taken apart into windows.
            heated = np.isin(a.code[chosen], np.asarray(part.column("hot").flatten()).view(np.uint64))
            n_windows = a.hi[chosen] - a.lo[chosen] + 1
            lo = np.concatenate([a.lo[chosen][~heated], spread_ranges(a.lo[chosen][heated], n_windows[heated])])
            hi = np.concatenate([a.hi[chosen][~heated], lo[int((~heated).sum()):]])
            chosen = np.concatenate([chosen[~heated], np.repeat(chosen[heated], n_windows[heated])])
            hot = np.arange(len(lo)) >= (~heated).sum()
            line, begin, end = spaced(words)
            text = string_array(line, begin[lo], end[hi + window - 1] - begin[lo]).dictionary_encode()
            number = np.asarray(text.indices).astype(np.int64)
            ids = np.asarray(part.column("id"))[a.text[chosen]]
            keys = np.asarray(part.column("text_key"))[a.text[chosen]]
            at = (lo - words.first[a.text[chosen]]).astype(np.int32)
            order = np.lexsort((at, keys, ids, number))
            sizes = np.bincount(number)
            rep = order[offsets_of(sizes)[:-1]]
            k1, k2, k3 = ids[rep].copy(), keys[rep].copy(), at[rep].astype(np.int64)
            for i in np.flatnonzero(hot[rep]).tolist():
                k1[i], k2[i] = np.frombuffer(hashlib.blake2b(text.dictionary[i].as_buffer(), digest_size=16).digest(), np.int64)
                k3[i] = -1
            held = pa.StructArray.from_arrays([pa.array(ids[order]), pa.array(keys[order]), pa.array(at[order])], ["id", "text_key", "at"])
            yield pa.RecordBatch.from_arrays([
                pa.array((a.code[chosen][rep] % np.uint64(parts)).astype(np.int32)), pa.array(hot[rep]), pa.array(k1), pa.array(k2), pa.array(k3),
                pa.array(ids[rep]), pa.array(sizes > 1), pc.if_else(pa.array(hot[rep]), "", text.dictionary.cast(pa.string())), list_array(held, sizes),
            ], ["part", "hot", "k1", "k2", "k3", "id", "many", "text", "held"])


def deep_nodes(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``window`` words: their text, first word (within all words) and the name of their
    ancestor at depth ``window``. Equal names mean equal words."""
    words = find_words(texts, BLANKS)
    sizes = words.ends - words.starts
    name = np.asarray(string_array(words.data, words.starts, sizes).dictionary_encode().indices).astype(np.int64)
    depth = 1
    while depth < window:
        step = min(depth, window - depth)  # the second half may overlap the first
        head, tail = name[:len(name) - step], name[step:]
        name = np.unique(head * (int(name.max(initial=0)) + 1) + tail, return_inverse=True)[1]
        depth += step
    whole = np.flatnonzero(words.left() >= window)
    return words.text_of()[whole], whole, name[whole] if len(whole) else whole


def _subtrees(group: pa.Table, window: int) -> pa.Table:
    """For each segment the least document of each of its windows' deep nodes."""
    texts = group.column("text").combine_chunks()
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    row, _, node = deep_nodes(texts, window)
    ids = np.asarray(group.column("id").combine_chunks())[row]
    order = np.argsort(node, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
    sizes = np.diff(np.append(heads, len(node)))
    least, most = np.minimum.reduceat(ids[order], heads), np.maximum.reduceat(ids[order], heads)
    first, shared = np.empty_like(ids), np.empty(len(ids), bool)
    first[order], shared[order] = np.repeat(least, sizes), np.repeat(least != most, sizes)
    useful = np.asarray(group.column("many").combine_chunks(), bool).copy()
    useful[row[shared]] = True
    counts = np.bincount(row, minlength=group.num_rows)
    kept = pa.array(useful)
    return pa.table([*[group.column(k).combine_chunks().filter(kept) for k in _TREE_KEY],
                     list_array(first[useful[row]], counts[useful])], [*_TREE_KEY, "firsts"])


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each place whose node has a smaller document, as bits."""
    for batch in batches:
        held, firsts = batch.column("held"), batch.column("firsts")
        n_held, n_first = np.asarray(pc.list_value_length(held)), np.asarray(pc.list_value_length(firsts))
        at_first = offsets_of(n_first)[:-1]
        own = held.flatten()
        row = np.repeat(np.arange(batch.num_rows), n_held)
        ids = np.asarray(own.field("id"))
        index = spread_ranges(at_first[row], n_first[row])
        place = np.repeat(np.arange(len(row)), n_first[row])
        nth = index - at_first[row][place]
        covered = np.asarray(firsts.flatten())[index] < ids[place]
        mask = np.bincount(place, weights=np.where(covered, 2.0 ** nth, 0.0), minlength=len(row)).astype(np.int32)
        some = pa.array(mask > 0)
        yield pa.RecordBatch.from_arrays([own.field("id").filter(some), own.field("text_key").filter(some),
                                          own.field("at").filter(some), pa.array(mask).filter(some)], ["id", "text_key", "at", "mask"])


def _cut_rows(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = find_words(part.column("text"), BLANKS)
            marks = part.column("marks")
            own = marks.flatten()
            row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(marks)))
            base = words.first[row] + np.asarray(own.field("at"))
            mask = np.asarray(own.field("mask"))
            edges = np.zeros(len(words.starts) + 1, np.int64)
            for bit in range(int(mask.max(initial=0)).bit_length()):
                start = base[(mask >> bit) & 1 == 1] + bit
                np.add.at(edges, start, 1)
                np.add.at(edges, start + window, -1)
            keep = np.cumsum(edges)[:-1] == 0
            line, begin, end = spaced(words, keep)
            first = offsets_of(keep)[words.first]
            held = line.tobytes()
            texts = pa.array([held[begin[a]:end[b - 1]].decode() if b > a else "" for a, b in zip(first[:-1], first[1:])] if with_text else [None] * part.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("text_key"), pa.array(np.diff(words.first) - np.diff(first)),
                pa.array(_digests(line, begin, end, first)), texts], ["id", "text_key", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT,
                   keys_per_group: int = KEYS_PER_GROUP, with_text: bool = False) -> DataFrame:
    """``(doc_id, text_key, n_words, n_removed, kept_sha256, kept_text)`` for every row: each word is removed that a
    window covers whose words also start in a document with a smaller doc_id. ``text_key`` is
    ``xxhash64(text)``; ``kept_text`` is given on demand, for rows with removed words.

    Documents whose whole word sequence an earlier one has lose all words at once and stay out of
    the trees. Defined results: NULL, empty and blank texts have no words; texts shorter than a window
    lose nothing; rows of one doc_id do not remove each other's words; a NULL doc_id counts
    as larger than all others; no rows give no rows; other columns are not read."""
    if window - anchor + 1 > 30 or anchor > window:
        raise ValueError("a key's windows are counted in 30 bits")
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text", F.xxhash64("text").alias("text_key"))
    counted = freeze(texts.mapInArrow(_count_words, _COUNTED), "counted")
    total = counted.agg(F.sum("n_words")).first()[0] or 0
    parts = max(-(-total // (2 * keys_per_group)), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Whole copies: the smallest document of each word sequence goes on alone.
    # A written table: joined to it, a sequence that many documents have can be split at run time.
    leaders = freeze(counted.groupBy("all_sha256").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("_n"))
                     .where("_n > 1").drop("_n"), "leaders")
    marked = freeze(counted.join(leaders, "all_sha256", "left").withColumn(
        "copy", F.coalesce((F.col("id") > F.col("leader")) & (F.col("n_words") >= window), F.lit(False))), "marked")

    keys = texts.select("id", "text").mapInArrow(lambda b: _key_rows(b, parts, window, anchor), _KEYS)
    shared = freeze(keys.groupBy("part").applyInArrow(lambda g: _repeated_keys(g, hot), "id bigint, places array<int>, hot array<bigint>"), "shared")
    wanted = shared.groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("hot")).alias("hot")).join(
        marked.where("not copy").select("id", "text_key").distinct(), "id")
    held = freeze(texts.select("id", "text_key", "text").join(wanted, ["id", "text_key"]), "held")
    segments = freeze(held.mapInArrow(lambda b: _segment_rows(b, parts, window, anchor), _SEGMENTS), "segments")
    columns = ["part", *_TREE_KEY, "id", "many", "text"]
    alike = segments.where("hot").groupBy(*_TREE_KEY).agg(
        F.min("id").alias("first"), F.max("many").alias("many"), F.count(F.lit(1)).alias("n")).where("many or n > 1")
    trees = segments.where("not hot").select(*columns)
    nodes = freeze(trees.groupBy("part").applyInArrow(lambda g: _subtrees(g, window), "k1 bigint, k2 bigint, k3 bigint, firsts array<bigint>")
                   .dropDuplicates(_TREE_KEY).unionByName(alike.select(*_TREE_KEY, F.array("first").alias("firsts"))), "nodes")
    covered = segments.select(*_TREE_KEY, "held").join(nodes, _TREE_KEY).select("held", "firsts").mapInArrow(
        _place_rows, "id bigint, text_key bigint, at int, mask int")
    marks = covered.groupBy("id", "text_key").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    done = held.select("id", "text_key", "text").join(marks, ["id", "text_key"]).mapInArrow(
        lambda b: _cut_rows(b, window, with_text), "id bigint, text_key bigint, n_removed bigint, kept_sha256 string, kept_text string",
    ).dropDuplicates(["id", "text_key"])
    return marked.join(done, ["id", "text_key"], "left").select(
        "doc_id", "text_key", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), "").otherwise(F.col("kept_text")).alias("kept_text"))
