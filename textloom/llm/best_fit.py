"""Documents packed into sequences: dominance reduction, then best fit.

Tokens of a document that is too long are cut into full pieces, the remainder first. Pieces matter
to the packing only by their length, so the problem is the *histogram* of lengths: at most
``capacity`` counts, whatever the number of documents. On it the driver solves, with multiplicities:

1. Martello-Toth reduction. For the largest open length ``w`` a set is fixed for good if it
   dominates every other set that could hold ``w``: alone if nothing else fits; with a length
   that fills the rest exactly; with the largest that fits, if no two fit, or if it is at
   least as long as any two that fit; with a pair, if it provably dominates all others.
2. Best fit, by descending length, of what is left.

The result is a list of *runs*: the pieces of one length with ranks from a to b lie in
consecutive sequences from s on. Documents get their rank within (length, bucket) by a window,
so a hot length is spread; a lookup in the broadcast runs gives sequence and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.encoder import Vocabulary, encoder
from textloom.llm.words import pieces
from textloom.workspace import freeze

CAPACITY = 1024
END_ID = 2
HOT_BUCKETS, BUCKETS = 256, 16
TEXT_BYTES = 4 << 20


class _Histogram:
    """Counts of lengths, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {w: n for w, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)

    def take(self, w: int, n: int) -> None:
        self.left[w] -= n
        if not self.left[w]:
            del self.left[w]
            del self.sizes[bisect_left(self.sizes, w)]

    def largest(self, most: int, but: Counter | None = None) -> int:
        """The largest length up to ``most`` of which more are left than ``but`` has; 0 if none."""
        i = bisect_right(self.sizes, most)
        while i and but and self.left[self.sizes[i - 1]] <= but[self.sizes[i - 1]]:
            i -= 1
        return self.sizes[i - 1] if i else 0

    def smallest(self, n: int, but: Counter) -> list[int]:
        out: list[int] = []
        for w in self.sizes:
            out += [w] * min(n - len(out), self.left[w] - but[w])
            if len(out) >= n:
                break
        return out


def _best_pair(h: _Histogram, rest: int, but: Counter) -> tuple[int, int]:
    """Two lengths with the largest sum up to ``rest``."""
    best = (0, 0)
    for b in h.sizes:
        if b >= rest or h.left[b] <= but[b]:
            continue
        a = h.largest(min(b, rest - b), but + Counter([b]))
        if a and a + b > sum(best):
            best = (a, b)
    return best


def _dominating(h: _Histogram, w: int, capacity: int) -> tuple[int, ...] | None:
    """What goes with ``w`` in a set that dominates all others with ``w``; None if no such set is known."""
    rest, own = capacity - w, Counter([w])
    single = h.largest(rest, own)
    if not single:
        return ()
    if single == rest:
        return (single,)
    low = h.smallest(3, own)
    if len(low) < 2 or low[0] + low[1] > rest:
        return (single,)
    if len(low) < 3 or sum(low) > rest:  # at most two fit
        a, b = _best_pair(h, rest, own)
        if single >= a + b:
            return (single,)
        # With the largest single, and a partner no smaller than the smaller one of any pair.
        a = h.largest(rest - single, own + Counter([single]))
        if a and a >= h.largest(rest // 2, own):
            return (single, a)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths and how many sequences get each."""
    h = _Histogram(counts)
    sets: Counter = Counter()
    for w in sorted(counts, reverse=True):
        while h.left.get(w):
            others = _dominating(h, w, capacity)
            if others is None:
                break
            need = Counter([w, *others])
            # Dominance over all sets holds over those of fewer pieces, so the step repeats while counts allow it.
            times = min(h.left[x] // n for x, n in need.items())
            for x, n in need.items():
                h.take(x, n * times)
            sets[(w, *others)] += times
    # Best fit: open sequences by free room; equal lengths fill a sequence before the next.
    open_sets: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if n and room not in open_sets:
            open_sets[room] = Counter()
            insort(rooms, room)
        if n:
            open_sets[room][lengths] += n

    for w in sorted(h.left, reverse=True):
        n = h.left[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                each = capacity // w
                put(capacity - each * w, (w,) * each, n // each)
                put(capacity - n % each * w, (w,) * (n % each), 1 if n % each else 0)
                break
            room = rooms[i]
            lengths, m = next(iter(open_sets[room].items()))
            each = min(room // w, n)
            times = min(m, n // each)
            open_sets[room][lengths] -= times
            if not open_sets[room][lengths]:
                del open_sets[room][lengths]
            if not open_sets[room]:
                del open_sets[room]
                del rooms[i]
            put(room - each * w, lengths + (w,) * each, times)
            n -= each * times
    for group in open_sets.values():
        sets += group
    return sorted(sets.items(), reverse=True)


@dataclass(frozen=True)
class Runs:
    """Where the pieces of each length go: keys ascend by length, then rank."""

    keys: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    length: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 44) + rank
        at = np.searchsorted(self.keys, key, "right") - 1
        nth = key - self.keys[at]
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * self.length[at]


def runs_of(sets: list[tuple[tuple[int, ...], int]]) -> Runs:
    used: Counter = Counter()
    base, rows = 0, []
    for lengths, times in sets:
        offset = 0
        for w, copies in sorted(Counter(lengths).items(), reverse=True):
            rows.append(((w << 44) + used[w], base, copies, offset, w))
            used[w] += copies * times
            offset += w * copies
        base += times
    return Runs(*np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: full ones, after a shorter first one if need be."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def _cut_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for batch in batches:
        for part in pieces(batch, "text", TEXT_BYTES):
            ids, bounds = enc.encode(part.column("text"))
            keys = part.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for key, lo, hi in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist()):
                line = np.append(ids[lo:hi], np.uint32(END_ID)).astype("<u4")
                for i, (at, n) in enumerate(cut(len(line), capacity)):
                    own = line[at:at + n]
                    rows.append((key, i, at, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
            columns = list(zip(*rows))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][:len(names)], names)


def _place_batches(batches: Iterator[pa.RecordBatch], runs: Runs, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = np.asarray(batch.column("length"))
        rank = np.asarray(batch.column("_rank")) - 1 + starts[length, np.asarray(batch.column("_bucket"))]
        sequence, offset = runs.place(length, rank)
        kept = [n for n in batch.schema.names if n not in ("_rank", "_bucket")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(sequence), pa.array(offset)],
                                         [*kept, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    with ``with_ids`` the token ``ids`` too, then ``sequence_id`` and ``offset``.

    Defined results: NULL and empty texts are the end id alone, one piece; repeated rows are each
    packed; a NULL doc_id stays NULL; no rows give no rows; of other columns nothing is read. Pieces of
    equal length change places only with each other, in the order of a hash of the id, the id, the piece
    and the checksum."""
    sc = docs.sparkSession.sparkContext
    vocabulary = vocabulary or Vocabulary()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    buckets = F.when(F.col("length") == capacity, HOT_BUCKETS).otherwise(BUCKETS)
    cut_rows = freeze(docs.select("doc_id", "text").mapInArrow(
        lambda batches: _cut_batches(batches, vocabulary, capacity, with_ids), schema,
    ).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets).cast("int")), "cut")
    # At most capacity * BUCKETS + HOT_BUCKETS rows.
    counts = cut_rows.groupBy("length", "_bucket").count().collect()
    totals: Counter = Counter()
    starts = np.zeros((capacity + 1, HOT_BUCKETS), np.int64)
    for length, bucket, n in sorted(counts):
        starts[length, bucket] = totals[length]
        totals[length] += n
    model = sc.broadcast((runs_of(plan(dict(totals), capacity)), starts))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut_rows.withColumn("_rank", F.row_number().over(order).cast("bigint"))
    return ranked.mapInArrow(lambda batches: _place_batches(batches, *model.value), schema + ", sequence_id bigint, offset bigint")
