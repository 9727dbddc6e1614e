"""Near-duplicate groups by b-bit MinHash.

1. One scan gives each document the size of its shingle set, a digest of the set, ``HASHES`` minima
   as band hashes, and the lowest ``BITS`` bits of each minimum, packed into whole numbers.
2. Documents with equal sets form a class; only its smallest document goes on.
3. Documents that share a band hash form a bucket. A bucket is not expanded into pairs: in
   each round some of its documents become *hubs* and are paired with the members of
   other components, unless their set sizes alone rule a link out. Each round has ``MORE`` times the hubs, and a bucket is done when its members
   that never were a hub are in one component, so no pair of a bucket stays unjudged.
4. Packed signatures give the estimate ``(m - c) / (1 - c)``, with ``m`` the share of equal values by
   counts and ``c = 2^-BITS`` the chance of equal bits; pairs far below the threshold
   (``DEVIATIONS`` standard deviations) go. Signatures are not joined to pairs: documents of a neighbourhood lie in one or more
   *blocks*, and a part of block pairs gets the signature of each of its documents once, for all its pairs. So
   what moves grows with the documents of a large group and its blocks, not with its pairs; the same holds for sets.
5. The rest is confirmed on the full sets, in the first round each document's best pair before the others; pairs
   that are already connected need no second look. Components are labels in written tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.words import LOWER_BLANKS, PIECE, WordRule, find_words, mix, pieces, runs
from textloom.workspace import Tables, freeze, temporary_tables

SHINGLE = 5
HASHES, BITS = 320, 8
BANDS, BAND_ROWS = 64, 5
DEVIATIONS = 5.5
MORE = 8
PERCENT = 75
BLOCK_DOCS, BLOCK_SHINGLES = 64, 1 << 18
PART_PAIRS, PART_SHINGLES = 1 << 19, 1 << 20
PAIRS_AT_ONCE = 1 << 14
_SEEDS = np.random.default_rng(5)
_FACTORS = _SEEDS.integers(1 << 31, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _SEEDS.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_SIGNATURE = ("doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, signature array<bigint>")


def shingle_sets(texts: pa.Array, rule: WordRule = LOWER_BLANKS, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, shingle code)``, distinct and in order. A text of fewer words than
    ``size`` has its whole word sequence as its one shingle."""
    words = find_words(texts, rule)
    counts = np.diff(words.first)
    whole = np.flatnonzero(words.left() >= size)
    rows, codes = [words.text_of()[whole]], [runs(words.codes, size)[whole]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        rows.append(short)
        codes.append(mix(runs(words.codes, n)[words.first[short]] + np.uint64(n)))
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def _lists(values: np.ndarray, some: np.ndarray, n: int) -> pa.Array:
    """A list per row, empty where the row is not in ``some``."""
    sizes = np.zeros(n, np.int64)
    sizes[some] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.reshape(-1)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            row, code = shingle_sets(part.column("text"))
            n = part.num_rows
            size = np.bincount(row, minlength=n)
            some = np.flatnonzero(size)
            at = np.cumsum(size[some]) - size[some]
            digests = np.zeros((2, n), np.uint64)
            minima = np.empty((HASHES, len(some)), np.uint32)
            if len(some):
                for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    digests[i, some] = np.add.reduceat(mix(code ^ np.uint64(salt)), at)
                short = (code >> np.uint64(32)).astype(np.uint32)
                for i in range(HASHES):
                    minima[i] = np.minimum.reduceat(short * _FACTORS[i] + _SHIFTS[i], at)
            bands = np.empty((len(some), BANDS), np.uint64)
            for b in range(bands.shape[1]):
                h = np.full(len(some), b + 1, np.uint64)
                for i in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                    h = mix(h * np.uint64(31) + minima[i])
                bands[:, b] = h
            packed = np.ascontiguousarray((minima.T & ((1 << BITS) - 1)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(size), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                _lists(bands.view(np.int64), some, n), _lists(packed.view(np.int64), some, n),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            row, code = shingle_sets(part.column("text"))
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([code[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ], ["doc_id", "codes"])


def _sides(pairs: pa.Table, docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair number and the two rows of ``docs``, for all rows of the pair's documents: a doc_id may have several."""
    ids = np.asarray(docs.column("doc_id"))
    order = np.argsort(ids, kind="stable")
    first, n = {}, {}
    for side in ("a", "b"):
        wanted = np.asarray(pairs.column(side))
        first[side] = np.searchsorted(ids, wanted, "left", order)
        n[side] = np.searchsorted(ids, wanted, "right", order) - first[side]
    each = n["a"] * n["b"]
    pair = np.repeat(np.arange(len(each)), each)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    return pair, order[first["a"][pair] + nth // n["b"][pair]], order[first["b"][pair] + nth % n["b"][pair]]


def _likely(pairs: pa.Table, docs: pa.Table, least: float) -> pa.Table:
    """Pairs whose estimate from the packed signatures, corrected for equal bits by chance, is high enough."""
    pair, x, y = _sides(pairs, docs)
    signatures = np.asarray(docs.column("signature").combine_chunks().flatten()).view(np.uint8).reshape(-1, HASHES)
    like = np.empty(len(pair))
    for at in range(0, len(pair), PAIRS_AT_ONCE):
        own = slice(at, at + PAIRS_AT_ONCE)
        unlike = np.count_nonzero(signatures[x[own]] != signatures[y[own]], axis=1)
        like[own] = ((1 - unlike / HASHES) - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)
    keep = like >= least
    return pairs.select(["part", "a", "b"]).take(pa.array(pair[keep])).append_column("likely", pa.array(like[keep]))


def _linked(pairs: pa.Table, docs: pa.Table, percent: int) -> pa.Table:
    """Pairs whose sets are similar enough."""
    pair, x, y = _sides(pairs, docs)
    codes = docs.column("codes").combine_chunks()
    size = np.asarray(pc.binary_length(codes)).astype(np.int64) // 8
    ends = np.cumsum(size[x] + size[y])
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(pair):
        # A piece of the pairs, or one where that has more.
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE // 8, "right")))
        row, code = [], []
        for side in (x[at:upto], y[at:upto]):
            row.append(np.repeat(np.arange(upto - at), size[side]))
            code.append(np.frombuffer(b"".join(codes.take(pa.array(side)).to_pylist()), np.uint64))
        row, code = np.concatenate(row), np.concatenate(code)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        common = np.bincount(row[1:][(row[1:] == row[:-1]) & (code[1:] == code[:-1])], minlength=upto - at)
        union = np.bincount(row, minlength=upto - at) - common
        found.append(pair[at:upto][(union > 0) & (100 * common >= percent * union)])
        at = upto
    return pairs.select(["a", "b"]).take(pa.array(np.concatenate(found)))


def _in_parts(pairs: DataFrame, docs: DataFrame, judge: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``judge`` for each part's ``pairs`` (``part``, ``a``, ``b``) and the rows of ``docs`` that they name, each once."""
    wanted = pairs.select(F.col("part").alias("of_part"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return pairs.groupBy("part").cogroup(wanted.join(docs, "doc_id").groupBy("of_part")).applyInArrow(judge, schema)


def _least_estimate(percent: int) -> float:
    p = percent / 100
    return p - DEVIATIONS * math.sqrt(p * (1 - p) / HASHES)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row: documents are linked if their
    shingle sets share ``percent`` of their union; ``component_id`` is the smallest doc_id that links reach.

    Defined results: NULL, empty and blank texts have no shingles and are linked with nothing; rows with a
    NULL doc_id cannot be named by a link: their component is NULL and they are kept; rows of one
    doc_id are one node with the links of all; no rows give no rows; other columns are not read."""
    texts = docs.select("doc_id", "text")
    signed = freeze(texts.mapInArrow(_sign, _SIGNATURE), "signatures")
    some = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    keys = ["set_a", "set_b", "n_shingles"]
    classes = freeze(some.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    firsts = freeze(some.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *keys]).dropDuplicates(["doc_id", *keys])
                    .select("doc_id", F.col("n_shingles").cast("int").alias("size"), "bands", "signature"), "firsts")
    # Rows of one doc_id are one node with a range of sizes.
    rows = firsts.select(F.explode("bands").alias("bucket"), "doc_id", "size").groupBy("bucket", "doc_id").agg(
        F.min("size").alias("least"), F.max("size").alias("most"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = freeze(rows.join(shared, "bucket"), "members")
    labels = _labels(texts, firsts.select("doc_id", "signature"), members, percent)
    label = F.coalesce("label", "rep")
    named = signed.select("doc_id", *keys).join(classes, keys, "left")
    if labels is not None:
        named = named.join(labels, F.col("rep") == F.col("node"), "left")
    else:
        named = named.withColumn("label", F.lit(None).cast("bigint"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce(label, F.col("doc_id")))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labels(texts: DataFrame, signatures: DataFrame, members: DataFrame, percent: int) -> DataFrame | None:
    """``(node, label)`` of all linked documents: the smallest document that links in the buckets reach."""
    spark = texts.sparkSession
    labels: DataFrame | None = None
    hubs_each = 1
    # The last round's members and labels stay until the next members are written; all other tables of a round go at its end.
    kept, labels_at = Tables(spark), ""

    def labelled(rows: DataFrame, key: str, name: str) -> DataFrame:
        if labels is None:
            return rows.withColumn(name, F.col(key))
        own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        return rows.join(own, F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", key)).drop("_node", "_label")

    while True:
        old = [path for path in kept.paths if path != labels_at]
        open_members = labelled(members, "doc_id", "label")
        mixed = open_members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("doc_id").alias("first")).where(
            "lo <> hi").select("bucket", "first")
        members = kept.freeze(open_members.join(mixed, "bucket"), "members")
        kept.drop(old)
        if members.isEmpty():
            return labels
        blocks = kept.freeze(_blocks(members), "blocks")
        old = kept.paths[-2:]
        members = kept.freeze(members.drop("first").join(blocks.select("doc_id", "block"), "doc_id"), "members")
        shingles = blocks.agg(F.sum("size")).first()[0]
        kept.drop(old)
        turn = F.xxhash64("doc_id", "bucket")
        hubs = members.groupBy("bucket", F.pmod(turn, F.lit(hubs_each)).alias("slot")).agg(
            F.min_by(F.struct(F.col("doc_id").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("label", "least", "most", "block")]),
                     F.struct(turn, "doc_id")).alias("h"),
        ).select("bucket", "h.*")
        # The smaller set's share of the larger one bounds the share in common: no link is lost by it.
        near_size = (100 * F.col("most") >= percent * F.col("hub_least")) & (100 * F.col("hub_most") >= percent * F.col("least"))
        known = labels
        with temporary_tables(spark):
            met = freeze(members.join(hubs, "bucket").where((F.col("label") != F.col("hub_label")) & near_size).select(
                F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"),
                F.xxhash64(F.least("block", "hub_block"), F.greatest("block", "hub_block")).alias("blocks")).distinct(), "met")
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // PART_PAIRS), -(-shingles // PART_SHINGLES))
            met = met.select(F.pmod("blocks", F.lit(parts)).cast("int").alias("part"), "a", "b")
            least = _least_estimate(percent)
            pairs = freeze(_in_parts(met, signatures, lambda p, d: _likely(p, d, least), "part int, a bigint, b bigint, likely double"), "pairs")
            if not pairs.isEmpty():
                ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
                sets = freeze(texts.join(ids, "doc_id").mapInArrow(_set_rows, "doc_id bigint, codes binary"), "sets")
                rest = pairs.select("part", "a", "b").distinct()
                if labels is None:
                    best = pairs.groupBy("b").agg(F.max_by(F.struct("part", "a"), F.struct("likely", -F.col("a"))).alias("p")).select("p.*", "b")
                    labels = components(_confirm(best, sets, percent))
                    rest = labelled(labelled(rest.join(best, ["a", "b"], "left_anti"), "a", "la"), "b", "lb").where("la <> lb")
                found = _confirm(rest.select("part", "a", "b"), sets, percent)
                if not found.isEmpty():
                    # A label is a link to the smallest document, and stands for all links so far.
                    labels = components(found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
            if labels is not known:
                labels = kept.freeze(labels, "labels")
                labels_at = kept.paths[-1]
        # Pairs with a hub are judged; what remains are pairs of documents that were none.
        members = members.drop("label", "block").join(hubs.select("bucket", F.col("hub").alias("doc_id")), ["bucket", "doc_id"], "left_anti")
        hubs_each *= MORE


def _blocks(members: DataFrame) -> DataFrame:
    """``(doc_id, size, block)``: documents with the same least neighbour in their buckets lie in one block, or in several of bounded
    size. Any blocks give the same links; good ones let the documents of a part share their pairs."""
    docs = members.groupBy("doc_id").agg(F.min("first").alias("head"), F.max("most").cast("bigint").alias("size"))
    cuts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    heads = docs.groupBy("head").agg(cuts.alias("cuts"))
    return docs.join(heads, "head").select(
        "doc_id", "size", F.xxhash64("head", F.pmod(F.xxhash64("doc_id"), F.col("cuts"))).alias("block"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar enough."""
    return freeze(_in_parts(pairs, sets, lambda p, d: _linked(p, d, percent), "a bigint, b bigint"), "links")
