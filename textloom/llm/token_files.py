"""Token ids in binary files of fixed-width packed ids.

Every id takes ``bits`` bits, the least that the vocabulary needs, so an id's place is known without reading what comes
before it. A file holds at most ``IDS_PER_FILE`` ids of consecutive documents:

====================  =======================================================================
magic                 8 bytes
header                little-endian numbers, see ``_HEADER``
block offsets         one 64-bit number per block of ``block_ids`` ids, and one for the end
document ids          64 bits each
document ends         64 bits each: ids of this file up to the document's end
null marks            one bit per document without an id
payload               blocks; eight ids take ``bits`` bytes, unused bits are 0
line feed             the record end of the writer
====================  =======================================================================

Ids, offsets and ends are found and unpacked by array operations; ``TokenFile.ids`` reads the blocks of a range only, also from a
memory-mapped file. A document that reaches the end of a file goes on in the next one, and ``before`` says how many of its ids precede.

Writing: texts are dealt out by ranges of (doc_id, place of reading), sorted, encoded and packed in one pass. Each file is one record
of Spark's text sink, which writes its bytes as they are to whatever store the path names, under Spark's commit of task attempts. The
number of ids before a file is not known there; the reader adds up the files' counts. Reading parses whole files in tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.encoder import Vocabulary
from textloom.llm.library_ids import LibraryIds
from textloom.llm.words import pieces
from textloom.operators.ordered import running_totals
from textloom.workspace import freeze

MAGIC = b"TLTOKEN1"
#: bits, ids per block, part, number in the part, ids, documents, ids of the first document in earlier files, 1 if the last one goes on
_HEADER = struct.Struct("<IIqqqqqq")
BLOCK_IDS = 1 << 16
IDS_PER_FILE = 1 << 23
#: Texts are dealt out in about this many bytes and rows.
PART_BYTES, PART_ROWS = 32 << 20, 1 << 20
TEXT_BYTES = 4 << 20
_PIECES = "part bigint, seq bigint, at bigint, before bigint, doc_id bigint, n bigint, crc bigint, goes_on boolean"


def bits_for(vocabulary_size: int) -> int:
    """The least width that holds the ids 0 to ``vocabulary_size - 1``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each (1 to 32), lowest bits first; the last eight are filled up with 0."""
    wide = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    wide.reshape(-1)[:len(ids)] = ids
    if len(ids) and int(wide.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    out = np.zeros((len(wide), bits), np.uint8)
    for i in range(8):
        first, shift = divmod(i * bits, 8)
        moved = wide[:, i] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, first + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack_ids(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    packed = data[:-(-n // 8) * bits].reshape(-1, bits)
    out = np.empty((len(packed), 8), np.uint32)
    for i in range(8):
        first, shift = divmod(i * bits, 8)
        wide = np.zeros(len(packed), np.uint64)
        for k in range((shift + bits + 7) // 8):
            wide |= packed[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, i] = (wide >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def file_bytes(ids: np.ndarray, bits: int, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray,
               part: int = 0, seq: int = 0, before: int = 0, goes_on: bool = False, block_ids: int = BLOCK_IDS) -> bytes:
    """One file without its line feed."""
    blocks = [pack_ids(ids[at:at + block_ids], bits) for at in range(0, len(ids), block_ids)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8")
    header = _HEADER.pack(bits, block_ids, part, seq, len(ids), len(doc_ids), before, int(goes_on))
    return b"".join([MAGIC, header, offsets.tobytes(), doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(),
                     np.packbits(nulls, bitorder="little").tobytes(), *blocks])


class TokenFile:
    """A file's bytes, or a memory map of them, as documents and ids."""

    def __init__(self, data: bytes | np.ndarray):
        data = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a token file")
        (self.bits, self.block_ids, self.part, self.seq, self.n_ids, n_docs, self.before, goes_on) = _HEADER.unpack(
            data[8:8 + _HEADER.size].tobytes())
        self.goes_on, at = bool(goes_on), 8 + _HEADER.size

        def numbers(n: int) -> np.ndarray:
            nonlocal at
            at += 8 * n
            return data[at - 8 * n:at].view("<i8")

        self.offsets = numbers(-(-self.n_ids // self.block_ids) + 1)
        self.doc_ids, self.ends = numbers(n_docs), numbers(n_docs)
        marks = -(-n_docs // 8)
        self.nulls = np.unpackbits(data[at:at + marks], count=n_docs, bitorder="little").astype(bool)
        self.payload = data[at + marks:at + marks + int(self.offsets[-1])]

    @classmethod
    def open(cls, path: str) -> TokenFile:
        """A file of a mounted folder, of which only what is asked for is read."""
        return cls(np.memmap(path, np.uint8, "r"))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop - 1`` of the file, from the blocks that hold them."""
        stop = self.n_ids if stop is None else stop
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"ids {start} to {stop} of {self.n_ids}")
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        parts = [unpack_ids(self.payload[self.offsets[b]:self.offsets[b + 1]], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits)
                 for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block_ids:stop - first * self.block_ids]


@lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary) -> LibraryIds:
    """One encoder per Python worker."""
    return LibraryIds(vocabulary)


class _OpenFile:
    """Ids and documents that are not in a file yet."""

    def __init__(self, bits: int, limit: int, part: int):
        self.bits, self.limit, self.part, self.seq, self.before = bits, limit, part, 0, 0
        self.ids, self.docs, self.nulls, self.sizes = (np.zeros(0, t) for t in (np.uint32, np.int64, bool, np.int64))

    def add(self, ids: np.ndarray, docs: np.ndarray, nulls: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        self.ids, self.docs = np.concatenate([self.ids, ids]), np.concatenate([self.docs, docs])
        self.nulls, self.sizes = np.concatenate([self.nulls, nulls]), np.concatenate([self.sizes, sizes])
        while len(self.ids) > self.limit:
            yield self.take(self.limit)

    def take(self, n: int) -> bytes:
        """The next ``n`` ids as a file."""
        ends = np.cumsum(self.sizes)
        last = int(np.searchsorted(ends, n))  # the document of the file's last id
        goes_on = bool(ends[last] > n)
        held = slice(0, last + 1)
        data = file_bytes(self.ids[:n], self.bits, self.docs[held], self.nulls[held], np.minimum(ends[held], n),
                          self.part, self.seq, self.before, goes_on)
        begins = int(ends[last] - self.sizes[last])
        rest = slice(last if goes_on else last + 1, None)
        self.before = n - begins + (self.before if last == 0 else 0) if goes_on else 0
        self.sizes = self.sizes[rest].copy()
        if goes_on:
            self.sizes[0] = ends[last] - n
        self.ids, self.docs, self.nulls, self.seq = self.ids[n:], self.docs[rest], self.nulls[rest], self.seq + 1
        return data


def _write(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, end_id: int, limit: int) -> Iterator[pa.RecordBatch]:
    enc = _encoder(vocabulary)
    file = _OpenFile(bits_for(enc.size), limit, TaskContext.get().partitionId())

    def record(data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])

    for batch in batches:
        for part in pieces(batch, "text", TEXT_BYTES):
            ids, bounds = enc.encode(part.column("text"))
            sizes = np.diff(bounds) + 1
            closed = np.full(int(sizes.sum()), end_id, np.uint32)
            own = np.ones(len(closed), bool)
            own[np.cumsum(sizes) - 1] = False
            closed[own] = ids
            names = part.column("doc_id")
            for data in file.add(closed, np.asarray(pc.fill_null(names, 0), np.int64), np.asarray(pc.is_null(names)), sizes):
                yield record(data)
    if len(file.ids):
        yield record(file.take(len(file.ids)))


def write_token_files(docs: DataFrame, path: str, vocabulary: Vocabulary | None = None, end_id: int = 0,
                      ids_per_file: int = IDS_PER_FILE, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of every ``(doc_id, text)`` row, with ``end_id`` behind each, as token files below ``path``, in ascending doc_id order.

    Defined results: a NULL or empty text has the end id alone; rows without a doc_id come first; rows of one doc_id
    follow each other in the order in which they are read; no rows give no files; other columns are not read. A text that
    spells out the special token has its id there, as the library gives it."""
    vocabulary = vocabulary or Vocabulary()
    texts = docs.select("doc_id", "text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    parts = max(1, -(-(size["bytes"] or 0) // part_bytes), -(-size["rows"] // PART_ROWS))
    # The place of reading is a function of the input's splits, and takes rows of one doc_id apart.
    placed = texts.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    files = dealt.mapInArrow(lambda batches: _write(batches, vocabulary, end_id, ids_per_file), "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            data = np.frombuffer(content.as_buffer(), np.uint8)
            if not len(data):
                continue
            file = TokenFile(data)
            ids, n_docs = file.ids(), len(file.doc_ids)
            at = np.concatenate([[0], file.ends[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), file.ends.tolist())]
            before, goes_on = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
            before[0], goes_on[-1] = file.before, file.goes_on
            columns = [pa.array(np.full(n_docs, file.part)), pa.array(np.full(n_docs, file.seq)), pa.array(at), pa.array(before),
                       pa.array(file.doc_ids, pa.int64(), mask=file.nulls), pa.array(file.ends - at), pa.array(crc, pa.int64()), pa.array(goes_on)]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            if with_ids:
                offsets = pa.array(np.concatenate([at, file.ends[-1:]]), pa.int32())
                columns, names = [*columns, pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over bits modulo that of CRC-32, highest power in the lowest bit."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """CRC-32 of parts of ``sizes`` bytes put together, from those of the parts."""
    total = 0
    for crc, size in zip(crcs, sizes):
        power, square, n = 1 << 31, 1 << 30, 8 * size  # x^0 and x^1; then x^n by squaring
        while n:
            if n & 1:
                power = _times(power, square)
            square, n = _times(square, square), n >> 1
        total = _times(power, total) ^ crc
    return total


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = [joined_crc([p["crc"] for p in held], [4 * p["n"] for p in held]) for held in batch.column("held").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document below ``path``: the ids of all documents before it, its own, and the CRC-32
    of those as little-endian 32-bit numbers. ``with_ids`` adds them as ``array<int>``. No files give no rows."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    held = whole.mapInArrow(lambda batches: _read(batches, with_ids), schema)
    held = held if with_ids else freeze(held, "token-pieces")
    totals = freeze(held.groupBy("part", "seq").agg(F.sum("n").alias("file_ids")), "token-file-sizes")
    files = running_totals(totals, ["part", "seq"], {"file_end": F.col("file_ids")})
    placed = held.join(files, ["part", "seq"]).withColumn("start", F.col("file_end") - F.col("file_ids") + F.col("at") - F.col("before"))
    cut = F.col("goes_on") | (F.col("before") > 0)
    columns = ["doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")]
    # Few documents reach over two files; their pieces' checksums are put together.
    parts = F.array_sort(F.collect_list(F.struct("before", "n", "crc", *(["ids"] if with_ids else []))))
    over = placed.where(cut).groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), parts.alias("held"))
    joined = over.select("doc_id", "start", "n_tokens", F.transform("held", lambda p: F.struct(p["n"].alias("n"), p["crc"].alias("crc"))).alias("held"))
    ends = joined.mapInArrow(_join_pieces, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    if with_ids:
        ends = ends.join(over.select("start", F.flatten(F.transform("held", lambda p: p["ids"])).alias("ids")), "start")
        return placed.where(~cut).select(*columns, "ids").unionByName(ends)
    return placed.where(~cut).select(*columns).unionByName(ends)
