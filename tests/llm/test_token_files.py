"""Token files against the tokenizer library: packed bits, whole and cut documents, random access."""

import glob
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm import library_ids
from textloom.llm.encoder import Vocabulary
from textloom.llm.token_files import TokenFile, bits_for, file_bytes, joined_crc, pack_ids, read_token_files, unpack_ids, write_token_files


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 9, 15, 16, 17, 25, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = pack_ids(ids, bits)
        assert len(data) == -(-n // 8) * bits
        # Bit by bit, the lowest first.
        stream = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n * bits].reshape(n, bits)
        assert (stream @ (1 << np.arange(bits, dtype=np.uint64)) == ids).all()
        assert (unpack_ids(np.frombuffer(data, np.uint8), n, bits) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError):
            pack_ids(np.array([1 << bits]), bits)


def test_least_width():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 11, 1000).astype(np.uint32)
    data = file_bytes(ids, 11, np.array([5, 0, 9]), np.array([False, True, False]), np.array([1, 400, 1000]), block_ids=64)
    path = tmp_path / "file"
    path.write_bytes(data + b"\n")
    file = TokenFile.open(str(path))
    assert file.doc_ids.tolist() == [5, 0, 9] and file.nulls.tolist() == [False, True, False] and file.ends.tolist() == [1, 400, 1000]
    assert len(file.offsets) == 17 and len(file.payload) == 125 * 11
    for _ in range(200):
        a, b = sorted(rng.integers(0, 1001, 2).tolist())
        assert (file.ids(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        file.ids(0, 1001)
    with pytest.raises(ValueError):
        TokenFile(b"something else")


def test_joined_checksums():
    rng = random.Random(2)
    for _ in range(20):
        parts = [rng.randbytes(rng.choice([0, 1, 5, 1000])) for _ in range(rng.randint(1, 6))]
        assert joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


ROWS = [(4, "the cat sat on the mat " * 40), (2, None), (3, ""), (3, ""), (None, "a  b<|endoftext|>c"), (9, "word " * 3000), (5, "x"),
        (5, "yes\n\n and  no"), (-7, "é ü\t🎉 x" * 9), (None, None)]


def expected(rows, end_id=0):
    library = Tokenizer.from_file(Vocabulary().json)
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, end_id]) for d, t in rows]
    return sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("ids_per_file, part_bytes", [(1 << 20, 1 << 20), (500, 1 << 20), (7, 1 << 20), (1000, 500)])
def test_files_hold_the_ids(spark, docs_of, tmp_path, ids_per_file, part_bytes):
    path = str(tmp_path / "tokens")
    write_token_files(docs_of(ROWS), path, ids_per_file=ids_per_file, part_bytes=part_bytes)
    want = expected(ROWS)
    got = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(i)) for d, i in want)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    narrow = sorted(map(tuple, read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert narrow == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got]
    files = [TokenFile.open(p) for p in glob.glob(f"{path}/part-*")]
    assert all(f.bits == 16 and f.n_ids <= ids_per_file for f in files)
    line = np.concatenate([f.ids() for f in sorted(files, key=lambda f: (f.part, f.seq))])
    assert len(line) == at and len(files) >= at / ids_per_file


def test_many_rows_of_one_id(spark, docs_of, tmp_path):
    path = str(tmp_path / "tokens")
    rows = [(1, f"text {i}") for i in range(300)] + [(1, "same text")] * 300 + [(2, "after")]
    write_token_files(docs_of(rows), path, part_bytes=300)
    got = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(i)) for d, i in expected(rows)) and got[-1].doc_id == 2
    assert len(glob.glob(f"{path}/part-*")) > 10  # one id's rows are in many files


def test_no_rows(spark, docs_of, tmp_path):
    write_token_files(docs_of([]), str(tmp_path / "none"))
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("generation", [library_ids.GENERATION, 20])
def test_library_parts_equal_whole_texts(monkeypatch, generation):
    monkeypatch.setattr(library_ids, "GENERATION", generation)
    monkeypatch.setattr(library_ids, "PARTS_A_CALL", 7)
    rng = random.Random(3)
    marks = ["a", " ", "  ", "\n", "é", "don't", " 12", " ", "🎉", "\t", "<|endoftext|>", "word", ".", "\u00a0", " Ünïté"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    enc = library_ids.LibraryIds(Vocabulary())
    for at in range(0, 600, 50):
        held = texts[at:at + 50]
        ids, bounds = enc.encode(pa.array(held))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [i[:-1] for _, i in expected(list(enumerate(held)))]
