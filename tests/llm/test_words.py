import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.encoder import SPECIAL, Encoder, Vocabulary
from textloom.llm.words import BLANKS, LOWER_ALNUM, LOWER_BLANKS, find_words, pieces, runs

ODD = [None, "", " ", "a", "\t\n\x0b\x0c\r", "A b c 　 d\x85e", "é" * 40, "x" * 5000, "Ab1-c_D;ß ζ", "\x00a\x7fb", "a" + " " * 900 + "b"]


def shown(texts, rule):
    w = find_words(pa.array(texts, pa.string()), rule)
    folded = rule.folded()[w.data]
    return [[folded[w.starts[i]:w.ends[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])], w


@pytest.mark.parametrize("rule, pattern, lower", [(BLANKS, brute.BLANKS, False), (LOWER_BLANKS, brute.BLANKS, True), (LOWER_ALNUM, brute.ALNUM, True)])
def test_words_and_codes(rule, pattern, lower):
    got, w = shown(ODD, rule)
    assert got == [brute.words(t, pattern, lower) for t in ODD]
    flat = [x for ws in got for x in ws]
    code = dict(zip(flat, w.codes.tolist()))
    assert [code[x] for x in flat] == w.codes.tolist() and len(set(code.values())) == len(code)
    again = shown([t for t in ODD if t is not None][::-1], rule)[1]
    assert sorted(again.codes.tolist()) == sorted(w.codes.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\tcé.1", max_size=30)), max_size=8))
def test_any_texts(texts):
    assert shown(texts, LOWER_ALNUM)[0] == [brute.words(t, brute.ALNUM, True) for t in texts]


def test_pieces_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 100, "", "c"] * 5)})
    parts = list(pieces(batch, "text", 25))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert list(pieces(batch.slice(0, 0), "text")) == []


def test_runs_differ_by_order():
    codes = np.array([1, 2, 3, 1, 2], np.uint64)
    got = runs(codes, 2)
    assert got[0] == got[3] and len(set(got.tolist())) == 3 and len(runs(codes, 6)) == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    enc = Encoder(Vocabulary())
    library = Tokenizer.from_file(Vocabulary().json)
    texts = [*ODD, " a", "a ", "a  b", "a\n b", "a \n \n b", f"x{SPECIAL} y", SPECIAL, "it's we'll  I'm\t\tx", "\n\nx\n", "ab" * 3000,
             "a  b", "a  b", "12 345 !!! ?", "a \x1cb", "'s 's", "  lead", "the the the cat"]
    for _ in range(2):  # from the cache the second time
        ids, at = enc.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert enc.encode(pa.array([], pa.string()))[1].tolist() == [0]
