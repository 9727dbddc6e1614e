"""Token sections and best-fit packing against the tokenizer library and brute force."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import best_fit
from textloom.llm.best_fit import cut, pack_documents, plan, runs_of
from textloom.llm.encoder import Vocabulary
from textloom.llm.field_tokens import section_tokens


def least_bins(items, capacity):
    """Exact number of sequences of a small instance, by trying subsets."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(rest, used):
        if used + -(-sum(rest) // capacity) >= best[0]:
            return
        if not rest:
            best[0] = used
            return
        head, others = rest[0], rest[1:]
        for size in range(len(others), -1, -1):
            for pick in combinations(range(len(others)), size):
                if head + sum(others[i] for i in pick) <= capacity:
                    go([x for i, x in enumerate(others) if i not in pick], used + 1)

    go(items, 0)
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_dominance_never_costs_a_sequence(items):
    """What the reduction fixes can be completed to a best solution."""
    h = best_fit._Histogram(dict(Counter(items)))
    fixed = 0
    for w in sorted(set(items), reverse=True):
        while h.left.get(w) and (others := best_fit._dominating(h, w, 20)) is not None:
            for x in (w, *others):
                h.take(x, 1)
            fixed += 1
    rest = [w for w, n in h.left.items() for _ in range(n)]
    assert fixed + least_bins(rest, 20) == least_bins(items, 20)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 1024])
    counts = Counter(rng.randint(1, capacity) if seed % 3 else min(capacity, max(1, int(rng.gauss(capacity * 0.45, capacity * 0.1))))
                     for _ in range(rng.choice([0, 1, 60, 3000])))
    sets = plan(dict(counts), capacity)
    placed = Counter()
    for lengths, times in sets:
        assert sum(lengths) <= capacity
        for w in lengths:
            placed[w] += times
    assert placed == counts
    runs, seen = runs_of(sets), {}
    for w, n in counts.items():
        for s, o in zip(*(x.tolist() for x in runs.place(np.full(n, w), np.arange(n)))):
            seen.setdefault(s, []).append((o, w))
    for held in seen.values():
        ends = np.cumsum([w for _, w in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    total = -(-sum(w * n for w, n in counts.items()) // capacity)
    assert len(seen) == sum(t for _, t in sets) and len(seen) <= max(total * 1.12, total + 1)


def test_cut():
    assert [cut(n, 10) for n in (1, 10, 11, 25)] == [[(0, 1)], [(0, 10)], [(0, 1), (1, 10)], [(0, 5), (5, 10), (15, 10)]]


ROWS = [(1, "the cat sat on the mat " * 40), (2, None), (3, ""), (3, ""), (None, "a  b<|endoftext|>c"), (4, "word " * 3000), (5, "x"), (5, "y")]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Vocabulary().json).encode(text or "", add_special_tokens=False).ids


def test_pack_documents(spark, docs_of):
    got = pack_documents(docs_of(ROWS * 3), with_ids=True).collect()
    want = Counter()
    for d, text in ROWS * 3:
        ids = library_ids(text) + [2]
        first = len(ids) % 1024 or 1024
        for i, at in enumerate([0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]):
            own = ids[at:(first if i == 0 else at + 1024)]
            want[d, i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(docs_of([])).count() == 0


def library_sections(text, rule):
    """Tokens of each line by the library's own character offsets."""
    from tokenizers import Tokenizer

    lines = text.splitlines(keepends=True) if text else [""]
    section_of = [i for i, line in enumerate(lines) for _ in line]
    counts = [0.0] * len(lines)
    for start, end in Tokenizer.from_file(Vocabulary().json).encode(text, add_special_tokens=False).offsets:
        held = Counter(section_of[start:end])
        if rule == "split":
            for i, n in held.items():
                counts[i] += n / (end - start)
        else:
            counts[section_of[start] if rule == "start" else min(held, key=lambda i: (-held[i], i))] += 1
    return counts


@pytest.mark.parametrize("rule", ["start", "most", "split"])
def test_section_tokens(spark, docs_of, rule):
    rows = [*ROWS, (7, "one\ntwo\n\nthree\n"), (8, "\n"), (9, "é\n  ü🎉x\n\n\nend"), (10, "a\n\n\n\n\n\n b"),
            (11, "\n \n\n  \nword\n\n\n" * 9), (12, "日本語\n🎉🎉\n\n\u00a0\nß" * 5)]
    got = section_tokens(docs_of(rows), rule=rule).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, text in rows:
        text = text or ""
        if Counter(x for x, _ in rows)[d] > 1:
            continue
        own = sorted(by[d], key=lambda r: r.section)
        assert [text[r.start:r.start + r.length] for r in own] == (text.splitlines(keepends=True) if text else [""])
        assert [r.n_tokens for r in own] == pytest.approx(library_sections(text, rule), abs=1e-9)
    assert section_tokens(docs_of([])).count() == 0


def test_crossing_rule():
    from textloom.llm.field_tokens import allocate

    starts, ends, borders = np.array([0, 2, 6]), np.array([2, 6, 7]), np.array([0, 3, 5])
    assert allocate(starts, ends, borders, "start")[0].tolist() == [2, 0, 1]
    assert allocate(starts, ends, borders, "most")[0].tolist() == [1, 1, 1]
    assert allocate(starts, ends, borders, "split")[0].tolist() == [1.25, 0.5, 1.25]
    assert allocate(starts, ends, borders, "start")[1].tolist() == [1, 0, 0]
