"""Substrings, benchmark passages and near duplicates against brute force."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.benchmark_scan import contamination
from textloom.llm.components import components
from textloom.llm import near_dups, substrings
from textloom.llm.near_dups import near_duplicates
from textloom.llm.substrings import remove_repeats

rng = random.Random(4)
WORDS = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
PASSAGE = brute.random_text(rng, 60, WORDS)
LONG = brute.random_text(rng, 4000, WORDS)


def corpus():
    rows = [(i, brute.random_text(rng, rng.randint(1, 120), WORDS)) for i in range(40)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(30)]  # copies
    for i in range(30):  # near copies
        w = rows[7][1].split() or ["x"]
        w[rng.randrange(len(w))] = "new"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{brute.random_text(rng, 20, WORDS)} {PASSAGE}  {brute.random_text(rng, 9, WORDS)}") for i in range(40)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "One"), (405, "one two three four"), (406, LONG), (407, f"{LONG} tail"),
             (408, "same " * 40), (409, "same " * 40), (410, "tie é ß " * 9), (-5, PASSAGE.upper())]
    return rows


def answer(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


@pytest.mark.parametrize("hot, group", [(1000, 400_000), (3, 50)])
def test_repeats(spark, docs_of, hot, group):
    rows = corpus() + [(300, corpus()[0][1]), (None, PASSAGE), (None, PASSAGE)]
    got = remove_repeats(docs_of(rows), hot=hot, keys_per_group=group, with_text=True).persist()
    assert answer(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, brute.repeats(rows)))
    for r in got.where("n_removed > 0").collect():
        assert brute.sha(r.kept_text) == r.kept_sha256
    assert remove_repeats(docs_of([])).count() == 0


def test_no_tree_holds_a_row_per_copy_of_a_passage():
    """The words around a common passage differ, but no group gets a segment of each document."""
    passage = PASSAGE.split()[:30]
    rows = [" ".join([*brute.random_text(rng, 20, WORDS).split(), *passage, *brute.random_text(rng, 20, WORDS).split()]) for _ in range(200)]
    ids = pa.array(range(len(rows)), pa.int64())
    keys = pa.Table.from_batches(substrings._key_rows(iter([pa.RecordBatch.from_pydict({"id": ids, "text": pa.array(rows)})]), 1, 13, 6))
    shared = substrings._repeated_keys(keys, 20).to_pydict()
    assert len(shared["id"]) == len(rows)
    batch = pa.RecordBatch.from_pydict({**{k: pa.array(v) for k, v in shared.items()}, "text_key": ids, "text": pa.array([rows[i] for i in shared["id"]])})
    segments = pa.Table.from_batches(substrings._segment_rows(iter([batch]), 1 << 30, 13, 6)).to_pylist()
    assert any(s["hot"] for s in segments)
    assert max(Counter(s["part"] for s in segments if s["text"] != "").values()) <= 20


def test_repeats_of_hot_keys_in_rows_of_one_id(spark, docs_of):
    tail = brute.random_text(rng, 30, WORDS)
    rows = [(i, f"{brute.random_text(rng, 15, WORDS)} {PASSAGE} {brute.random_text(rng, 5, WORDS)}") for i in range(12)]
    rows += [(20, PASSAGE), (20, tail), (21, tail), (21, f"{tail} {PASSAGE}")]
    got = remove_repeats(docs_of(rows), hot=4, keys_per_group=50)
    assert answer(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, brute.repeats(rows)))


def test_repeats_with_other_windows(spark, docs_of):
    rows = corpus()
    got = remove_repeats(docs_of(rows), window=5, anchor=2)
    assert answer(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, brute.repeats(rows, 5)))


ITEMS = [(1, PASSAGE), (2, PASSAGE), (10, "one two three"), (3, None), (4, "..."), (5, "tie é ß"), (None, "aK bl cm dn"), (7, LONG[:900]), (7, "one")]


def test_contamination(spark, docs_of):
    rows = corpus() + [(300, corpus()[0][1]), (None, PASSAGE), (1, "One. Two; THREE! four"), (1, "One. Two; THREE! four")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(map(repr, brute.contamination(rows, ITEMS)))
    assert answer(contamination(docs_of(rows), items), *columns) == want
    assert contamination(docs_of([]), items).count() == 0
    none = contamination(docs_of(rows), items.limit(0))
    assert none.where("n_hit > 0 or n_items > 0 or contaminated").count() == 0 and none.count() == len(rows)


def test_contamination_in_pattern_blocks(spark, docs_of):
    from textloom.llm.benchmark_scan import scan_documents

    rows = corpus() + [(1, "One. Two; THREE! four")] * 2
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    one, many = (scan_documents(docs_of(rows), items, block_bytes=b) for b in (1 << 20, 500))
    assert answer(one, "doc_id", "n_words", "spans", "items") == answer(many, "doc_id", "n_words", "spans", "items")


def test_near_duplicates(spark, docs_of):
    rows = corpus()
    want = brute.near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(rows) - 30
    odd = near_duplicates(docs_of([(None, "a b c d e f"), (None, ""), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in odd) == [
        ("2", "2", True), ("3", "2", False), ("3", "2", False), ("None", "None", True), ("None", "None", True)]
    assert near_duplicates(docs_of([])).count() == 0


def test_no_pair_at_the_threshold_is_missed():
    """Every one of 30,000 pairs of similarity 0.75 shares a band and passes the estimate."""
    long = [" ".join(f"w{n}x{i}" for i in range(12)) for n in range(30_000)]
    short = [" ".join(t.split()[:10]) for t in long]
    signed = []
    for texts in (long, short):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
        signed.append(pa.Table.from_batches(near_dups._sign(iter([batch]))))
    (bands_a, bits_a), (bands_b, bits_b) = [[np.stack(t[c].combine_chunks().flatten().to_numpy().reshape(len(long), -1)) for c in ("bands", "signature")] for t in signed]
    assert (bands_a == bands_b).any(axis=1).all()
    unlike = (bits_a.view(np.uint8) != bits_b.view(np.uint8)).mean(axis=1)
    chance = 2.0 ** -near_dups.BITS
    assert ((1 - unlike - chance) / (1 - chance) >= near_dups._least_estimate(75)).all()


def test_rows_of_one_id_and_unlike_size(spark, docs_of):
    a, b = PASSAGE.split(), brute.random_text(rng, 200, WORDS).split()
    rows = [(1, " ".join(a)), (1, " ".join(a + b)), (2, " ".join([*a, *b, "end"])), (3, " ".join([*a, "end"]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_near_duplicate_chain(spark, docs_of):
    """A row of documents of which only neighbours are similar, and many that share a part but are not linked."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 12:i * 12 + 100])) for i in range(20)]
    rows += [(100 + i, " ".join(base[:60] + [f"v{i}_{j}" for j in range(40)])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {d: c for d, (_, c) in brute.near(rows).items()} and got[19] == 0


def test_documents_of_a_group_move_once_for_many_pairs(spark, docs_of, monkeypatch):
    """Of many documents that are close and not linked, each goes to a few parts, not to every pair."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base + [f"v{i}_{j}" for j in range(30)])) for i in range(60)] + [(100, " ".join(base)), (101, " ".join(base[:70]))]
    want, moved, in_parts = {d: c for d, (_, c) in brute.near(rows).items()}, [], near_dups._in_parts

    def counted(pairs, docs, judge, schema):
        own = pairs.collect()
        moved.append((len(own), len({(r.part, d) for r in own for d in (r.a, r.b)})))
        return in_parts(pairs, docs, judge, schema)

    monkeypatch.setattr(near_dups, "_in_parts", counted)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()} == want
    assert sum(n for n, _ in moved) > 5 * sum(n for _, n in moved)
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 3)
    monkeypatch.setattr(near_dups, "PAIRS_AT_ONCE", 7)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}
