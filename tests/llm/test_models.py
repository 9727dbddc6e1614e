"""Language model and toxicity: brute force, gradients, held-out accuracy."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_model, toxicity
from textloom.llm.language_model import backoff_scores

rng = random.Random(6)
WORDS = [f"w{i}" for i in range(60)]
ROWS = [(i, brute.random_text(rng, rng.randint(1, 60), WORDS)) for i in range(60)] + [
    (60, None), (61, ""), (62, " \n"), (63, "Of The of the"), (64, "of the OF THE rare"), (None, "of the w1 w2"), (65, "w1 " * 3000), (65, "w1 w2"), (3, "same"), (3, "same")]


def stupid_backoff(rows, a=0.4):
    split = [(d, (d or 0) % 2, brute.words(t, lower=True)) for d, t in rows]
    one, two, total = Counter(), Counter(), Counter()
    for _, f, w in split:
        total[f] += len(w)
        one.update((f, x) for x in w)
        two.update((f, u, x) for u, x in zip(w, w[1:]))
    out = []
    for d, f, w in split:
        g, s, found = 1 - f, 0.0, 0
        for u, x in zip([None, *w], w):
            if u is not None and two[g, u, x]:
                s += math.log(two[g, u, x] / one[g, u])
                found += 1
            else:
                s += math.log((one[g, x] or a) / max(total[g], 1)) + (math.log(a) if u is not None else 0)
        out.append((str(d), len(w), found, round(s / len(w), 8) if w else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"frequent": 5, "pairs_per_part": 100}, {"most_words": 0}, {"most_words": 0, "frequent": 2}])
def test_backoff(spark, docs_of, options):
    got = backoff_scores(docs_of(ROWS), **options).collect()
    assert sorted(((str(r.doc_id), r.n_words, r.n_found, None if r.score is None else round(r.score, 8)) for r in got), key=str) == stupid_backoff(ROWS)


def test_backoff_of_nothing_and_of_one_fold(spark, docs_of):
    assert backoff_scores(docs_of([])).count() == 0
    alone = backoff_scores(docs_of([(2, "a b"), (4, "a b")])).collect()
    assert [r.n_found for r in alone] == [0, 0] and alone[0].score == alone[1].score


def test_gradients_by_differences():
    texts = ["a b c d loser " * 9, "b c", "...", "loser"]
    first, number, lex = toxicity.read_words(pa.array(texts), np.zeros(0, np.uint64))
    known = np.unique(toxicity.find_words(pa.array(texts), toxicity.LOWER_ALNUM).codes)[:3]
    first, number, lex = toxicity.read_words(pa.array(texts), known)
    r = np.random.default_rng(0)
    shapes = {"word": (4, 12), "pair": (toxicity.PAIRS, 8), "attend": (16,), "out": (16,), "bias": (1,)}
    shapes |= {f"in{i}": (20, 24) for i in (0, 1)} | {f"u{i}": (8, 24) for i in (0, 1)} | {f"b{i}": (24,) for i in (0, 1)}
    w = {k: (0.5 * r.normal(size=s)) for k, s in shapes.items()}
    y = np.array([1, 0, 1, 0], np.float32)
    doc, start, size = toxicity.windows_of(first)

    def loss(w):
        x = np.concatenate([toxicity._inputs(w, lex), np.zeros((1, 20))])
        value = toxicity._forward(w, [x @ w[f"in{i}"] + w[f"b{i}"] for i in (0, 1)], *toxicity._grid(number, start, size, len(x) - 1))[0].astype(np.float64)
        z = np.array([np.log(np.exp(value[doc == i]).sum()) for i in range(len(y))])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = toxicity._gradients(w, lex, number, doc, start, size, y)
    for name in w:
        for at in np.argsort(-np.abs(g[name]).reshape(-1))[:3]:
            if name == "word" and at < 12:
                continue
            up, down = ({k: v.copy() for k, v in w.items()} for _ in (0, 1))
            up[name].reshape(-1)[at] += 1e-2
            down[name].reshape(-1)[at] -= 1e-2
            assert abs((loss(up) - loss(down)) / 2e-2 - g[name].reshape(-1)[at]) < 5e-3, name


def test_learns_and_finds_single_windows(spark, docs_of):
    bad = ["vile", "awful", "nasty"]
    texts = []
    for i in range(500):
        w = [rng.choice(WORDS) for _ in range(rng.randint(1, 150))]
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs_of(texts), labels)
    plain = brute.random_text(rng, 3000, WORDS)
    odd = [(1000, None), (1001, ""), (1002, "..."), (None, "vile awful nasty vile"), (1003, plain), (1004, f"{plain} vile nasty vile awful {plain}")]
    got = toxicity.score_documents(docs_of(texts + odd), model, "likely").withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    assert got[0].score == 1 and got[0].label == 3  # columns of the table stay
    right = [(r.likely >= toxicity.LIMIT) == (r.doc_id % 3 == 0) for r in got if r.out and (r.doc_id or 1000) < 1000]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    by = {r.doc_id: r.likely for r in got}
    assert by[1000] == by[1001] == by[1002] < 0.3 and by[None] > 0.3 and by[1003] < 0.3 < by[1004]


def test_nothing_to_learn_from(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs_of([(1, "a")]), labels)
    assert [r.likely for r in toxicity.score_documents(docs_of([(1, "a"), (2, None)]), model, "likely").collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs_of([]), model).count() == 0


def test_pairs_travel_as_two_word_numbers():
    """Pairs of held words need no digest and no counts; each pair is found again from the numbers."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words, 100)) for _ in range(200)]
    rows = pa.RecordBatch.from_pydict({"row_key": pa.array(range(200), pa.int64()), "text": pa.array(texts), "fold": pa.array([i % 2 for i in range(200)], pa.int32())})
    counted = pa.Table.from_batches(language_model._count_words(iter([rows])))
    codes = np.asarray(counted.column("code").combine_chunks()).view(np.uint64)
    both = np.stack([np.asarray(counted.column(c).combine_chunks()) for c in ("c0", "c1")])
    by_number = np.argsort(-both.sum(0), kind="stable").astype(np.int32)
    lexicon = language_model.Lexicon(codes, both, np.full(len(codes), -1), both.sum(1), np.argsort(by_number).astype(np.int32), by_number)
    sent = pa.Table.from_batches(language_model._pair_rows(iter([rows]), lexicon, 1))
    n = sum(sent.column("n").to_pylist())
    assert n > 15_000
    assert sum(len(v) for c in ("row_key", "first", "second") for v in sent.column(c).to_pylist()) < 6 * n and sent.num_columns == 5
