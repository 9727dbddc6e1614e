"""Spelling variants against all pairs of words."""

import random

import pytest

from textloom.llm.spelling import TEXT_KEY, letter_runs, spelling_groups, without_letter
from pyspark.sql import functions as F


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, times=5):
    out = {}
    for w, n in words.items():
        near = [x for x in words if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= times * n else None
        out[w] = [form, None, n, len(near), words[form] if form is not None else None]
    for w in words:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def results(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abé$", "aÿzñ\U0001F600"][seed]
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 6, 7]))): rng.choice([1, 1, 2, 5, 10, 25, 125, 125, 3000]) for _ in range(160)}
    rows = [(w, n, 1, "x") for w, n in words.items()]
    assert results(spelling_groups(spark.createDataFrame(rows, "word string, n bigint, rank int, key string"))) == brute(words)


def test_long_words_and_odd_rows(spark):
    long = "ab" * (TEXT_KEY // 2 - 1)
    words = {long[:n]: 7 ** (n % 3) for n in range(TEXT_KEY - 4, TEXT_KEY - 1)}
    words |= {long + "xy"[:n] + "c" * k: 3 * n + k + 1 for n in range(3) for k in range(4)} | {"q" * 3000: 1, "q" * 2999: 9, "q" * 2998 + "r": 5}
    rows = [(w, n) for w, n in words.items()] + [(None, 5), ("gone", None), ("gone", 0), (long, 2)]
    assert results(spelling_groups(spark.createDataFrame(rows, "word string, n bigint"))) == brute(words | {long: words[long] + 2})
    assert spelling_groups(spark.createDataFrame([], "word string, n bigint")).count() == 0
    with pytest.raises(ValueError):
        spelling_groups(spark.createDataFrame([], "word string, n bigint"), times=1)


def test_chains_of_forms_end_at_one_root(spark):
    words = {"abcdef" + "g" * i: 5 ** (i + 1) for i in range(9)}
    found = results(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert found == brute(words) and {v[1] for v in found.values()} == {"abcdef" + "g" * 8}


def test_runs_and_deletion(spark):
    texts = spark.createDataFrame([("Ab×cÿ÷Ā ÀB-c_d1E",), ("",), (None,)], "text string")
    assert [r[0] for r in texts.select(letter_runs(F.col("text"))).collect()] == [["ab×cÿ÷", "Àb", "c", "d", "e"], [], None]
    word = spark.createDataFrame([("aéb", i) for i in range(3)], "word string, i int").select(without_letter(F.col("word"), F.col("i")))
    assert [r[0] for r in word.collect()] == ["éb", "ab", "aé"]
