"""Spelling variants by permuterm rotations.

A word is marked by a terminator behind its last letter, and every rotation of the marked word is an entry of the index.
Two words that differ in one letter have rotations that are equal up to that letter, when it is rotated to the end: a
replacement is a range of entries with one prefix and different last letters. If the letter is there in one word only, the other word has
the prefix itself as a whole rotation. So the entries are keyed by their prefix without the letter at the end,
sorted, and each group is scanned once. A group has at most one word per letter of the alphabet and one whole rotation, and
the scan needs no pairs: each word gets how many others the group holds and the best of them.

An indel inside a run of equal letters has several such places; only the run's first counts, so every near word is counted once.

Words are represented by their *rank* (most frequent first, then in code-point order), so entries are small and the best near
word is the least rank. Prefixes of more than ``TEXT_KEY`` letters are represented by a SHA-256 digest, so a long word's entries
stay small too; the work for one word grows with the square of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ordered import ordinals
from textloom.workspace import freeze

LETTERS = "A-Za-zÀ-ÿ"
TERMINATOR = "$"
TEXT_KEY = 64
WORDS_A_TASK = 1 << 16
MIN_LENGTH, MIN_COUNT, TIMES = 6, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(text: Column, min_length: int = 1) -> Column:
    """Maximal runs of letters of at least ``min_length``, with A-Z in lower case; a NULL text has none."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))


def without_letter(word: Column, at: Column) -> Column:
    """The word without its code point number ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def _entries(ranked: DataFrame) -> DataFrame:
    """``(at, key, rank, whole, counts)``: for each word each rotation as a whole, and each rotation that ends in a letter without that
    letter. ``at``: letters before the terminator; with it a key is clear for words that hold the terminator themselves.
    ``counts``: the letter at the end opens a run of equal letters."""
    letters = F.length("word")
    part = lambda lo, n: F.substring(F.col("word"), lo.cast("int"), n.cast("int"))

    def entry(i: Column, whole: bool) -> Column:
        # The rotation that starts at letter i (from 0), or behind letter i and without it.
        rest = i if whole else i + 1
        text = F.concat(part(rest + 1, letters), F.lit(TERMINATOR), part(F.lit(1), i))
        key = F.when(letters + int(whole) <= TEXT_KEY, text).otherwise(F.sha2(text, 256))
        opens = F.lit(True) if whole else (i == 0) | (part(i + 1, F.lit(1)) != part(i, F.lit(1)))
        return F.struct((letters - rest).alias("at"), key.alias("key"), F.lit(whole).alias("whole"), opens.alias("counts"))

    places = ranked.select("rank", "word", F.explode(F.sequence(F.lit(0), letters)).alias("i"))
    both = F.array(entry(F.col("i"), True), F.when(F.col("i") < letters, entry(F.col("i"), False)))
    return places.select("rank", F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select("rank", "e.*")


def near_words(ranked: DataFrame) -> DataFrame:
    """``(rank, n_near, best)`` of every word of ``(rank, word)`` with a near word: how many words differ by exactly one inserted, deleted or
    replaced code point, and the least rank of them."""
    group = Window.partitionBy("key", "at")
    by_rank = group.orderBy("whole", "rank")
    is_letter = ~F.col("whole")
    scanned = _entries(ranked).select(
        "rank", "whole", "counts",
        F.sum(is_letter.cast("bigint")).over(group).alias("letters"),
        F.sum((is_letter & F.col("counts")).cast("bigint")).over(group).alias("opening"),
        F.min(F.when(is_letter, F.col("rank"))).over(group).alias("first"),
        F.min(F.when(is_letter & F.col("counts"), F.col("rank"))).over(group).alias("first_opening"),
        F.min(F.when(F.col("whole"), F.col("rank"))).over(group).alias("shorter"),
        F.lead(F.when(is_letter, F.col("rank"))).over(by_rank).alias("next"),
    )
    shorter = F.when(F.col("counts"), F.col("shorter"))
    other = F.when(F.col("rank") == F.col("first"), F.col("next")).otherwise(F.col("first"))
    found = scanned.select(
        "rank",
        F.when(F.col("whole"), F.col("opening")).otherwise(F.col("letters") - 1 + shorter.isNotNull().cast("bigint")).alias("near"),
        F.when(F.col("whole"), F.col("first_opening")).otherwise(F.least(other, shorter)).alias("best"))
    return found.where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """``(rank, root)``: the last word that the links reach. Each round jumps to the link's link; a word's form is
    several times as frequent, so the rounds grow with the logarithm of the logarithm of the counts."""
    roots = links
    while True:
        ahead = roots.select(F.col("rank").alias("root"), F.col("root").alias("ahead"))
        moved = freeze(roots.join(ahead, "root", "left").select(
            "rank", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("rank", "root")
        roots = moved.select("rank", "root")


def spelling_groups(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``counts (word, n)``. Near words differ by exactly one
    code point. The form is the near word of largest ``n`` (ties: the smallest in code-point order), if that is at
    least ``times`` the word's own (``times`` > 1); the root is where the forms end.

    Defined results: NULL words and NULL or non-positive counts are left out; repeated words are added up; the empty word is near to
    all words of one letter; no rows give no rows; other columns are not read."""
    if times <= 1:
        raise ValueError("times must be above 1: forms must not run in circles")
    spark = counts.sparkSession
    words = counts.where(F.col("word").isNotNull() & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = freeze(words.select("word", "n", (-F.col("n")).alias("less")), "words")
    ranked = freeze(ordinals(words, ["less", "word"], name="rank").select("rank", "word", "n"), "ranked")
    # A word becomes some twenty entries: a small file of words is dealt out first.
    spread = ranked.select("rank", "word").repartition(max(spark.sparkContext.defaultParallelism, -(-ranked.count() // WORDS_A_TASK)), "rank")
    near = freeze(near_words(spread), "near")
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    forms = freeze(ranked.join(near, "rank").join(best, "best").where(F.col("form_n") >= times * F.col("n"))
                   .select("rank", "form", "form_n", F.col("best").alias("root")), "forms")
    roots = _roots(forms.select("rank", "root")).join(
        ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    named = forms.select("rank", "form", "form_n").join(roots, "rank")
    return (ranked.join(near.select("rank", "n_near"), "rank", "left").join(named, "rank", "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"))
