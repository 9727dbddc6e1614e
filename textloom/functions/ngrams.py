"""n-grams and blocks of one row's array.

Pass a plain column: an expression would be evaluated anew for every slice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by a space; none when there are fewer."""
    if n == 1:
        return words
    starts = F.sequence(F.lit(0), F.size(words) - n)
    grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def distinct_ratio(words: Column, n: int) -> Column:
    """Different n-grams over all n-grams; 0 when there are none."""
    grams = ngrams(words, n)
    share = F.size(F.array_distinct(grams)) / (F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, share).otherwise(F.lit(0.0))


def blocks(values: Column, block_size: int) -> Column:
    """Consecutive slices of at most ``block_size``; the last may be short."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(block_size))
    cut = F.transform(starts, lambda i: F.slice(values, i, F.lit(block_size)))
    none = F.slice(F.array(values), 1, 0)
    return F.when(F.size(values) > 0, cut).otherwise(none)
