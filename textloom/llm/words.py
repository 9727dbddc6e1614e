"""Words of many texts at once: byte spans and 64-bit codes by array operations.

A batch of texts is one buffer of UTF-8 bytes. A table of 256 entries tells separators
from word bytes and can fold case, so words are found and hashed without a Python
object per word. Work arrays are bounded by ``PIECE`` bytes of text at a time, or
by one text or one word where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class WordRule:
    """``breaks``: bytes between words. ``lower``: A-Z count as a-z."""

    breaks: bytes
    lower: bool = False

    def is_word(self) -> np.ndarray:
        table = np.ones(256, bool)
        table[list(self.breaks)] = False
        return table

    def folded(self) -> np.ndarray:
        table = np.arange(256, dtype=np.uint8)
        if self.lower:
            table[65:91] += 32
        return table


BLANKS = WordRule(bytes([0x20, *range(0x09, 0x0E)]))
LOWER_BLANKS = WordRule(BLANKS.breaks, lower=True)
#: Digits, letters and everything beyond ASCII are words, in lower case.
LOWER_ALNUM = WordRule(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLY)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        steps = np.full(max(n + 1, PIECE + 1), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= PIECE:
            _powers[base] = known
    return known


@dataclass
class Words:
    data: np.ndarray  # bytes of the texts, as they are
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text its first word's number; one more entry at the end
    codes: np.ndarray

    def text_of(self) -> np.ndarray:
        """Number of the text for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to its text's end, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE, also: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text in one or two columns, or one row where that has more."""
    if not batch.num_rows:
        return
    ends = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64)
                         for c in (column, also) if c))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def find_words(texts: pa.Array, rule: WordRule) -> Words:
    """The words of all texts; NULL has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = rule.is_word()[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    some = np.flatnonzero(np.diff(offsets) > 0)
    heads, tails = offsets[some], offsets[some + 1] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), _codes(data, starts, ends, rule))


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: WordRule) -> np.ndarray:
    """Polynomial hashes by differences of one running sum, mixed with the length."""
    table = _BYTE_CODES[rule.folded()]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        part = data[base:ends[upto - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _power(_BASE, len(part))[:len(part)], out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (sums[e] - sums[s]) * _power(_INVERSE, len(part))[s] + (e - s).astype(np.uint64)
        at = upto
    return mix(out)


def runs(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of the ``n`` words from each place on; the last ``n - 1`` places have none.
    Places whose run leaves its text are the caller's to leave out."""
    size = max(0, len(codes) - n + 1)
    out = codes[:size].copy()
    for i in range(1, n):
        out *= _MULTIPLY
        out += codes[i:i + size]
    return mix(out)


def joined(words: Words, lo: int, hi: int, folded: np.ndarray) -> bytes:
    """Words ``lo`` to ``hi - 1`` with one space between."""
    return b" ".join(folded[s:e].tobytes() for s, e in zip(words.starts[lo:hi], words.ends[lo:hi]))
