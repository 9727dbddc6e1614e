"""Token counts of a document's sections, from one encoding of the whole document.

Encoding sections one by one gives other tokens than the document has, because a token may
cross a border. Here a document is encoded once, each token gets its interval of characters, and
intervals are joined to the sections of the same document; both are sorted, so the join is a
binary search. A token that crosses a border is allocated by a rule:

* ``start``: to the section of its first character;
* ``most``: to the section with most of its characters, the first of equals;
* ``split``: to each section by its share of characters.

Sections are given by a separator: each section runs through the end of its separator, so the sections
cover the text and every token is allocated once. All of a document lies in one row, hence nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.encoder import Vocabulary, encoder
from textloom.llm.words import pieces

RULES = ("start", "most", "split")
TEXT_BYTES = 4 << 20
_SECTIONS = "doc_id bigint, section int, start bigint, length bigint, n_tokens double, n_crossing bigint"


def sections(text: str, separator: str) -> list[int]:
    """Where each section begins; an empty text has one empty section."""
    out, at = [0], text.find(separator)
    while at >= 0 and at + len(separator) < len(text):
        out.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    return out


def character_spans(text: str, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and one past the last of each token. A token that holds a part of a character counts
    as holding all of it."""
    data = np.frombuffer(text.encode(), np.uint8)
    number = np.cumsum((data & 0xC0) != 0x80)  # of characters begun up to each byte
    end = np.cumsum(token_bytes)
    return number[end - token_bytes] - 1, number[end - 1]


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens there cross a border (counted where they begin)."""
    n = len(borders)
    low = np.searchsorted(borders, starts, "right") - 1
    high = np.searchsorted(borders, ends - 1, "right") - 1
    crossing = np.flatnonzero(high > low)
    counts = np.bincount(low, minlength=n).astype(np.float64)
    closing = np.append(borders[1:], np.iinfo(np.int64).max)
    for i in crossing.tolist() if rule != "start" else ():
        own = np.arange(low[i], high[i] + 1)
        shares = np.minimum(ends[i], closing[own]) - np.maximum(starts[i], borders[own])
        counts[low[i]] -= 1
        if rule == "most":
            counts[own[np.argmax(shares)]] += 1
        else:
            counts[own] += shares / shares.sum()
    return counts, np.bincount(low[crossing], minlength=n)


def _count(batches: Iterator[pa.RecordBatch], separator: str, rule: str, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for batch in batches:
        for part in pieces(batch, "text", TEXT_BYTES):
            ids, bounds = enc.encode(part.column("text"))
            sizes = enc.bytes_of[ids]
            rows: list[list] = [[], [], [], [], [], []]
            for key, text, lo, hi in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                text = text or ""
                borders = np.array(sections(text, separator), np.int64)
                counts, crossing = allocate(*character_spans(text, sizes[lo:hi]), borders, rule)
                for column, values in zip(rows, ([key] * len(borders), range(len(borders)), borders, np.diff(np.append(borders, len(text))), counts, crossing)):
                    column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                             ["doc_id", "section", "start", "length", "n_tokens", "n_crossing"])


def section_tokens(docs: DataFrame, separator: str = "\n", rule: str = "start", vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per section of every document: ``doc_id``, ``section`` (from 0), ``start`` and ``length`` in
    characters, ``n_tokens`` and ``n_crossing`` (tokens that begin here and end in a later section).

    Defined results: NULL and empty texts are one empty section without tokens; a separator at the very end
    opens no section; repeated rows are each counted; a NULL doc_id stays NULL; no rows give no rows; other
    columns are not read."""
    if rule not in RULES or not separator:
        raise ValueError(f"rule must be one of {RULES}, and the separator not empty")
    vocabulary = vocabulary or Vocabulary()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _count(batches, separator, rule, vocabulary), _SECTIONS)
