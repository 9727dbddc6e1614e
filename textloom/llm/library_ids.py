"""Byte-level BPE ids of many texts by the ``tokenizers`` library itself.

A text is cut before each space that a non-space follows, where the vocabulary's pre-tokeniser always cuts, too (see ``encoder``). Each
different part is encoded once and kept, many new parts in one call: put together they are a text whose cuts are known, and its
ids are dealt to the parts by their bytes. Texts with other runs of blanks or with the special token written out go whole to the library.

Parts are kept in two generations: when the younger is full it becomes the older, whose parts move over when they are
used again; what is not used for a whole generation is forgotten. So frequent parts stay and memory is bounded.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from textloom.llm.encoder import _BLANK_RUN, SPECIAL, Vocabulary

GENERATION = 400_000
PARTS_A_CALL = 10_000


class LibraryIds:
    def __init__(self, vocabulary: Vocabulary):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._library = Tokenizer.from_file(vocabulary.json)
        self.size = self._library.get_vocab_size()
        # A token is spelled with one letter per byte, but for the special one.
        self._bytes = np.zeros(self.size, np.int64)
        for token, i in self._library.get_vocab().items():
            self._bytes[i] = len(token)
        self._young: dict[str, int] = {}
        self._old: dict[str, int] = {}
        self._keep(np.zeros(0, np.int64))

    def _keep(self, numbers: np.ndarray) -> None:
        """Hold the ids of these parts only, numbered anew."""
        if len(numbers):
            begin, size = self._begin[numbers], self._size[numbers]
            ends = np.cumsum(size)
            line = self._line[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))]
        else:
            size, ends, line = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint32))
        self._line, self._begin, self._size = line, ends - size, size

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append parts; the number of the first."""
        first, at = len(self._begin), len(self._line)
        self._line = np.concatenate([self._line, ids])
        self._begin = np.concatenate([self._begin, at + np.cumsum(sizes) - sizes])
        self._size = np.concatenate([self._size, sizes])
        return first

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of different parts, each of which starts with a space."""
        young, old, new, out = self._young, self._old, [], []
        for part in parts:
            number = young.get(part)
            if number is None:
                number = old.get(part)
                if number is None:
                    number = -1
                    new.append(part)
                else:
                    young[part] = number
            out.append(number)
        numbers = np.array(out, np.int64)
        if new:
            ids, sizes = [], []
            for at in range(0, len(new), PARTS_A_CALL):
                held = new[at:at + PARTS_A_CALL]
                own = self._encode(["".join(held)])[0]
                upto = np.searchsorted(np.cumsum(self._bytes[own]), np.cumsum([len(p.encode()) for p in held])) + 1
                ids.append(own)
                sizes.append(np.diff(upto, prepend=0))
            first = self._add(np.concatenate(ids), np.concatenate(sizes))
            numbers[numbers < 0] = first + np.arange(len(new))
            young.update(zip(new, range(first, first + len(new))))
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry at the end). NULL has none."""
        if len(self._young) > GENERATION:
            self._keep(np.fromiter(self._young.values(), np.int64, len(self._young)))
            self._old, self._young = dict(zip(self._young, range(len(self._young)))), {}
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.or_(pc.match_substring(texts, SPECIAL), pc.match_substring_regex(texts, _BLANK_RUN)))
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        flat, offsets = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
        later = np.ones(len(flat), bool)
        later[offsets[:-1]] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        numbers = self._numbers([" " + p for p in coded.dictionary.to_pylist()])
        # First parts and whole texts are encoded one by one and held for this call.
        single = self._encode(flat.take(pa.array(offsets[:-1])).to_pylist()) + self._encode(texts.filter(pa.array(odd)).to_pylist())
        parts, line_size = len(self._begin), len(self._line)
        if single:
            self._add(np.concatenate(single), np.array([len(i) for i in single], np.int64))
        counts = np.ones(len(texts), np.int64)
        counts[~odd] = np.diff(offsets)
        firsts = np.cumsum(counts) - counts
        which = np.empty(int(counts.sum()), np.int64)
        is_later = np.ones(len(which), bool)
        is_later[firsts] = False
        which[is_later] = numbers[np.asarray(coded.indices)] if len(numbers) else 0
        ordinary = np.flatnonzero(~odd)
        which[firsts[ordinary]] = parts + np.arange(len(ordinary))
        which[firsts[odd]] = parts + len(ordinary) + np.arange(int(odd.sum()))
        lengths = self._size[which]
        ends = np.cumsum(lengths)
        ids = self._line[np.repeat(self._begin[which] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self._line, self._begin, self._size = self._line[:line_size], self._begin[:parts], self._size[:parts]
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]])
