"""Byte-level BPE ids of many texts at once.

The ids are those of the vocabulary file for the ``tokenizers`` library. A text is cut before each
space that a non-space follows: the vocabulary's own pre-tokeniser always cuts there, so the
parts can be encoded one by one and each different part of a batch only once. The parts
go through ``tiktoken``, which holds the same vocabulary as ranks and is several times
faster; texts that spell out the special token go whole through ``tokenizers``, and
texts with other runs of blanks go whole through ``tiktoken``.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

SPECIAL = "<|endoftext|>"
CACHE = 200_000
#: A space before other white space or at the end: the cut of the pre-tokeniser is elsewhere.
_BLANK_RUN = (r" ([\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)")


@dataclass(frozen=True)
class Vocabulary:
    """Paths of one vocabulary in both forms; they are read where the work is done."""

    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    json: str = public_tokenizers.path("byte_bpe_50k.json")
    pattern: str = public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(vocabulary)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self._path = vocabulary.json
        self._exact: Tokenizer | None = None
        self.bytes_of = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)
        self.bytes_of[-1] = len(SPECIAL)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids: list[np.ndarray] = []

    def _whole(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        self._exact = self._exact or Tokenizer.from_file(self._path)
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parts(self, parts: list[str]) -> list[int]:
        """Numbers of the parts' ids in ``self._ids``; each part starts with a space."""
        new = [p for p in dict.fromkeys(parts) if p not in self._known]
        if new:
            ids = np.array(self._fast.encode_ordinary("".join(new)), np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in new])) + 1
            for part, i in zip(new, np.split(ids, cuts[:-1])):
                self._known[part] = len(self._ids)
                self._ids.append(i)
        return [self._known[p] for p in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry at the end). NULL has none."""
        if len(self._known) > CACHE:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.or_(pc.match_substring(texts, SPECIAL), pc.match_substring_regex(texts, _BLANK_RUN)))
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        flat, offsets = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
        later = np.ones(len(flat), bool)
        later[offsets[:-1]] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        numbers = np.array(self._parts([" " + p for p in coded.dictionary.to_pylist()]), np.int64)
        # Numbers beyond those of the parts are the first parts of texts, and whole texts.
        heads = [self._whole(t) for t in flat.take(pa.array(offsets[:-1])).to_pylist()]
        wholes = [self._whole(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        known = len(self._ids)
        pool = self._ids + heads + wholes
        counts = np.ones(len(texts), np.int64)
        counts[~odd] = np.diff(offsets)
        firsts = np.cumsum(counts) - counts
        which = np.empty(int(counts.sum()), np.int64)
        is_later = np.ones(len(which), bool)
        is_later[firsts] = False
        which[is_later] = numbers[np.asarray(coded.indices)] if len(numbers) else 0
        which[firsts[~odd]] = known + np.arange(len(heads))
        which[firsts[odd]] = known + len(heads) + np.arange(len(wholes))
        # Only the pool's used entries are laid out.
        used, which = np.unique(which, return_inverse=True)
        laid = [pool[i] for i in used.tolist()]
        sizes = np.array([len(i) for i in laid], np.int64)
        line = np.concatenate([np.zeros(0, np.uint32), *laid])
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        ids = line[np.repeat(begin[which] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]])
