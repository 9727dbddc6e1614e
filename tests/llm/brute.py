"""The operators' definitions, row by row, to compare results with."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=BLANKS, lower=False):
    return re.findall(pattern, ((text or "").translate(LOWER) if lower else text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, n=13):
    """``(doc_id, n_words, n_removed, kept_sha256)`` of ``(doc_id, text)`` rows."""
    last = float("inf")
    split = [(last if d is None else d, words(t)) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            first[key] = min(d, first.get(key, last))
    out = []
    for (d, w), (name, _) in zip(split, docs):
        gone = {k for i in range(len(w) - n + 1) if first[tuple(w[i:i + n])] < d for k in range(i, i + n)}
        out.append((name, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(docs, items, n=13):
    patterns = defaultdict(set)
    for name, text in items:
        w = words(text, ALNUM, True)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if size else ():
            patterns[tuple(w[i:i + size])].add("" if name is None else str(name))
    sizes = {len(p) for p in patterns}
    out = []
    for d, text in docs:
        w = words(text, ALNUM, True)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in patterns:
                    hit |= set(range(i, i + size))
                    found |= patterns[tuple(w[i:i + size])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text, n=5):
    w = words(text, lower=True)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near(docs, percent=75):
    """``{doc_id: (n_shingles, component_id)}``; one row per id."""
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = Counter((a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1:])
    to = {d: d for d in sets}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            to[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def random_text(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))
