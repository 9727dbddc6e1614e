"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word has two inputs: a vector of its own if the training texts hold it often enough, and the mean
vector of its character pairs, which unknown words have too. Both are projected once per
different word, so the recurrence costs two small matrix products per word. All overlapping
windows of ``LENGTH`` words, ``STRIDE`` apart, are scored; attention over the states of both directions
pools a window, and the highest window is the document's score.

The network is written and trained in numpy: on labelled documents, with the smooth maximum over
the windows as the document's value, so no window needs a label of its own. Training takes a *bounded*
sample: at most ``ROWS_PER_CLASS`` labelled documents of either class, in the order of a hash of their id, each of at
most ``TRAINING_BYTES`` bytes. Scoring covers every document and whole texts, as map tasks without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.ragged import spread_ranges
from textloom.llm.words import LOWER_ALNUM, find_words, mix, pieces

ROWS_PER_CLASS = 2000
TRAINING_BYTES = 32_768
LENGTH, STRIDE = 32, 16
WORD_DIM, PAIR_DIM, STATE = 12, 8, 8
PAIRS = 1024
VOCABULARY, LEAST_COUNT = 8192, 3
EPOCHS, BATCH, RATE = 6, 48, 0.01
LEAST_STEPS = 240
LIMIT = 0.3
WINDOWS_AT_ONCE = 4096


@dataclass
class Lexicon:
    """The different words of some texts: vocabulary row (0: unknown) and character pairs."""

    rows: np.ndarray
    pairs: np.ndarray
    sizes: np.ndarray


@dataclass
class Model:
    known: np.ndarray  # codes of the vocabulary, ascending
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None  # the score where nothing could be learnt


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1.0))


def read_words(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, Lexicon]:
    """``(first word of each text, lexicon number of each word, lexicon)``."""
    words = find_words(texts, LOWER_ALNUM)
    codes, example, number = np.unique(words.codes, return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
    rows = np.where(known[at] == codes, at + 1, 0) if len(known) else np.zeros(len(codes), np.int64)
    sizes = words.ends[example] - words.starts[example]
    chars = LOWER_ALNUM.folded()[words.data[spread_ranges(words.starts[example], sizes)]].astype(np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), chars[:-1]]) if len(chars) else chars
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    pairs = (mix(before * np.uint64(256) + chars) % np.uint64(PAIRS)).astype(np.int64)
    return words.first, number.astype(np.int64), Lexicon(rows, pairs, sizes)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first word, words)`` of each window; a text has one at least."""
    n = np.diff(first)
    counts = 1 + -(-np.maximum(n - LENGTH, 0) // STRIDE)
    text = np.repeat(np.arange(len(n)), counts)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    return text, first[text] + at, np.clip(n[text] - at, 0, LENGTH)


def _inputs(w: dict[str, np.ndarray], lex: Lexicon) -> np.ndarray:
    heads = np.cumsum(lex.sizes) - lex.sizes
    if not len(heads):
        return np.zeros((0, WORD_DIM + PAIR_DIM), np.float32)
    means = np.add.reduceat(w["pair"][lex.pairs], heads, axis=0) / lex.sizes[:, None].astype(np.float32)
    return np.concatenate([w["word"][lex.rows], means], 1)


def _grid(number: np.ndarray, start: np.ndarray, size: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Lexicon numbers of each window, step by step, and which steps have a word."""
    steps = np.arange(LENGTH)[:, None]
    mask = steps < size
    if not len(number):
        return np.full(mask.shape, blank), mask
    return np.where(mask, number[np.minimum(start + steps, len(number) - 1)], blank), mask


def _forward(w: dict[str, np.ndarray], projected: list[np.ndarray], grid: np.ndarray, mask: np.ndarray, trace: list | None = None):
    """Window values. ``trace`` takes what the way back needs."""
    n = grid.shape[1]
    states = np.zeros((LENGTH, n, 2 * STATE), np.float32)
    for way in (0, 1):
        h = np.zeros((n, STATE), np.float32)
        u = w[f"u{way}"]
        for t in range(LENGTH) if way == 0 else range(LENGTH - 1, -1, -1):
            x, a = projected[way][grid[t]], h @ u
            gates = _sigmoid(x[:, :2 * STATE] + a[:, :2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            new = np.tanh(x[:, 2 * STATE:] + r * a[:, 2 * STATE:])
            after = np.where(mask[t][:, None], z * h + (1 - z) * new, h)
            if trace is not None:
                trace.append((way, t, h, z, r, new, a[:, 2 * STATE:]))
            h = after
            states[t, :, way * STATE:(way + 1) * STATE] = h
    scores = np.where(mask, states @ w["attend"], np.float32(-1e9))
    share = np.exp(scores - scores.max(0)) * mask
    share /= np.maximum(share.sum(0), np.float32(1e-9))
    pooled = np.einsum("tn,tnk->nk", share, states)
    return pooled @ w["out"] + w["bias"][0], states, share, pooled


def _gradients(w: dict[str, np.ndarray], lex: Lexicon, number: np.ndarray, doc: np.ndarray, start: np.ndarray,
               size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of one batch of documents."""
    x = np.concatenate([_inputs(w, lex), np.zeros((1, WORD_DIM + PAIR_DIM), np.float32)])
    projected = [x @ w[f"in{way}"] + w[f"b{way}"] for way in (0, 1)]
    grid, mask = _grid(number, start, size, len(x) - 1)
    trace: list = []
    value, states, share, pooled = _forward(w, projected, grid, mask, trace)
    # Smooth maximum over each document's windows.
    top = np.full(len(y), -np.inf, np.float32)
    np.maximum.at(top, doc, value)
    raised = np.exp(value - top[doc])
    total = np.bincount(doc, raised, len(y)).astype(np.float32)
    error = (_sigmoid(top + np.log(total)) - y) / len(y)
    d_value = (error[doc] * raised / total[doc]).astype(np.float32)
    g = {"out": pooled.T @ d_value, "bias": d_value.sum(keepdims=True)}
    d_pooled = d_value[:, None] * w["out"]
    d_share = np.einsum("tnk,nk->tn", states, d_pooled)
    d_score = share * (d_share - (share * d_share).sum(0))
    g["attend"] = np.einsum("tn,tnk->k", d_score, states)
    d_states = share[:, :, None] * d_pooled + d_score[:, :, None] * w["attend"]
    d_in = [np.zeros((LENGTH, grid.shape[1], 3 * STATE), np.float32) for _ in (0, 1)]
    back = [np.zeros((grid.shape[1], STATE), np.float32) for _ in (0, 1)]
    for way in (0, 1):
        g[f"u{way}"] = np.zeros_like(w[f"u{way}"])
    for way, t, h, z, r, new, a_new in reversed(trace):
        d = back[way] + d_states[t, :, way * STATE:(way + 1) * STATE]
        on = mask[t][:, None]
        d_new = d * (1 - z) * (1 - new * new) * on
        d_z = d * (h - new) * z * (1 - z) * on
        d_r = d_new * a_new * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_new * r], 1)
        d_in[way][t] = np.concatenate([d_z, d_r, d_new], 1)
        g[f"u{way}"] += h.T @ d_a
        back[way] = np.where(on, d * z, d) + d_a @ w[f"u{way}"].T
    order = np.argsort(grid.reshape(-1), kind="stable")
    used, heads = np.unique(grid.reshape(-1)[order], return_index=True)
    d_x = np.zeros_like(x)
    for way in (0, 1):
        d_p = np.zeros((len(x), 3 * STATE), np.float32)
        d_p[used] = np.add.reduceat(d_in[way].reshape(-1, 3 * STATE)[order], heads, axis=0)
        d_p[-1] = 0
        g[f"in{way}"], g[f"b{way}"] = x.T @ d_p, d_p.sum(0)
        d_x += d_p @ w[f"in{way}"].T
    d_x = d_x[:-1]
    by = lambda keys, values, n: np.stack([np.bincount(keys, v, n) for v in values.T], 1).astype(np.float32)
    g["word"] = by(lex.rows, d_x[:, :WORD_DIM], len(w["word"]))
    g["word"][0] = 0
    g["pair"] = by(lex.pairs, np.repeat(d_x[:, WORD_DIM:] / lex.sizes[:, None], lex.sizes, axis=0), PAIRS)
    return g


def fit(texts: list[str], toxic: list[int], seed: int = 9) -> Model:
    """Train on whole texts. Without both classes the score is the constant share of toxic rows."""
    if len(set(toxic)) < 2:
        return Model(np.zeros(0, np.uint64), constant=float(np.mean(toxic)) if toxic else 0.0)
    rng = np.random.default_rng(seed)
    counted = [np.unique(find_words(pa.array([t]), LOWER_ALNUM).codes) for t in texts]
    codes, counts = np.unique(np.concatenate(counted), return_counts=True)
    keep = np.lexsort((codes, -counts))[:VOCABULARY]
    known = np.sort(codes[keep[counts[keep] >= LEAST_COUNT]])
    width = WORD_DIM + PAIR_DIM
    shape = {"word": (len(known) + 1, WORD_DIM), "pair": (PAIRS, PAIR_DIM), "attend": (2 * STATE,), "out": (2 * STATE,)}
    shape |= {f"in{way}": (width, 3 * STATE) for way in (0, 1)} | {f"u{way}": (STATE, 3 * STATE) for way in (0, 1)}
    w = {k: (rng.normal(size=s) * (0.5 if k in ("word", "pair") else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shape.items()}
    w |= {"b0": np.zeros(3 * STATE, np.float32), "b1": np.zeros(3 * STATE, np.float32), "bias": np.full(1, -3, np.float32)}
    w["word"][0] = 0
    y = np.array(toxic, np.float32)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    # Small samples get as many steps as larger ones need.
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            first, number, lex = read_words(pa.array([texts[i] for i in rows]), known)
            g = _gradients(w, lex, number, *windows_of(first), y[rows])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k in w:
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] * g[k] - square[k])
                w[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return Model(known, w)


def predict(model: Model, texts: pa.Array) -> np.ndarray:
    """A score for each text."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    w = model.weights
    first, number, lex = read_words(texts, model.known)
    x = np.concatenate([_inputs(w, lex), np.zeros((1, WORD_DIM + PAIR_DIM), np.float32)])
    projected = [x @ w[f"in{way}"] + w[f"b{way}"] for way in (0, 1)]
    text, start, size = windows_of(first)
    top = np.full(len(texts), -np.inf, np.float32)
    for at in range(0, len(text), WINDOWS_AT_ONCE):
        own = slice(at, at + WINDOWS_AT_ONCE)
        np.maximum.at(top, text[own], _forward(w, projected, *_grid(number, start[own], size[own], len(x) - 1))[0])
    return 1 / (1 + np.exp(-top.astype(np.float64)))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, most_bytes: int = TRAINING_BYTES) -> Model:
    """Fit on the labelled rows of ``docs`` outside the held-out fold. The sample is at most
    ``2 * rows_per_class`` rows of at most ``most_bytes`` bytes."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    turn = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Twice as many ids as rows are wanted, for those whose text is too long or missing.
    picked = [marked.where(F.col("toxic") == k).orderBy(*turn).limit(2 * rows_per_class) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    texts = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = [texts.where(F.col("toxic") == k).orderBy(*turn, "text").limit(rows_per_class).collect() for k in (0, 1)]
    return fit([r.text for part in rows for r in part], [r.toxic for part in rows for r in part])


def _score(batches: Iterator[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(predict(model, part.column("text")))], [*part.schema.names, name])


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Every row of ``docs`` (``text`` and others) with its score as column ``name``.

    Defined results: NULL, empty and word-free texts get the network's value of an empty window; repeated rows
    score alike; no rows give no rows; NULL ids score as any other; a column of that name is replaced. Only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(name)
    # Names that functions over batches take, whatever the columns are called.
    plain = rows.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(rows.columns)])
    schema = plain.select("*", F.lit(0.0).alias("score")).schema
    return plain.mapInArrow(lambda batches: _score(batches, shared.value, "score"), schema).toDF(*rows.columns, name)
