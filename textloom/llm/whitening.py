"""Whitening along the leading principal components, by Jacobi-Davidson.

The covariance matrix is never built. Its product with a few vectors, ``Xc' (Xc W) / n``, is a job over the distinct vectors: each task
centres its blocks exactly (whole numbers less the whole part of the mean, then the fraction), multiplies, and adds up;
a partial sum has one row per dimension, and the shuffle adds those. The driver holds a few vectors of the length of the dimension.

1. *Rayleigh-Ritz*: the covariance within the search space gives Ritz pairs and their residuals.
2. *Locking*: leading pairs whose residuals are at the level of rounding are kept, and all else stays orthogonal to them.
3. *Correction*: for each open pair the projected equation ``(I - QQ')(V - theta I)(I - QQ') t = -r`` is solved roughly by a few MINRES
   steps, all pairs in one product per step; the solutions widen the search space. A space that has become too wide
   starts again from its leading Ritz vectors.

The number of jobs depends on the spectrum and not on the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.workspace import freeze

COMPONENTS = 16
BLOCK_ENTRIES = 1 << 18
#: Vectors in the first search space beyond those wanted, MINRES steps of a correction, widest space in multiples of the wanted.
SPARE, INNER, WIDEST = 8, 5, 5
#: A residual of this many roundings of the largest eigenvalue, times the root of the dimension, is double precision.
ROUNDINGS = 16
MOST_TURNS = 200
_EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the spaces (each orthonormal)."""
    known = np.hstack(spaces)
    for _ in range(2):
        new = new - known @ (known.T @ new)
        sizes = np.linalg.norm(new, axis=0)
        new = new[:, sizes > 0] / sizes[sizes > 0]
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * max(s.max(initial=0.0), 1e-300)]
    return new[:, :known.shape[0] - known.shape[1]]


def minres(apply: Product, right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Rough solutions of ``apply(t) = right`` for each column, from Lanczos vectors and plane rotations; ``apply``
    is symmetric and may differ by column, but not mix them."""
    def unit(v: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    solution = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    error = beta.copy()
    v_old, v = np.zeros_like(right), unit(right, beta)
    beta = np.zeros_like(beta)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        image = apply(v)
        alpha = np.sum(v * image, axis=0)
        image = image - alpha * v - beta * v_old
        beta_next = np.linalg.norm(image, axis=0)
        beta_next = np.where(beta_next > 1e-14 * np.abs(alpha), beta_next, 0.0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, beta_next)
        live = rho > 0
        safe = np.where(live, rho, 1.0)
        w_new = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / safe
        c_old, c, s_old, s = c, np.where(live, delta / safe, 1.0), s, np.where(live, beta_next / safe, 0.0)
        solution = solution + np.where(live, c * error, 0.0) * w_new
        error = -s * error
        v_old, v, w_old, w, beta = v, unit(image, beta_next), w, w_new, beta_next
        if np.all(np.abs(error) <= tolerance * start):
            break
    return solution


@dataclass
class Pairs:
    """Eigenvalues, falling; unit vectors as columns; norms of the residuals; products used."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def leading_pairs(product: Product, dimension: int, wanted: int, seed: int = 12) -> Pairs:
    """The ``wanted`` largest eigenpairs of the symmetric matrix behind ``product``, to double precision."""
    wanted = min(wanted, dimension)
    calls = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(block)

    locked, locked_image = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    basis, image = locked, locked
    new = np.random.default_rng(seed).standard_normal((dimension, min(dimension, wanted + SPARE)))
    for turn in range(MOST_TURNS):
        new = _orthonormal(new, locked, basis)
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
        else:  # nothing is left to add: only rounding in the images stands between
            image = times(basis)
        small = basis.T @ image
        theta, turned = np.linalg.eigh((small + small.T) / 2)
        theta, turned = theta[::-1], turned[:, ::-1]
        basis, image = basis @ turned, image @ turned
        locked_values = np.sum(locked * locked_image, axis=0)
        largest = max(np.abs(theta).max(initial=0.0), np.abs(locked_values).max(initial=0.0))
        enough = ROUNDINGS * _EPS * np.sqrt(dimension) * largest
        rest = wanted - locked.shape[1]
        residual = image[:, :rest] - basis[:, :rest] * theta[:rest]
        sizes = np.linalg.norm(residual, axis=0)
        done = int(np.argmax(np.append(sizes > enough, True)))
        locked, locked_image = np.hstack([locked, basis[:, :done]]), np.hstack([locked_image, image[:, :done]])
        basis, image, theta, residual = basis[:, done:], image[:, done:], theta[done:], residual[:, done:]
        if locked.shape[1] == wanted:
            values = np.sum(locked * locked_image, axis=0)
            order = np.argsort(-values, kind="stable")
            values, locked, locked_image = values[order], locked[:, order], locked_image[:, order]
            return Pairs(values, locked, np.linalg.norm(locked_image - locked * values, axis=0), calls)
        if basis.shape[1] > WIDEST * wanted:
            basis, image = basis[:, :wanted + SPARE], image[:, :wanted + SPARE]
        open_pairs = residual.shape[1]
        target, shift = basis[:, :open_pairs], theta[:open_pairs]
        if locked.shape[1] + basis.shape[1] >= dimension:
            new = np.zeros((dimension, 0))
            continue
        known = np.hstack([locked, target])

        def outside(block: np.ndarray) -> np.ndarray:
            return block - known @ (known.T @ block)

        new = minres(lambda t: outside(times(outside(t)) - shift * outside(t)), -outside(residual), INNER, 0.5 ** (turn + 2))
    raise RuntimeError(f"{wanted - locked.shape[1]} of {wanted} eigenpairs have not converged in {MOST_TURNS} turns")


def _pack(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: least numbers by dimension, what is above them in as few bytes as it takes, sums by dimension."""
    rows = max(1, BLOCK_ENTRIES // dimension)
    for batch in batches:
        x = np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, dimension)
        for at in range(0, len(x), rows):
            block = x[at:at + rows]
            low = block.min(axis=0)
            above = block - low  # wraps around where the span is beyond 63 bits, and back when the least is added
            width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not above.view(np.uint64).max() > np.iinfo(t).max)
            high = (block >> 32).sum(axis=0)
            sums = [Decimal((h << 32) + s) for h, s in zip(high.tolist(), (block & 0xFFFFFFFF).sum(axis=0).tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([len(block)], pa.int64()), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([np.dtype(width).itemsize], pa.int32()),
                pa.array([above.view(np.uint64).astype(width).tobytes()], pa.binary()),
                pa.array([sums], pa.list_(pa.decimal128(38, 0))),
            ], ["n", "low", "width", "above", "sums"])


@dataclass(frozen=True)
class Centre:
    """The mean as whole and fraction: ``S = n * whole + rest``."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def apart(self, x: np.ndarray) -> np.ndarray:
        """Vectors less the mean."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n


def _blocks(batches: Iterator[pa.RecordBatch], centre: Centre) -> Iterator[np.ndarray]:
    for batch in batches:
        for low, width, above in zip(batch.column("low").to_pylist(), batch.column("width").to_pylist(), batch.column("above")):
            high = np.frombuffer(above.as_buffer(), np.dtype(f"u{width}")).reshape(-1, len(low)).astype(np.int64)
            yield centre.apart(high + np.array(low, np.int64))


def _add_up(blocks: DataFrame, centre: Centre, terms: Callable[[np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """The sum of ``terms(centred block)``, a matrix of a bounded number of rows, over all blocks."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches, centre):
            part = terms(block)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, np.ascontiguousarray(total.T))],
                                             ["row", *[f"c{i}" for i in range(columns)]])

    schema = ", ".join(["row bigint", *[f"c{i} double" for i in range(columns)]])
    sums = blocks.select("low", "width", "above").mapInArrow(partial, schema).groupBy("row").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(columns)])
    rows = sums.toArrow().sort_by("row")  # as many rows as the matrix has
    return np.column_stack([np.asarray(rows[f"c{i}"]) for i in range(columns)])


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: the mean, components as columns of falling eigenvalue, and how far the whitened fit list is from unit covariance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from the distinct vectors of ``vectors (x array<bigint>)``, all of one length without NULL entries. Components whose variance is at
    the level of rounding are left out; None if none is left (no vectors, or all the same)."""
    some = vectors.select(F.size("x").alias("d")).where("d > 0").first()
    if some is None:
        return None
    dimension = some["d"]
    blocks = freeze(vectors.select("x").distinct().mapInArrow(
        lambda batches: _pack(batches, dimension),
        "n bigint, low array<bigint>, width int, above binary, sums array<decimal(38,0)>"), "vector-blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    sums = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    centre = Centre.of(n, [int(r["s"]) for r in sums])
    squares = _add_up(blocks, centre, lambda x: np.sum(x * x, axis=0)[:, None], 1)
    trace = float(squares.sum()) / n
    if not trace > 0:
        return None
    pairs = leading_pairs(lambda w: _add_up(blocks, centre, lambda x: x.T @ (x @ w), w.shape[1]) / n, dimension, components)
    real = pairs.values > ROUNDINGS * _EPS * dimension * pairs.values[0]
    values, vectors_ = pairs.values[real], pairs.vectors[:, real]
    scaled = vectors_ / np.sqrt(values)
    unit = _add_up(blocks, centre, lambda x: (x @ scaled).T @ (x @ scaled), len(values)) / n
    return Whitening(centre, values, vectors_, trace, pairs.residuals[real], float(np.abs(unit - np.eye(len(values))).max()))


def deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """The sum of ``(n * x - S)^2`` over the dimensions for each row, exact; NULL beyond 38 digits."""
    apart = x - centre.whole
    widest = int(np.abs(apart).max(initial=0))
    if len(centre.whole) * max(widest, centre.n) * widest < 1 << 62:
        squares, crossed = (apart * apart).sum(axis=1), apart @ centre.rest
    else:
        big = apart.astype(object)
        squares, crossed = (big * big).sum(axis=1), (big * centre.rest.astype(object)).sum(axis=1)
    rests = sum(r * r for r in centre.rest.tolist())
    n, most = centre.n, 10 ** 38
    if n * n * len(centre.whole) * (widest + 1) ** 2 < 1 << 62:
        return pa.array(n * n * squares.astype(np.int64) - 2 * n * crossed.astype(np.int64) + rests).cast(pa.decimal128(38, 0))
    exact = [n * n * int(a) - 2 * n * int(b) + rests for a, b in zip(squares.tolist(), crossed.tolist())]
    return pa.array([Decimal(e) if e < most else None for e in exact], pa.decimal128(38, 0))


def whiten(rows: DataFrame, id_column: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """``(<id>, component, n, deviation, whitened, explained, identity_error)`` for every row whose vector has the usual length,
    and every component that ``fit`` finds on the distinct ones.

    ``vector`` is ``array<bigint>``. Defined results: rows with a NULL vector, a NULL entry or no entries are left out, and so are rows
    whose length is not the one that most rows have (of equals, the longest); repeated rows and NULL ids stay; no rows, or equal
    vectors only, give no rows. ``deviation`` is a decimal of 38 digits, NULL beyond. Other columns are not read."""
    named = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()))
    usual = named.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = rows.schema[id_column].dataType.simpleString()
    schema = (f"`{id_column}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    model = None
    if usual is not None:
        named = named.where(F.size("x") == usual["d"])
        model = fit(named, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    scaled, k = model.vectors / np.sqrt(model.values), len(model.values)
    explained, names = model.values / model.trace, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_ENTRIES // len(scaled))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.asarray(part.column("x").flatten(), np.int64).reshape(-1, len(scaled))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                total = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(total, model.centre.n)), deviations(x, model.centre).take(each),
                    pa.array((model.centre.apart(x) @ scaled).reshape(-1)), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(total, model.identity_error))], names)

    return named.mapInArrow(project, schema)
