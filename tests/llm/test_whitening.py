"""Whitening against a dense eigensolver, and the parts of Jacobi-Davidson on their own."""

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.queries import op12_embedding_whitening
from textloom.llm.whitening import Centre, _pack, deviations, leading_pairs, minres, whiten


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * np.asarray(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 1.05, 64), np.exp(-np.arange(64) / 3), np.r_[[5.0, 4, 3], np.zeros(37)], np.r_[np.full(20, 2.0), np.linspace(0, 1, 60)],
    np.linspace(0, 1, 250), [3.0], [2.0, 2.0],
], ids=["close", "steep", "rank 3", "equal", "restarts", "one", "two"])
def test_leading_pairs(values):
    a = matrix(values)
    found = leading_pairs(lambda w: a @ w, len(a), 16)
    want = np.sort(values)[::-1][:16]
    assert np.abs(found.values - want).max() < 1e-13 * want[0] * np.sqrt(len(a))
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(want))).max() < 1e-13
    assert np.linalg.norm(a @ found.vectors - found.vectors * found.values, axis=0).max() < 1e-13 * want[0] * np.sqrt(len(a))


def test_minres_solves_indefinite_systems():
    a = matrix(np.r_[np.linspace(-2, -1, 5), np.linspace(1, 3, 15)])
    right = np.random.default_rng(1).standard_normal((20, 4))
    right[:, 3] = 0
    shift = np.array([0.0, 0.5, -0.2, 0.1])
    found = minres(lambda t: a @ t - t * shift, right, 40, 1e-13)
    assert np.abs(a @ found - found * shift - right).max() < 1e-9
    # Each step makes the residual smaller.
    sizes = [np.linalg.norm(right[:, 0] - a @ minres(lambda t: a @ t, right[:, :1], n, 0)[:, 0]) for n in range(1, 20)]
    assert all(x >= y - 1e-12 for x, y in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("span", [1, 200, 1 << 20, 1 << 40, 1 << 62])
def test_blocks_and_deviations_are_exact(span):
    rng = np.random.default_rng(span % 97)
    x = rng.integers(-span, span + 1, (50, 7))
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int64()))], ["x"])
    low, width, above, sums = ([r[c] for b in _pack(iter([batch]), 7) for r in b.to_pylist()][0] for c in ("low", "width", "above", "sums"))
    back = np.frombuffer(above, f"u{width}").reshape(-1, 7).astype(np.int64) + np.array(low)
    assert (back == x).all() and [int(s) for s in sums] == [sum(map(int, c)) for c in x.T]
    if span < 1 << 40:
        for times in (1, 10 ** 6):
            n, s = 50 * times, [sum(map(int, c)) * times for c in x.T]
            want = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
            assert [None if v is None else int(v) for v in deviations(x, Centre.of(n, s)).to_pylist()] == [v if v < 10 ** 38 else None for v in want]


def test_whiten_equals_dense(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((400, 20)) @ (rng.standard_normal((20, 20)) * np.linspace(1, 9, 20)) * 8).astype(int) + 1000000
    rows = [(i, r.tolist(), 7) for i, r in enumerate(x)] + [(None, x[0].tolist(), 7), (3, x[5].tolist(), 7)]
    odd = [(900, None, 7), (901, [], 7), (902, [1, None], 7), (903, [1, 2], 7)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, x array<bigint>, component int").repartition(5)
    got = whiten(df, "vec_id", "x").collect()
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    white = (x - s / n) @ (u / np.sqrt(e))
    assert len(got) == 16 * len(rows)
    sign = {r.component: np.sign(r.whitened * white[0, r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        i = 0 if r.vec_id is None else r.vec_id
        if r.vec_id == 3:
            continue
        assert abs(r.whitened * sign[r.component] - white[i, r.component - 1]) < 1e-9
        assert r.n == n and int(r.deviation) == int(((n * x[i] - s) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / (np.cov(fit.T, bias=True).trace())) < 1e-12 and r.identity_error < 1e-12


def test_degenerate(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, x array<bigint>")
    assert whiten(make([]), "vec_id", "x").collect() == []
    assert whiten(make([("a", [1, 2]), ("b", [1, 2]), ("c", None)]), "vec_id", "x").collect() == []
    got = whiten(make([("a", [1, 5]), ("b", [3, 5]), ("b", [3, 5])]), "vec_id", "x").collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), abs(round(r.whitened, 12)), r.explained) for r in got) == [
        ("a", 1, 2, 4, 1.0, 1.0), ("b", 1, 2, 4, 1.0, 1.0), ("b", 1, 2, 4, 1.0, 1.0)]


def test_query_leaves_out_unusable_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.standard_normal(3)]) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, [-float("inf"), 0.0, 0.0])]
    spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_embedding_whitening(spark, str(tmp_path)).collect()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(np.float64)).astype(int) + 1000000
    n, s = len(np.unique(x, axis=0)), np.unique(x, axis=0).sum(axis=0)
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in range(50) for c in (1, 2, 3)} and len(got) == 150
    assert all(r.deviation == ((n * x[r.vec_id] - s) ** 2).sum() and r.n == n for r in got)
