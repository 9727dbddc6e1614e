import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import budget, shards
from textloom.workspace import freeze


def sources(seed, n=60):
    rnd = random.Random(seed)
    data = {s: [(i, rnd.choice([0, 1, 3, 10, 50, 400])) for i in range(rnd.randrange(1, n))] for s in "abcdef"}
    data["g"] = [(0, 1000)]
    data["h"] = [(0, 0), (1, 0)]
    return data


def frame(spark, data):
    return spark.createDataFrame([(s, k, n) for s, rows in data.items() for k, n in rows],
                                 "source string, k bigint, n_tok bigint")


def admitted(df, admit, target, cell):
    rows = admit(df, F.lit(target), ["k"], ["source"], rows_per_cell=cell).select("source", "k").collect()
    return {s: sorted(r.k for r in rows if r.source == s) for s in {r.source for r in rows}}


@pytest.mark.parametrize("cell", [1 << 20, 13])
@pytest.mark.parametrize("target", [0, 1, 100, 400, 1000, 10**6])
def test_capped_budget(spark, target, cell):
    """Rows with tokens form a prefix within 1 % above the target, and the next such row either finds the
    target met or would go beyond that."""
    data = sources(target)
    got = admitted(frame(spark, data), budget.admit_capped, target, cell)
    for s, rows in data.items():
        real = [(k, n) for k, n in rows if n > 0]
        taken = got.get(s, [])
        assert taken == [k for k, _ in real[:len(taken)]]
        total = sum(n for _, n in real[:len(taken)])
        assert total <= int(target * 1.01)
        assert sum(n for _, n in real[:len(taken) - 1]) < target or not taken
        for _, n in real[len(taken):len(taken) + 1]:
            assert total >= target or total + n > int(target * 1.01)


@pytest.mark.parametrize("cell", [1 << 20, 13])
@pytest.mark.parametrize("target", [0, 1, 100, 400, 1000, 10**6])
def test_crossing_budget(spark, target, cell):
    """The shortest prefix that is not empty and reaches the target, or else all rows."""
    data = sources(target)
    got = admitted(frame(spark, data), budget.admit_crossing, target, cell)
    for s, rows in data.items():
        taken = got[s]
        assert taken == [k for k, _ in rows[:len(taken)]]
        assert len(taken) == len(rows) or sum(n for _, n in rows[:len(taken)]) >= target
        assert len(taken) == 1 or sum(n for _, n in rows[:len(taken) - 1]) < target


@pytest.mark.parametrize("small_table,max_bounds,cell", [(1 << 20, 1 << 20, 1 << 20), (0, 1 << 20, 11), (0, 0, 17)])
@pytest.mark.parametrize("size", [1, 60, 400])
def test_greedy_shards_are_full_and_minimal(spark, size, small_table, max_bounds, cell):
    from textloom.operators.ordered import running_totals

    data = sources(7 * size)
    run = freeze(running_totals(frame(spark, data), ["k"], {"running": F.col("n_tok")}, ["source"], cell))
    bounds = freeze(shards.greedy_bounds(run, size, ["k"], small_table=small_table, rows_per_cell=cell))
    got = shards.assign_shards(run, bounds, ["k"], max_bounds=max_bounds, rows_per_cell=cell).collect()
    shard = {(r.source, r.k): r.shard_id for r in got}
    for s, rows in data.items():
        ids = [shard[s, k] for k, _ in rows]
        assert ids == sorted(ids) and set(ids) == set(range(ids[-1] + 1))
        for i in set(ids):
            own = [n for j, (_, n) in zip(ids, rows) if j == i]
            assert sum(own[:-1]) < size  # nothing but the last row fills a shard
            assert sum(own) >= size or i == ids[-1]


@pytest.mark.parametrize("max_bounds", [1 << 20, 0])
def test_uniform_shards_keep_their_ids(spark, max_bounds):
    from textloom.operators.ordered import running_totals

    data = {"a": [(i, n) for i, n in enumerate([3, 50, 2, 2, 70, 1])], "b": [(0, 5)]}
    run = running_totals(frame(spark, data), ["k"], {"running": F.col("n_tok")}, ["source"])
    uniform = freeze(shards.uniform_shards(run, 10))
    bounds = freeze(shards.last_keys(uniform, ["k"]))
    got = shards.assign_shards(frame(spark, data), bounds, ["k"], max_bounds=max_bounds).collect()
    want = {(r.source, r.k): r.shard_id for r in uniform.collect()}
    assert {(r.source, r.k): r.shard_id for r in got} == want
    assert want[("a", 4)] == 5


def test_many_bounds_cost_a_document_little(spark):
    """A row meets arrays of the square root of the number of bounds."""
    import time

    docs = spark.range(20_000).selectExpr("'a' AS source", "id * 10 AS k")
    took = []
    for n in (100, 200_000):
        bounds = freeze(spark.range(n).selectExpr("'a' AS source", "id AS shard_id", f"named_struct('k0', id * {200_000 // n}) AS last_key"))
        start = time.time()
        got = shards.assign_shards(docs, bounds, ["k"]).selectExpr("min(shard_id) lo", "max(shard_id) hi", "count(*) n").first()
        took.append(time.time() - start)
        assert (got.lo, got.hi, got.n) == (0, n, 20_000) if n == 100 else got.lo == 0 and got.hi == 199_990
    assert took[1] < 25
