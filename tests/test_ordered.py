import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ordered
from textloom.workspace import freeze


def make(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "a", "a", "b"]), i * 7 + rnd.randrange(7), rnd.randrange(5)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, k bigint, n bigint").repartition(5)


@pytest.mark.parametrize("rows_per_cell", [1 << 20, 60, 7])
def test_running_totals_match_loop(spark, rows_per_cell):
    rows, df = make(spark)
    want, acc = {}, {}
    for g, k, n in sorted(rows, key=lambda r: r[1]):
        c, o = acc.get(g, (0, 0))
        acc[g] = (c + n, o + 1)
        want[(g, k)] = acc[g]
    got = ordered.running_totals(df, ["k"], {"c": F.col("n"), "o": F.lit(1)}, ["g"], rows_per_cell)
    assert {(r.g, r.k): (r.c, r.o) for r in got.collect()} == want


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_partitioning_does_not_matter(spark, parts):
    rows, df = make(spark, 200, 3)
    got = ordered.ordinals(df.repartition(parts), ["k", "n"], rows_per_cell=20)
    want = {k: i for i, (_, k, _) in enumerate(sorted(rows, key=lambda r: r[1]), 1)}
    assert {r.k: r.ord for r in got.collect()} == want


def test_no_single_partition_exchange_of_rows(spark):
    _, df = make(spark)
    got = ordered.running_totals(df, ["k"], {"c": F.col("n")}, rows_per_cell=30)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    single = [i for i, line in enumerate(plan.split("\n")) if "SinglePartition" in line]
    # Only the cell totals meet in one partition, not the rows.
    assert all(any(word in "\n".join(plan.split("\n")[i:i + 6]) for word in ("HashAggregate", "ObjectHashAggregate")) for i in single)
    assert "rangepartitioning" not in plan


def test_rows_are_dealt_out_once(spark):
    """With groups, NULL among them, the rows meet their cell's offset where the window left them."""
    rows = [(g, i, 1) for i in range(400) for g in ("a", None)]
    df = freeze(spark.createDataFrame(rows, "g string, k bigint, n bigint").repartition(5))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ordered.running_totals(df, ["k"], {"c": F.col("n")}, ["g"], rows_per_cell=30)
        assert {(r.g, r.k): r.c for r in got.collect()} == {(g, i): i + 1 for g, i, _ in rows}
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tops = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    # The rows, the totals' partial sums, and the offsets, none of which the rows take part in.
    assert len(tops) <= 4 and sum("coalesce" in line for line in tops) == 0
    window = plan[:plan.index("Window")]
    assert "Exchange" not in window.split("SortMergeJoin")[-1]


def test_two_rows_of_one_key_end_the_job(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 2)], "g string, k bigint")
    for cell in (1 << 20, 1):
        with pytest.raises(Exception, match="two rows have the order key"):
            ordered.ordinals(df, ["k"], ["g"], rows_per_cell=cell).collect()
    assert ordered.ordinals(df.distinct(), ["k"], ["g"]).count() == 3


def test_a_hundred_thousand_cells(spark):
    """The literal in the plan keeps its size, each range's borders are made apart, and all running values are right."""
    n = 200_000
    df = freeze(spark.range(n).select((F.col("id") * 3).alias("k"), (F.col("id") % 7).alias("v"), F.pmod(F.xxhash64("id"), F.lit(9)).alias("_o"))
                .repartition(16, "_o").drop("_o"))
    placed, cells = ordered._with_cells(df, ["k"], 2)
    assert cells == (ordered.FAN + 1) * ordered.FAN
    sizes = placed.groupBy(ordered.CELL).count().agg(F.count(F.lit(1)).alias("cells"), F.max("count").alias("most")).first()
    assert sizes.cells > 60_000 and sizes.most < 40
    tree = placed._jdf.queryExecution().optimizedPlan().toString()
    assert len(tree) < 200 * ordered.FAN
    got = ordered.running_totals(df, ["k"], {"s": F.col("v"), "o": F.lit(1).cast("bigint")}, rows_per_cell=2).toPandas().sort_values("k")
    v = np.arange(n) % 7
    assert (got.s.to_numpy() == np.cumsum(v)).all() and (got.o.to_numpy() == np.arange(1, n + 1)).all()


@pytest.mark.parametrize("fan", [2, 3, 7])
def test_small_trees(spark, monkeypatch, fan):
    monkeypatch.setattr(ordered, "FAN", fan)
    rows, df = make(spark, 150, 5)
    for limit in (1 << 25, 0):  # sent to all tasks, and joined
        monkeypatch.setattr(ordered, "MOST_BROADCAST", limit)
        got = ordered.running_totals(df, ["k"], {"c": F.col("n")}, ["g"], 4)
        want, acc = {}, {}
        for g, k, n in sorted(rows, key=lambda r: r[1]):
            acc[g] = acc.get(g, 0) + n
            want[(g, k)] = acc[g]
        assert {(r.g, r.k): r.c for r in got.collect()} == want
    cells = ordered.cells_by_weight(df, ["k"], "n", 5, 20).orderBy("k").collect()
    line = 0
    for r in cells:
        assert r[ordered.CELL] == line // 5 and r._before <= line
        line += r.n


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_prefixes_reach_the_scan(spark, tmp_path, keys):
    rnd = random.Random(len(keys))
    some = lambda *v: rnd.choice([None, *v])
    rows = sorted({(some(1, 2, 3), some("x", "y"), some(1.5, 2.5, float("inf"))) for _ in range(80)}, key=lambda r: [(v is not None, v) for v in r])
    firsts = {}
    for r in rows:  # unique in the keys
        firsts.setdefault(r[:len(keys)], r)
    rows = list(firsts.values())
    spark.createDataFrame([(*r, s) for r in rows for s in ("p", "q", None)], "a int, b string, c double, g string").repartition(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    one = df.where("g = 'p'")
    for n in range(len(rows) + 2):
        got = ordered.prefix(one, n, keys)
        assert {tuple(r)[:3] for r in got.collect()} == set(rows[:n])
        if 0 < n <= len(rows):
            plan = got._jdf.queryExecution().executedPlan().toString()
            pushed = [line for line in plan.split("\n") if "PushedFilters" in line or "Filter" in line]
            assert any("LessThanOrEqual(a" in line or "IsNull(a)" in line for line in pushed)
    cut = freeze(ordered.key_cutoffs(df.where(ordered.up_to(keys, rows[len(rows) // 2], ordered._types(df, keys)) & F.expr("g = 'p'")
                                              | ordered.up_to(keys, rows[3], ordered._types(df, keys)) & F.expr("g <=> NULL OR g = 'q'")), keys, ["g"]))
    want = {(r, "p") for r in rows[:len(rows) // 2 + 1]} | {(r, "q") for r in rows[:4]}
    for most in (64, 1):
        ordered.MOST_CUTOFFS, before = most, ordered.MOST_CUTOFFS
        got = ordered.take_prefix(df, cut, keys, ["g"]).select("a", "b", "c", "g")
        ordered.MOST_CUTOFFS = before
        assert {(tuple(r)[:3], r.g) for r in got.collect()} == want


@pytest.mark.parametrize("size", [10, 37, 1000])
@pytest.mark.parametrize("k", [1, 2, 5, 50])
def test_trailing_average(spark, k, size):
    y = [float((i * 37) % 101) for i in range(120)]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(y)], "run string, i bigint, y double")
    got = ordered.trailing_average(df, k, "y", "i", ["run"], "m", rows_per_block=size)
    out = {r.i: r.m for r in got.collect()}
    for i in range(len(y)):
        part = y[max(0, i - k + 1): i + 1]
        assert out[i + 1] == pytest.approx(sum(part) / len(part), abs=1e-12)
    assert len(out) == len(y)


@pytest.mark.parametrize("cell", [1 << 20, 25, 3])
def test_exponential_average(spark, cell):
    y = [float((i * 53) % 97) for i in range(150)]
    rows = [(g, i, v + (g == "b")) for g in "ab" for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "run string, i bigint, y double")
    out = {(r.run, r.i): r.e for r in ordered.exponential_average(df, 0.9, "y", ["i"], "run", "e", cell).collect()}
    for g in "ab":
        prev = None
        for i, v in enumerate(y):
            v = v + (g == "b")
            prev = v if prev is None else 0.9 * prev + (1 - 0.9) * v
            assert out[(g, i)] == pytest.approx(prev, abs=1e-9)
    assert len(out) == 300


KEYS = {
    "date": "date_add(DATE'1999-01-01', CAST(i AS INT))",
    "timestamp": "timestamp_micros(CAST(i * 1000003 AS BIGINT))",
    "decimal": "CAST(i AS DECIMAL(20, 3)) / 8",
    "string": "concat('k\"\\\\é', lpad(CAST(i AS STRING), 5, '0'))",
    "double": "CASE WHEN i = 149 THEN double('NaN') WHEN i = 0 THEN double('-Infinity') ELSE i / 3 END",
    "binary": "unhex(lpad(hex(i), 6, '0'))",
    "null": "CASE WHEN i > 0 THEN i END",
    "struct": "named_struct('a', CASE WHEN i >= 5 THEN i div 10 END, 'b', i)",
}


@pytest.mark.parametrize("kind", list(KEYS))
def test_any_sortable_key(spark, kind):
    df = spark.range(150).withColumnRenamed("id", "i").selectExpr("i", f"{KEYS[kind]} AS k").repartition(4)
    one, many = (ordered.ordinals(df, ["k"], rows_per_cell=n) for n in (1 << 20, 6))
    want = {i: i + 1 for i in range(150)}
    assert {r.i: r.ord for r in one.collect()} == want
    assert {r.i: r.ord for r in many.collect()} == want
    cells = ordered.add_cells(df, ["k"], 6).select("i", ordered.CELL).orderBy("i").collect()
    assert len({r[1] for r in cells}) > 5 and [r[1] for r in cells] == sorted(r[1] for r in cells)
