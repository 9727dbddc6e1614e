import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import budget as batch_budget, pack as batch_pack, shards
from textloom.operators.ordered import running_totals
from textloom.streaming import budget, logs, pack, state
from textloom.workspace import freeze


def rows(n=90):
    return [(i, "abc"[i % 3 if i % 2 else 0], " ".join(["w"] * (1 + (i * 7) % 23))) for i in range(n)]


@pytest.mark.parametrize("pieces", [1, 4])
def test_streamed_budget_equals_batch(spark, pieces, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id bigint, source string, text string")
    budgets = spark.createDataFrame([("a", 200), ("b", 10**6), ("c", 35)], "source_key string, budget bigint")
    counts = docs.join(budgets.withColumnRenamed("source_key", "source"), "source").withColumn(
        "n_tok", F.size(F.split("text", " ")).cast("bigint"))
    admitted = freeze(batch_budget.admit_capped(counts, F.col("budget"), ["doc_id"]))
    want = shards.assign_shards(admitted, shards.greedy_bounds(admitted, 40, ["doc_id"]), ["doc_id"])
    current, got = budget.initial_state(budgets), []
    for p in range(pieces):
        part = docs.where((F.col("doc_id") >= 90 * p // pieces) & (F.col("doc_id") < 90 * (p + 1) // pieces))
        taken, after = budget.take_batch(part, current, 40, ["doc_id"])
        got += [(r.doc_id, r.shard_id) for r in taken.collect()]
        current = freeze(after)
    assert sorted(got) == sorted((r.doc_id, r.shard_id) for r in want.collect())
    assert {r.source for r in current.where("stopped").collect()} == {"a", "c"}


def test_streamed_packing_equals_batch(spark):
    frame = spark.createDataFrame([(i, [i + 1] * ((i * 5) % 11)) for i in range(40)], "doc_id bigint, ids array<int>")
    frame = frame.withColumn("n", F.size("ids").cast("bigint"))
    want = {r.row_idx: r.ids for r in batch_pack.pack_rows(frame, ["doc_id"], 16).collect()}
    before, got = spark.createDataFrame([(0, [])], pack.STATE), {}
    for lo, hi in ((0, 1), (1, 3), (3, 25), (25, 40)):
        full, before = pack.pack_batch(frame.where(f"doc_id >= {lo} and doc_id < {hi}"), before, 16, ["doc_id"])
        got.update({r.row_idx: r.ids for r in full.collect()})
    last = before.first()
    got[last.next_row] = last.rest
    assert got == want


def test_batch_directories_are_replaced_on_retry(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.range(3).withColumn("v", F.lit(0))
    state.store(first, path, 0)
    state.store(spark.range(5).withColumn("v", F.lit(1)), path, 1)
    state.store(spark.range(2).withColumn("v", F.lit(2)), path, 1)
    assert state.latest(spark, path).count() == 2
    assert state.load(spark, path, 1, first).count() == 3
    assert state.load(spark, path, 0, first.limit(0)).count() == 0


def test_points_after_a_hundred_batches(spark, tmp_path):
    """Reading costs the points and few batches; a batch that runs again, and one that was killed, change nothing."""
    out, want = str(tmp_path / "points"), {}
    make = lambda n: [("r" if (n + i) % 3 else "q", (7 * n + i) % 13, float(n), n * 10 + i) for i in range(3)]
    for n in range(100):
        changed = spark.createDataFrame(make(n), "run string, step bigint, loss double, first_pos bigint").coalesce(1)
        logs.keep_changes(changed, n, out)
        if n in (9, 19, 57):
            logs.keep_changes(changed, n, out)
        want.update({(run, step): (loss, at) for run, step, loss, at in make(n)})
        if n in (0, 9, 10, 57, 99):
            got = logs.current_points(spark, out)
            assert {(r.run, r.step): (r.loss, r.first_pos) for r in got.collect()} == want
            assert len(got.inputFiles()) <= 24
    assert len(state.batches(spark, f"{out}/changes")) <= 20 and len(state.batches(spark, f"{out}/whole")) == 2
    changed.write.parquet(f"{out}/whole/batch_id=100")
    os.remove(f"{out}/whole/batch_id=100/_SUCCESS")
    assert {(r.run, r.step): (r.loss, r.first_pos) for r in logs.current_points(spark, out).collect()} == want


def test_running_totals_accept_start(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(6)], "source string, k bigint, n_tok bigint")
    run = running_totals(df, ["k"], {"running": F.col("n_tok") + 0}, ["source"]).withColumn(
        "running", F.col("running") + 25).withColumn("shard_start", F.lit(20))
    for small in (1 << 20, 0):
        bounds = shards.greedy_bounds(freeze(run), 25, ["k"], small_table=small)
        assert sorted(r.closed_at for r in bounds.collect()) == [45, 75]


def test_all_batches_are_counted(spark, tmp_path):
    """More micro-batches than a query's recent progress keeps."""
    from pyspark.sql import functions as F

    from textloom.streaming import ingest

    spark.range(24).selectExpr("id AS doc_id", "'s' AS source", "'x' AS text").repartition(12).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        with ingest.recorded(spark, "seen") as log:
            rows = ingest.arriving(spark, str(tmp_path / "in"), "doc_id bigint, source string, text string", max_files=1)
            query = ingest.append_to(ingest.observed(rows, "seen", n=F.count(F.lit(1))), str(tmp_path / "out"), str(tmp_path / "check"))
            got = log.rows(query)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert len(got) > 3 and sum(r["n"] for r in got) == 24
