import os
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from textloom.operators import epochs, evaluation as ev, mix as mx, series
from textloom.operators.interleave import interleave
from textloom.plans.corpus import line_corpus, mixed_corpus
from textloom.plans.training_log import loss_series
from textloom.sources import readers, sinks
from textloom.sources.registry import Source, registry_frame, scan_source, split_slice


def registry(spark, *keys):
    return registry_frame(spark, [Source(k, "/nowhere") for k in keys])


@pytest.mark.parametrize("mix,want", [
    ("a=1,b=3", {"a": 0.25, "b": 0.75}),
    (" a = 1 , zz=9, b=x, b , a=3,b=1,", {"a": 0.75, "b": 0.25}),
    ("a=1,a=oops", {"a": 1.0}),
    ("a=2=3,b=1e1", {"b": 1.0}),
])
def test_parse_mix(spark, mix, want):
    got = {r.source_key: r.weight for r in mx.parse_mix(spark, mix, registry(spark, "a", "b")).collect()}
    assert got == want


@pytest.mark.parametrize("mix", ["", "zz=1", "a=0", "a=-1"])
def test_parse_mix_needs_weight(spark, mix):
    with pytest.raises(Exception, match="no known source"):
        mx.parse_mix(spark, mix, registry(spark, "a", "b")).collect()


def test_unknown_source_is_dropped_and_the_rest_scaled(spark):
    known = registry(spark, "wiki_en", "wiki_zh", "wiki_tw", "stackoverflow_en")
    mix = "wiki_en=0.55,rpj=0.2,wiki_zh=0.15,wiki_tw=0.05,stackoverflow_en=0.05"
    got = {r.source_key: round(r.weight, 9) for r in mx.parse_mix(spark, mix, known).collect()}
    assert got == {"wiki_en": 0.6875, "wiki_zh": 0.1875, "wiki_tw": 0.0625, "stackoverflow_en": 0.0625}
    assert [r.source_key for r in mx.unknown_keys(mx.mix_entries(spark, mix), known).collect()] == ["rpj"]


def in_turn(data):
    """Each source's first texts, then the second ones, and so on; blank texts only take up their turn."""
    places = {(turn, source): text.strip() for source, texts in enumerate(data.values()) for turn, text in enumerate(texts)}
    return [" ".join(places[p].split("\n")) for p in sorted(places) if places[p]]


@pytest.mark.parametrize("cell", [1 << 20, 4])
@pytest.mark.parametrize("limit", [dict(max_bytes=None), dict(max_bytes=30), dict(max_bytes=1), dict(max_lines=5)])
def test_line_corpus_takes_turns(spark, limit, cell):
    data = {"a": ["one", " ", "t\nwo", "three"], "b": [], "c": ["é", "", "", "zz", "last one"], "d": ["\n"]}
    rows = [(s, o, i, t) for o, (s, v) in enumerate(data.items()) for i, t in enumerate(v)]
    docs = spark.createDataFrame(rows, "source string, ordinal int, doc_id bigint, text string")
    lines = in_turn(data)
    sizes = list(accumulate(len(line.encode()) + 1 for line in lines))
    short = [n for n, size in enumerate(sizes, 1) if size < (limit.get("max_bytes") or float("inf"))]
    want = lines[:min(len(short) + 1, limit.get("max_lines", len(lines)))]
    got = line_corpus(docs, **{"max_bytes": None, **limit}, rows_per_cell=cell).orderBy("line_no").collect()
    assert [r.line for r in got] == want
    assert [r.line_no for r in got] == list(range(1, len(want) + 1))


def test_mixed_corpus_written_and_read(spark, tmp_path):
    rows = [(i, "ab"[i % 2], f"<p>text {'w ' * (i % 7)}number {i}</p> and more words here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    sources = registry_frame(spark, [Source("a", "x", cleaner="html", lang="en"), Source("b", "x", lang="de")])
    corpus = mixed_corpus(docs, sources, "a=1,b=1", 400, 50)
    sinks.write_shards(corpus.documents, str(tmp_path / "c"))
    back = sinks.read_shards(spark, str(tmp_path / "c"), ["source", "shard_id", "text", "lang"]).collect()
    totals = {r.source: r for r in corpus.summary().collect()}
    assert len(back) == totals[None].docs and totals["a"].tokens <= 202
    assert all(("<p>" in r.text) == (r.source == "b") for r in back)
    assert {r.lang for r in back} == {"en", "de"}
    with pytest.raises(ValueError):
        mixed_corpus(docs, sources, "a=1", 400, 50, shard_mode="no")


def test_published_sets(spark, tmp_path):
    """A shorter run, a killed writer and a run that loses rows: readers see the last whole set."""
    root = str(tmp_path / "c")
    make = lambda n, shards: spark.createDataFrame(
        [(i, "ab"[i % 2], i % shards, f"text {i}", None if i == 5 else 1) for i in range(n)], "doc_id bigint, source string, shard_id bigint, text string, n_tok bigint")
    sizes = lambda df: df.groupBy("source", "shard_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tok").alias("tokens"))
    show = lambda: {(r.source, r.shard_id, r.doc_id) for r in sinks.read_shards(spark, root, ["source", "shard_id", "doc_id"]).collect()}
    assert sinks.manifest(spark, root) is None
    long, short = make(60, 7), make(9, 3)
    first = sinks.publish_shards(long, root, sizes(long), rows_a_file=2).collect()
    assert show() == {tuple(r) for r in long.select("source", "shard_id", "doc_id").collect()}
    assert sum(r.rows for r in first) == 60 and all(r.files == -(-r.rows // 2) for r in first)
    second = sinks.publish_shards(short, root, sizes(short)).collect()
    want = {tuple(r) for r in short.select("source", "shard_id", "doc_id").collect()}
    assert show() == want and all(r.files == 1 for r in second) and len({r.set for r in second}) == 1
    # A writer that ends before its manifest: a set without one, and a manifest without its mark.
    long.write.partitionBy("source", "shard_id").parquet(f"{root}/_sets/deadbeef")
    spark.range(3).write.parquet(f"{root}/_manifests/v00000003-deadbeef")
    os.remove(f"{root}/_manifests/v00000003-deadbeef/_SUCCESS")
    assert show() == want and sinks.versions(spark, root) == [1, 2]
    with pytest.raises(RuntimeError):
        sinks.publish_shards(long.where("doc_id <> 3"), root, sizes(long))
    assert show() == want
    assert len(sinks.remove_old_sets(spark, root)) == 3 and show() == want
    sinks.publish_shards(short.limit(0), root, sizes(short.limit(0)))
    assert show() == set()


def test_small_published_shards_share_files(spark, tmp_path):
    """Writers and files follow the tokens, not the number of shards; a shard stays in one file."""
    root = str(tmp_path / "c")
    docs = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source", "id DIV 6 AS shard_id", "'x' AS text", "5 AS n_tok")
    sizes = docs.groupBy("source", "shard_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tok").alias("tokens"))
    made = sinks.publish_shards(docs, root, sizes).collect()
    assert len(made) == 300 and all((r.files, r.rows, r.tokens) == (1, 3, 15) for r in made)
    assert len(spark.read.parquet(f"{root}/_sets/{made[0]['set']}").inputFiles()) == 2
    back = sinks.read_shards(spark, root, None)
    assert set(back.columns) == set(docs.columns)
    assert sorted(back.select(*docs.columns).collect()) == sorted(docs.collect())
    large = sizes.where("shard_id < 4").withColumn("tokens", F.lit(sinks.FILE_TOKENS))
    made = sinks.publish_shards(docs.where("shard_id < 4"), root, large).collect()
    assert len(spark.read.parquet(f"{root}/_sets/{made[0]['set']}").inputFiles()) == 8


def test_documents_and_counts_agree_for_any_counter(spark):
    """A counter that gives words no token: those documents are in neither table."""
    docs = spark.createDataFrame([(i, "a", ("odd " if i % 2 else "even ") * 20) for i in range(30)], "doc_id bigint, source string, text string")
    sources = registry_frame(spark, [Source("a", "x", lang="en")])
    counter = lambda text: F.when(F.contains(text, F.lit("odd")), F.lit(0)).otherwise(F.lit(5)).cast("bigint")
    corpus = mixed_corpus(docs, sources, "a=1", 50, 20, counter=counter)
    assert corpus.documents.count() == corpus.admitted.count() == 10


def test_scan_of_missing_field_and_slice(spark, tmp_path):
    spark.range(30).select(F.col("id").alias("doc_id"), F.lit(3).alias("n")).write.parquet(str(tmp_path / "s"))
    src = Source("s", str(tmp_path / "s"), text_field="absent")
    assert {r.text for r in scan_source(spark, src).collect()} == {""}
    numbers = Source("s", str(tmp_path / "s"), text_field="n")
    assert {r.text for r in scan_source(spark, numbers).collect()} == {"3"}
    part = split_slice(spark.range(30), 10, ["id"])
    assert sorted(r.id for r in part.collect()) == [0, 1, 2]


LOG = """start
step 12 | loss 4.5
STEP 13 | Loss 3e-1 | step 99 | loss 1
step12 | loss 1
step 14 | loss .5
step 12 | loss -2.25
50%\rstep 15 | loss 7\rstep 16 | loss 8
"""


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(LOG.encode() + b"\xff\xfe step 17 | loss 1.5\n")
    lines = readers.read_log(spark, str(tmp_path / "a.log"), run="r")
    got = loss_series(lines).orderBy("point").collect()
    assert [(r.step, r.loss) for r in got] == [(12, -2.25), (13, 0.3), (15, 7.0), (16, 8.0), (17, 1.5)]
    thin = loss_series(lines, every=2, moving_average=2, decay=0.5).orderBy("point").collect()
    assert [(r.step, r.smoothed) for r in thin] == [(12, -2.25), (15, 2.375), (17, 4.25)]
    assert all(r.smoothed == r.loss for r in loss_series(lines, decay=1.5).collect())


def test_step_windows(spark):
    pts = spark.createDataFrame([("r", s, float(s), s) for s in range(1, 26)], "run string, step bigint, loss double, first_pos bigint")
    got = {r.step: r.mean_loss for r in series.window_means(pts, 10).collect()}
    assert got == {10: 5.5, 20: 15.5}
    assert {r.step for r in series.sample_steps(pts, 10).collect()} == {10, 20}


@pytest.mark.parametrize("workers", [1, 3])
def test_epoch_order_is_complete_and_reproducible(spark, workers):
    packed = spark.range(50).select(F.col("id").alias("row_idx"), (F.col("id") / 7).cast("bigint").alias("shard_id"),
                                    F.array(F.lit(1), F.lit(0)).alias("input_ids"),
                                    F.array(F.lit(1), F.lit(0)).cast("array<smallint>").alias("attention_mask"))
    one, again, other = (epochs.file_order(packed, 42, e, True, workers).orderBy("file_rank").collect() for e in (0, 0, 1))
    assert one == again and [r.shard_id for r in one] != [r.shard_id for r in other]
    assert all(r.worker == r.file_rank % workers for r in one)
    slots = epochs.batch_slots(packed, 4, workers, shuffle_rows=True)
    assert sorted(r.row_idx for r in slots.collect()) == list(range(50))
    stacked = epochs.batches(slots).collect()
    assert sum(len(r.input_ids) for r in stacked) == 50 and max(len(r.input_ids) for r in stacked) == 4
    assert epochs.tokens_per_step(4, 2048, 3) == 24576


def test_packed_read_needs_files(spark, tmp_path):
    spark.range(1).select("id", F.lit(0).alias("shard_id")).write.parquet(str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError, match="no packed files"):
        readers.read_packed(spark, str(tmp_path / "p"), pattern="none_*")


def test_perplexity_edges(spark):
    schema = "doc string, n_tok bigint, loss double"
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 2, 4.0), ("a", 1, 100.0), ("b", 1, 1.0)], schema)
    got = {r.doc: r.perplexity for r in ev.perplexity(df, ["doc"]).collect()}
    assert got["a"] == pytest.approx(2.718281828459045 ** 2.0) and got["b"] == float("inf")
    assert ev.perplexity(df.limit(0)).first().perplexity == float("inf")


def test_diversity_and_latency(spark):
    df = spark.createDataFrame([("a b a b",), ("one",), ("",), (" x  x ",)], "output string")
    got = [(r.distinct_1, r.distinct_2) for r in ev.diversity(df).collect()]
    assert got == [(0.5, 2 / 3), (1.0, 0.0), (0.0, 0.0), (0.5, 1.0)]
    runs = spark.createDataFrame([("g", 0, 9.0, 1), ("g", 1, 2.0, 10), ("g", 2, 0.0, 5)], "g string, i int, sec double, new_tokens int")
    row = ev.latency_summary(ev.measured_runs(runs, 1, ["i"], ["g"]), ["g"]).first()
    assert (row.runs, row.avg_latency_s, row.avg_tokens_per_s) == (2, 1.0, 2.5)


def test_bigram_loss_by_hand(spark):
    import math

    from textloom.functions import text as tx

    train = spark.createDataFrame([("a b a b a c",)], "text string")
    bigrams = ev.bigram_counts(train, tx.tokens(F.col("text")))
    texts = spark.createDataFrame([(0, "a b z a"), (1, " "), (2, "a")], "i int, text string")
    rows = {(r.i, r.block_no): r for r in ev.block_losses(ev.text_blocks(texts, ["i"], 3), bigrams, ["i"]).collect()}
    # Three types; a is followed 3 times, b twice, z never.
    assert set(rows) == {(0, 0)}
    want = -(math.log((2 + 1) / (3 + 3)) + math.log(1 / (2 + 3))) / 2
    assert rows[(0, 0)].loss == pytest.approx(want) and rows[(0, 0)].n_tok == 3


def test_interleave_keeps_turns_of_blanks(spark):
    df = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "source string, doc_id bigint")
    assert {(r.source, r.doc_id): r.turn for r in interleave(df, "doc_id").collect()} == {("a", 5): 1, ("a", 9): 2, ("b", 1): 1}


def test_log_lines_with_odd_separators(spark):
    lines = [("r", i, f"step {s} x\x85   loss 1.5") for i, s in enumerate(["7", "9" * 30, "8"])]
    got = series.parse_lines(spark.createDataFrame(lines, "run string, line_no bigint, line string")).collect()
    assert [(r.step, r.loss) for r in got] == [(7, 1.5), (8, 1.5)]


def test_files_of_several_roots_are_apart(spark):
    rows = spark.range(20).select((F.col("id") % 2).cast("int").alias("root"), (F.col("id") % 4 / 2).cast("bigint").alias("shard_id"),
                                  F.col("id").alias("row_idx"))
    files = epochs.file_order(rows, shuffle=False).orderBy("file_rank").collect()
    assert [(r.root, r.shard_id) for r in files] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    slots = epochs.batch_slots(rows, 3, workers=2).collect()
    assert len({(r.worker, r.batch_no, r.slot) for r in slots}) == 20


def test_sources_by_other_keys_and_by_arrival(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(40).selectExpr("concat('Q', lpad(id, 3, '0')) AS name", "CAST(id AS STRING) AS text").coalesce(1).write.parquet(path)
    for source in (Source("s", path, order_by="name"), Source("s", path, order_by=None), Source("s", path, order_by="absent")):
        got = scan_source(spark, source).orderBy("ord_key").collect()
        assert [r.text for r in got] == [str(i) for i in range(40)] and [r.ord_key for r in got] == list(range(1, 41))
    part = scan_source(spark, Source("s", path, order_by="name", percent=25)).collect()
    assert sorted(int(r.text) for r in part) == list(range(10))


@pytest.mark.parametrize("budgets", [{"a": 30, "b": 5}, {"a": 10**9, "b": 0}, {"a": 900, "b": 10**9}])
def test_counting_ends_with_the_budget(spark, budgets):
    from textloom.operators.budget import admit_capped
    from textloom.plans.corpus import counts_until

    docs = spark.range(3000).selectExpr("CASE WHEN id % 5 = 0 THEN 'b' ELSE 'a' END AS source", "CASE WHEN id > 0 THEN id * 3 END AS k",
                                        "repeat('w ', CAST(id % 4 AS INT)) AS text")

    def count(rows):
        return rows.select("source", "k", (F.size(F.split("text", " ")) - 1).cast("bigint").alias("n_tok"))

    got = counts_until(docs, count, budgets, ["k"])
    rows = got.groupBy("source").count().collect()
    assert {r.source: r["count"] for r in rows} == {r.source: r["count"] for r in got.distinct().groupBy("source").count().collect()}
    for r in rows:
        if budgets[r.source] < 100:
            assert r["count"] < 200
    def admitted(counts):
        with_budget = counts.withColumn("budget", F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])[F.col("source")])
        return sorted(admit_capped(with_budget, F.col("budget"), ["k"]).select("source", "k").na.fill(-1).collect())
    assert admitted(got) == admitted(count(docs))
    assert counts_until(docs.limit(0), count, budgets, ["k"]).count() == 0
    words = counts_until(docs.selectExpr("source", "CAST(k AS STRING) AS k", "text"), count, budgets, ["k"])
    assert words.count() == 3000
