"""The pipeline stage by stage against brute force, and the queries against SQL."""

import os
import sys

import brute
import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from textloom.llm import queries, toxicity  # noqa: E402
from textloom.workspace import freeze  # noqa: E402


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in check.TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.execute(queries.SQL[name]).to_arrow_table()
    assert check.rows_of(queries.RUNS[name](spark, sf).toArrow()) == check.rows_of(want)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {*queries.RUNS, "pipeline"} <= names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.RUNS}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in at.collect()}
        texts = sorted((d, r.text) for d, r in before.items())
        at = freeze(stage(spark, at, sf), name)
        after = {r.doc_id: r for r in at.collect()}
        assert at.schema == docs.schema
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            wanted = {r.doc_id for r in toxicity.score_documents(docs, model).where(f"score < {toxicity.LIMIT}").collect()}
            assert 0.7 * len(before) < len(wanted) < len(before)
        elif name == "minhash_near_dedup":
            wanted = {d for d, (_, c) in brute.near(texts).items() if c == d}
        elif name == "benchmark_decontamination":
            wanted = {r[0] for r in brute.contamination(texts, items) if not r[5]}
        else:
            wanted = set(before)
            for d, _, removed, kept in brute.repeats(texts):
                assert after[d].text == before[d].text if not removed else brute.sha(after[d].text) == kept
                assert after[d].n_chars == (len(after[d].text) if removed else before[d].n_chars)
        assert set(after) == wanted
        if name != "substring_dedup":
            assert all(after[d] == before[d] for d in after)
    assert sum(r.length for r in corpus_pipeline.packing(spark, at, sf).collect()) > len(after)


def test_stages_on_odd_tables(spark, tmp_path):
    rows = [(None, "a b c", "en", "s", 3, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (2, "", "en", "s", 0, 3), (3, "x " * 50, "en", "s", 100, 4)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int"
    spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = freeze(stage(spark, docs, str(tmp_path)), name)
            assert docs.count() == len(table), name


CLASHING = ("_stage_id _stage_key _kept _toxic_score score dropped_id cut_id cut_key cut_text found_id found_key label kept text_key _n "
            "n_words n_removed kept_text part bucket size rep component_id").split()


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").selectExpr("*", *[f"'{c}' AS {c}" for c in CLASHING], "1 AS `a.b`")
    for name, stage in corpus_pipeline.STAGES:
        after = freeze(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert after.schema.names == docs.schema.names and after.count() > 20
            assert after.where(" or ".join(f"{c} <> '{c}'" for c in CLASHING)).count() == 0
        docs = after


def test_results_of_interleaved_stages_stay_readable(spark, sf):
    """A stage that starts leaves the unread results of others alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    first = corpus_pipeline.packing(spark, docs, sf)
    cut = corpus_pipeline.substring_dedup(spark, docs, sf)
    corpus_pipeline.near_dedup(spark, docs, sf).count()
    corpus_pipeline.decontamination(spark, docs, sf).count()
    assert first.count() >= 60 and cut.count() == docs.count()
