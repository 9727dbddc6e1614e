import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from textloom.queries import QUERIES  # noqa: E402

# The rest is run by tools/check.py over larger tables.
CHECKED = ["corpus_summary", "quality_corpus", "byte_budget_lines", "cleaned_multi_source", "sample_preview",
           "packed_rows_capped", "micro_batches", "loss_curve", "exponential_average", "perplexity_per_item",
           "corpus_distinct_bigrams", "streamed_budget", "streamed_packing"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) >= set(QUERIES)


def test_entry_without_the_tokenizer_files():
    """A missing library takes the subpackage's queries away and no others."""
    blocked = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    found = subprocess.run([sys.executable, "-c", blocked], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, check=True)
    assert set(found.stdout.split()) == set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in check.TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    got = entry.queries()[name](spark, sf).toArrow()
    assert check.rows_of(got) == check.rows_of(want)
