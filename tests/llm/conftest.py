import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` rows, with other columns whose names operators use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        return df.selectExpr("*", "'x' AS id", "1 AS score", "2 AS shard", "3 AS label", "'k' AS text_key", "4 AS kept") if extra else df

    return make
