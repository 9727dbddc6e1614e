"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textloom.sources.readers import spread

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name. ``covers`` lists survey ids."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run.__name__, tuple(covers.split()), run, sql)
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the documents table, on all cores: the file is one split."""
    return spread(table(spark, sf, "documents").select(*columns))
