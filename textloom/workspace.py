"""Intermediate tables in the shared checkpoint folder.

Expensive per-document results (token counts, token ids) are computed once,
written as Parquet and read back. The written table cuts the lineage, survives
the loss of executors and lets later passes read only the columns they need.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set(_SETTING, root)
    return f"{root.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the workspace."""
    return f"{workspace_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Scopes of this thread, the innermost last; each lists the tables written in it.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def freeze(df: DataFrame, name: str = "table", outside: bool = False) -> DataFrame:
    """Write ``df`` to the workspace and return the re-read table. Shuffle files of
    the write are of no more use then, so Spark is told to drop them at its end. ``outside`` lets the
    table outlive the innermost ``temporary_tables``."""
    path = new_path(df.sparkSession, name)
    owners = _scopes.get()[:-1] if outside else _scopes.get()
    if owners:
        owners[-1].append(path)
    return _store(df, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread freezes inside are removed at the end, but for those frozen ``outside``. What is returned from the
    block must not read the others."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            _delete(spark, path)


def _store(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one job, which alone drops them: other jobs of the session do not see them."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self.paths: list[str] = []

    def freeze(self, df: DataFrame, name: str = "table") -> DataFrame:
        """As ``freeze``; the table's path is the last of ``paths``."""
        self.paths.append(new_path(self._spark, name))
        return _store(df, self.paths[-1])

    def drop(self, paths: list[str] | None = None) -> None:
        """Remove some of the tables, or all, once nothing will read them."""
        for path in list(self.paths) if paths is None else paths:
            _delete(self._spark, path)
            self.paths.remove(path)


def drop_workspace(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once results are written."""
    _delete(spark, workspace_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose table Spark has committed, in order; none if there is no such path."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = new(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    folders = [s.getPath() for s in store.listStatus(place) if s.isDirectory()]
    return sorted(f.getName() for f in folders if store.exists(new(f, "_SUCCESS")))
