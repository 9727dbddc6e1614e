"""Files that keep arriving, cleaned with the batch functions."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from textloom.functions.text import MIN_CHARS
from textloom.sources.registry import clean_documents
from textloom.streaming.state import drain


def arriving(spark: SparkSession, path: str, schema: str, max_files: int | None = None,
             pattern: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder, each file once."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def cleaned_stream(docs: DataFrame, cleaner: str = "plain", min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop empty texts, clean, keep long enough ones; stateless."""
    tagged = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("cleaner", F.lit(cleaner))
    return clean_documents(tagged, min_chars, {cleaner})


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Count while rows pass; the totals appear in the query's progress."""
    return stream.observe(name, *[expr.alias(k) for k, expr in metrics.items()])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to a Parquet table, exactly once."""
    return drain(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)


class ProgressLog(StreamingQueryListener):
    """Observed metrics of every micro-batch, as they are reported: unlike a query's
    recent progress, nothing is dropped. One row per batch and run is kept."""

    def __init__(self, name: str):
        self.name = name
        self._rows: dict[str, dict[int, dict]] = defaultdict(dict)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            batch = event.progress.batchId
            self._rows[str(event.progress.runId)][batch] = {"batch_id": batch, **row.asDict()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def rows(self, query: StreamingQuery, timeout: float = 60) -> list[dict]:
        """All batches of a run that has ended."""
        run = str(query.runId)
        if not self._ended[run].wait(timeout):
            raise TimeoutError(f"the end of run {run} was not reported")
        return [row for _, row in sorted(self._rows[run].items())]


@contextmanager
def recorded(spark: SparkSession, name: str) -> Iterator[ProgressLog]:
    """Record the metrics observed as ``name`` by the queries started inside."""
    log = ProgressLog(name)
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.streams.removeListener(log)
