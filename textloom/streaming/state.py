"""Small state tables for ``foreachBatch`` jobs, one directory per micro-batch.

A micro-batch reads the state its predecessor left and overwrites its own
directories, so a batch that is run again gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.workspace import committed

_PREFIX = "batch_id="


def load(spark: SparkSession, path: str, batch_id: int, initial: DataFrame) -> DataFrame:
    """State before ``batch_id``; ``initial`` before the first one."""
    return initial if batch_id == 0 else spark.read.schema(initial.schema).parquet(f"{path}/{_PREFIX}{batch_id - 1}")


def store(df: DataFrame, path: str, batch_id: int) -> None:
    """Write what one micro-batch produced, replacing an earlier attempt."""
    df.write.mode("overwrite").parquet(f"{path}/{_PREFIX}{batch_id}")


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches whose table is committed, in order."""
    return sorted(int(name[len(_PREFIX):]) for name in committed(spark, path) if name.startswith(_PREFIX))


def read(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What one micro-batch left."""
    return spark.read.parquet(f"{path}/{_PREFIX}{batch_id}")


def remove_before(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete the tables of earlier micro-batches."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for old in batches(spark, path):
        if old < batch_id:
            place = new(f"{path}/{_PREFIX}{old}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def latest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """State after the last finished micro-batch."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/{_PREFIX}{batches(spark, path)[-1]}")


def drain(writer, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything that has arrived, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
