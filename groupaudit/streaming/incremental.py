"""Resumable extraction: process only files not seen yet, survive restarts, never duplicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def extract_new(
    spark: SparkSession,
    *,
    source: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000,
) -> int:
    """Run ``transform`` over the files that arrived since the last run; returns batches processed.

    The file source's log remembers finished files.  Each micro-batch overwrites its own
    ``batch=<id>`` folder, so a batch replayed after a crash replaces itself.
    """
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        done.append(batch_id)

    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    q = (
        transform(stream)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return len(done)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a finished row."""
    return todo.join(done.select(key), key, "left_anti")
