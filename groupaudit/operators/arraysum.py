"""Sums of small dense arrays over a distributed table.

Sufficient statistics of a model (a gradient, a d x d Hessian, a scatter matrix) are sums over
rows.  Every partition adds its rows up in NumPy, executors combine the partial arrays in two
shuffles keyed by statistic, and only the finished arrays, whose number and size do not depend
on the number of rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

Partial = dict[int, np.ndarray]
SLOTS = 64  # partial arrays one reducer may hold per statistic


def matrix(column: pd.Series) -> np.ndarray:
    """Array column of one batch as a float64 matrix."""
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.empty((0, 0))


def add_to(acc: Partial, key: int, value: np.ndarray) -> None:
    if key in acc:
        acc[key] += value
    else:
        acc[key] = np.array(value, dtype=np.float64)


def _add_blobs(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, "<f8") for b in pdf["blob"])
    return pd.DataFrame({"key": pdf["key"].iloc[:1], "slot": pdf["slot"].iloc[:1], "blob": [total.tobytes()]})


def sum_arrays(df: DataFrame, accumulate: Callable[[pd.DataFrame, Partial], None]) -> Partial:
    """``accumulate(batch, acc)`` adds a batch's flat arrays into ``acc`` by integer key."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: Partial = {}
        for pdf in batches:
            if len(pdf):
                accumulate(pdf, acc)
        slot = TaskContext.get().partitionId() % SLOTS
        yield pd.DataFrame(
            {"key": list(acc), "slot": [slot] * len(acc), "blob": [a.ravel().astype("<f8").tobytes() for a in acc.values()]}
        )

    schema = "key int, slot int, blob binary"
    parts = df.mapInPandas(partial, schema)
    if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > SLOTS:
        parts = parts.groupBy("key", "slot").applyInPandas(_add_blobs, schema)
    whole = parts.groupBy("key").applyInPandas(_add_blobs, schema)
    return {row["key"]: np.frombuffer(row["blob"], "<f8").copy() for row in whole.select("key", "blob").collect()}
