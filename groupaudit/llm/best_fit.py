"""Best-fit packing of token sequences in bulk-synchronous rounds.

1. Tasks encode whole texts, cut only documents over the capacity, and number their pieces within
   (task, length).  A table of counts turns that into a rank within each length: the distributed
   range sort.  Pieces of one length are interchangeable, so a round needs their counts only.
2. A round sweeps lengths and gaps from large to small and hands each length the smallest gap that
   holds it (its successor).  Several pieces that want one gap are settled by rank: as many as fit
   there take it, lower ranks first; the next gap serves the next ranks.  Gaps are then updated and
   the round repeats.  Pieces over half the capacity open sequences at the start; later, when the
   largest pieces left fit no gap, they do.
3. The rounds give runs (length, ranks from - to, sequences from - to).  Tasks look the runs up by
   (length, rank) and so place every piece without a further shuffle.

The counts have at most ``capacity`` lengths and gaps however many documents there are, and the runs
follow from the counts; only they pass the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupaudit.llm.common import small_batches, stored
from groupaudit.llm.unit_encoder import ids_crc32, worker_encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def token_pieces(
    docs: DataFrame, *, path: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text, each document closed by ``end_id``."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, seen = worker_encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        for pdf in batches:
            rows = []
            for own, t in zip(pdf["id"], pdf["text"]):
                ids = np.append(np.frombuffer(encoder.encode_one(t), encoder.dtype).astype("<u4"), np.uint32(end_id))
                for piece, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo : lo + capacity]
                    rows.append((own, piece, lo, len(part), ids_crc32(part), task, seen[len(part)]))
                    seen[len(part)] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            out["doc_id"] = pd.array([None if x is None or x != x else int(x) for x in out["doc_id"]], dtype="Int64")
            yield out

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(cut, PIECES)


class _Gaps:
    """Open sequences by gap: runs (first sequence, number of sequences)."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def sizes(self) -> list[int]:
        return sorted(g for g, r in self.runs.items() if r and g)

    def take(self, gap: int, most: int) -> Iterator[tuple[int, int]]:
        while most and self.runs[gap]:
            first, n = self.runs[gap].pop()
            if n > most:
                self.runs[gap].append((first + most, n - most))
                n = most
            most -= n
            yield first, n


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, pieces, first sequence, pieces per sequence, offset) that place every piece.

    Piece rank + i of a run goes to sequence first + i // per, at offset + (i % per) * length.
    """
    left = {x: n for x, n in counts.items() if n}
    rank: dict[int, int] = defaultdict(int)
    gaps, opened, runs = _Gaps(), 0, []

    def place(x: int, first: int, n: int, per: int, gap: int) -> list[tuple[int, int, int]]:
        """Put ``per`` pieces of x into each of n sequences, fewer into the last; returns new gaps."""
        pieces = min(left[x], n * per)
        runs.append((x, rank[x], pieces, first, per, capacity - gap))
        rank[x] += pieces
        left[x] -= pieces
        whole, rest = divmod(pieces, per)
        new = [(gap - per * x, first, whole)] if whole else []
        return new + ([(gap - rest * x, first + whole, 1)] if rest else [])

    def open_sequences(x: int) -> None:
        nonlocal opened
        per = capacity // x
        n = -(-left[x] // per)
        for gap, first, m in place(x, opened, n, per, capacity):
            gaps.runs[gap].append((first, m))
        opened += n

    for x in sorted(left, reverse=True):
        if 2 * x > capacity:  # no two of these fit together: each opens a sequence
            open_sequences(x)
    while any(left.values()):
        updates: list[tuple[int, int, int]] = []
        sizes = gaps.sizes()
        for x in sorted((x for x, n in left.items() if n), reverse=True):
            for at in range(bisect_left(sizes, x), len(sizes)):
                if not left[x]:
                    break
                gap = sizes[at]
                if not gaps.runs[gap]:
                    continue
                per = gap // x
                for first, n in gaps.take(gap, -(-left[x] // per)):
                    updates += place(x, first, n, per, gap)
        for gap, first, n in updates:
            gaps.runs[gap].append((first, n))
        largest = max((x for x, n in left.items() if n), default=0)
        if largest and largest > max(gaps.sizes(), default=0):
            open_sequences(largest)
    return runs


def best_fit_pack(
    docs: DataFrame, *, path: str, end_id: int = 0, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    A null text counts as empty (one piece, the end id).  Null ids and repeated rows are packed like
    any other row.  Other columns are ignored.  An empty table gives no row.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path=path, end_id=end_id, capacity=capacity, doc_id=doc_id, text=text), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks"
    )
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_runs(counts, capacity)) or np.zeros((0, 6)), dtype=np.int64)
    shared = spark.sparkContext.broadcast(runs)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        key = (runs[:, 0] << 44) | runs[:, 1]
        for pdf in batches:
            rank = pdf.pop("rank").to_numpy()
            run = runs[np.searchsorted(key, (pdf["length"].to_numpy(dtype=np.int64) << 44) | rank, side="right") - 1]
            i = rank - run[:, 1]
            pdf["sequence_id"] = run[:, 3] + i // run[:, 4]
            pdf["offset"] = run[:, 5] + i % run[:, 4] * run[:, 0]
            yield pdf

    ranked = pieces.join(offsets.select("task", "length", "before"), ["task", "length"]).select(
        F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"),
        "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"),
    )
    out = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(assign, out).withColumn("doc_id", F.col("doc_id").cast("long"))
