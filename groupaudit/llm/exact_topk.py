"""Exact top-k search by inner product with a three-phase uniform threshold.

The components are dealt to ``parts`` lists; list b of a query holds every vector's partial score
over the components of b.  Partial scores are shifted by the list's lowest one, so that they are not
negative and the sum of a vector's entries is its score plus one constant.

1. Every cell (block of queries x shard of vectors) gathers each list's k best entries and lowest
   entry; the vectors so found are scored in full.  The k-th best of these over all cells is a lower
   bound of the k-th best score.
2. The cutoff goes to every cell with the query: a vector that reaches the bound has an entry of at
   least bound / parts in some list.  Cells collect all entries that high and drop a vector when its
   entries, with bound / parts for each list not seen, cannot reach the bound.
3. The remaining vectors' missing entries are resolved, in exact integers, and ranked.

Work is queries x vectors in blocks, as the search is exact; a task holds one shard and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupaudit.session import scratch_path

LONG = (1 << 63) - 1


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of integers, short vectors padded with zeros."""
    lengths = column.map(len).to_numpy()
    if (lengths == width).all():
        return np.stack(column.to_numpy()).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(ids) - k)[len(ids) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


class _Cell:
    """One block of queries against one shard of vectors."""

    def __init__(self, q: pd.DataFrame, v: pd.DataFrame, parts: int):
        width = max(int(q["v"].map(len).max()), int(v["v"].map(len).max()), 1)
        self.qid, self.vid = q["id"].to_numpy(), v["id"].to_numpy()
        a, b = _matrix(q["v"], width), _matrix(v["v"], width)
        top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
        self.plain = top(a) * top(b) * width < 1 << 53  # sums of doubles are then exact integers
        kind = np.float64 if self.plain else object
        self.a, self.b = a.astype(kind), b.astype(kind)
        self.lists = np.array_split(np.arange(width), min(parts, width))

    def partial(self, rows: slice) -> list[np.ndarray]:
        return [self.a[rows][:, c] @ self.b[:, c].T for c in self.lists]

    def full(self, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [(self.a[qi[i : i + 65536]] * self.b[vi[i : i + 65536]]).sum(axis=1) for i in range(0, len(qi), 65536)] or [np.zeros(0)]
        )


def exact_top_k(
    vectors: DataFrame,
    *,
    is_query: Column,
    k: int = 5,
    parts: int = 4,
    scale: int = 256,
    shard_rows: int = 8192,
    block_rows: int = 512,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best other vectors, ties to smaller ids.

    ``is_query`` is a condition on the id column.  Component x counts as floor(scale * x), as a long.
    Vectors that are null or hold a null or non-finite component, and rows without an id, take no
    part.  Rows that repeat an id count once, with the vector that sorts last.  Of vectors of unequal
    length the missing components count as zero; an empty vector scores 0.  A score beyond a long is
    held at its end, and ranks as held.  Fewer than k others: all of them.  Other columns are ignored.
    """
    x = F.col("v")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    clean = (
        raw.where(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, finite), F.lit(False)))
        .groupBy("id")
        .agg(F.max("v").alias("v"))
        .select("id", F.transform("v", lambda e: F.floor(e * scale)).alias("v"))
    )
    query = F.coalesce(F.expr("true") & is_query, F.lit(False))
    flagged = clean.withColumnRenamed("id", id_col).withColumn("_q", query).withColumnRenamed(id_col, "id")
    path = scratch_path(vectors.sparkSession, "vectors")
    flagged.write.parquet(path)
    kept = lambda: vectors.sparkSession.read.parquet(path)  # noqa: E731  each read has columns of its own
    n, n_q = kept().agg(F.count("*"), F.coalesce(F.sum(F.col("_q").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_q // block_rows))
    slot = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    shelf = lambda: kept().select("id", "v", slot(shards, 1).alias("s"), every(blocks).alias("b"))
    asked = lambda: kept().where("_q").select("id", "v", slot(blocks, 2).alias("b"))

    def gather(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            cell = _Cell(q, v, parts)
            for lo in range(0, len(q), 64):
                rows = slice(lo, lo + 64)
                qid = cell.qid[rows]
                if not cell.plain:  # no cutoff from here: everything will be resolved
                    out += [(i, None, []) for i in qid]
                    continue
                lists = cell.partial(rows)
                heads = [np.argpartition(p, max(0, p.shape[1] - k - 1), axis=1)[:, -(k + 1) :] for p in lists]
                for r, i in enumerate(qid):
                    seen = np.unique(np.concatenate([h[r] for h in heads]))
                    seen = seen[cell.vid[seen] != i]
                    full = np.sort(cell.full(np.full(len(seen), lo + r), seen))[::-1][:k]
                    out.append((i, [int(p[r].min()) for p in lists], [int(s) for s in full]))
        return pd.DataFrame(out, columns=["id", "low", "best"])

    keys = ("s", "b")
    heads = asked().withColumn("s", every(shards)).groupBy(*keys).cogroup(shelf().groupBy(*keys)).applyInPandas(
        gather, "id long, low array<long>, best array<long>"
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        lows = [x for x in pdf["low"]]
        width = max((len(x) for x in lows if x is not None), default=0)
        known = all(x is not None and len(x) == width for x in lows)
        best = sorted((s for b in pdf["best"] for s in b), reverse=True)[:k]
        ready = known and len(best) == k
        low = np.stack(lows).min(axis=0).tolist() if ready else None
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "low": [low], "bound": [float(best[-1]) if ready else None]})

    cutoffs = heads.groupBy("id").applyInPandas(merge, "id long, low array<long>, bound double")

    def collect(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(v):
            cell = _Cell(q, v, parts)
            m = len(cell.lists)
            for lo in range(0, len(q), 64):
                part = q.iloc[lo : lo + 64]
                usable = np.array(
                    [cell.plain and w is not None and len(w) == m and not np.isnan(b) for w, b in zip(part["low"], part["bound"])]
                )
                take = ~np.equal.outer(part["id"].to_numpy(), cell.vid)
                if usable.any():
                    low = np.zeros((len(part), m))
                    low[usable] = np.stack([w for w, u in zip(part["low"], usable) if u])
                    need = np.where(usable, part["bound"].to_numpy(dtype=float) - low.sum(axis=1), 0.0)
                    entries = [p - low[:, [j]] for j, p in enumerate(cell.partial(slice(lo, lo + 64)))]
                    high = [e * m >= need[:, None] for e in entries]
                    some = np.logical_or.reduce(high)
                    reach = sum(np.where(h, e, need[:, None] / m) for h, e in zip(high, entries))
                    take &= ~usable[:, None] | (some & (reach >= need[:, None] - 0.5))
                qi, vi = np.nonzero(take)
                score = cell.full(qi + lo, vi)
                if not cell.plain:
                    score = np.array([max(-LONG - 1, min(LONG, int(s))) for s in score], dtype=np.int64)
                edges = np.searchsorted(qi, np.arange(len(part) + 1))
                for r, i in enumerate(part["id"]):
                    own = slice(edges[r], edges[r + 1])
                    keep = _best(score[own], cell.vid[vi[own]], k)
                    out.append(pd.DataFrame({"q": i, "id": cell.vid[vi[own]][keep], "score": score[own][keep].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "score": []}).astype("int64")

    cut_queries = asked().join(cutoffs, "id", "left").withColumn("s", every(shards))
    found = cut_queries.groupBy(*keys).cogroup(shelf().groupBy(*keys)).applyInPandas(collect, "q long, id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
    )
