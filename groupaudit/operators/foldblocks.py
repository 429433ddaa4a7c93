"""Repeated-fold logistic probes of narrow views over blocks of rows, and their AUC without a row per score.

A block holds some thousand units as matrices in three byte strings.  One scan evaluates all models of a
view on a block by matrix products: a unit's columns are scaled once for all models, and what a model
centres, scales and imputes is a linear map of them (``_maps``), applied to the finished sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.operators.arraysum import Partial, add_to, sum_arrays
from groupaudit.operators.metrics import ratio
from groupaudit.operators.models import Fit, Spec, Statistics, View, newton_fits, sigmoid
from groupaudit.session import materialise

NARROW = 64  # columns a view may have: a scan adds up width^2 numbers a model
STEP = 2048  # rows worked on at a time, so that their matrices stay in the cache
PART_BYTES = 1 << 25  # rows one task holds in memory
HELD = 1 << 23  # scores a task holds before it sends them out
BUCKET_SCORES = 250_000  # scores a bucket is planned for


class Blocks:
    """Units as matrices: the columns that some views see, the label, and the fold in every repeat (-1: none)."""

    def __init__(self, data: DataFrame, views: Sequence[View], *, n_folds: int, repeats: int, n: int):
        self.views, self.n_folds, self.repeats, self.n = list(views), n_folds, repeats, n
        self.columns = sorted({c for v in views for c in v.columns})
        self.at = [[self.columns.index(c) for c in v.columns] for v in views]
        k = len(self.columns)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype("<f8")
                y = b.column(k).to_numpy(zero_copy_only=False).astype("<f8")
                codes = b.column(k + 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, repeats).astype("<i2")
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "y": [y.tobytes()], "codes": [codes.tobytes()]})

        xs = [F.get("x", F.lit(c)).cast("double").alias(f"x{c}") for c in self.columns]
        blocks = data.select(*xs, F.col("y").cast("double").alias("y"), "codes").mapInArrow(pack, "x binary, y binary, codes binary")
        parts = max(data.sparkSession.sparkContext.defaultParallelism, -(-n * (8 * k + 8 + 2 * repeats) // PART_BYTES))
        self.df = materialise(blocks.repartition(parts))

    def pieces(self) -> Callable[[pd.DataFrame, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(batch, rows) -> (x, y, codes) of at most so many rows."""
        k, repeats = len(self.columns), self.repeats

        def cut(pdf: pd.DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for xb, yb, cb in zip(pdf["x"], pdf["y"], pdf["codes"]):
                y = np.frombuffer(yb, "<f8")
                x, codes = np.frombuffer(xb, "<f8").reshape(len(y), k), np.frombuffer(cb, "<i2").reshape(len(y), repeats)
                for lo in range(0, len(y), rows):
                    yield x[lo : lo + rows], y[lo : lo + rows], codes[lo : lo + rows]

        return cut


def _own(codes: np.ndarray, n_folds: int) -> np.ndarray:
    """Rows x (repeats x folds): 1 where the row lies in the fold."""
    return (codes[:, :, None] == np.arange(n_folds)).reshape(len(codes), -1).astype(float)


def _seen(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, gaps: Sequence[int]) -> np.ndarray:
    """1, the scaled columns with 0 for missing values, and a flag for each column that misses some."""
    z = (x - centre) / scale
    missing = np.isnan(z)
    return np.column_stack([np.ones(len(z)), np.where(missing, 0.0, z), missing[:, list(gaps)]])


def _moments(blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Sums (units, values, z, z^2 by column) of every (repeat, fold), about the returned values of one row."""
    cut, n_folds, k = blocks.pieces(), blocks.n_folds, len(blocks.columns)
    row = blocks.df.select("x").first()
    centre = np.nan_to_num(np.frombuffer(row["x"], "<f8")[:k])

    def add(pdf: pd.DataFrame, acc: Partial) -> None:
        for x, _, codes in cut(pdf, STEP):
            ok = ~np.isnan(x)
            z = np.where(ok, x - centre, 0.0)
            add_to(acc, 0, _own(codes, n_folds).T @ np.column_stack([np.ones(len(x)), ok, z, z * z]))

    return centre, sum_arrays(blocks.df, add)[0].reshape(blocks.repeats, n_folds, -1)


def _spread(sums: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(mean, scale, units, values) by column, as ``models.train_statistics`` defines them."""
    k = len(centre)
    n, cnt, s1, s2 = sums[0], sums[1 : 1 + k], sums[1 + k : 1 + 2 * k], sums[1 + 2 * k :]
    gap = s1 / np.maximum(cnt, 1)
    mean = np.where(cnt > 0, centre + gap, 0.0)
    scale = np.sqrt(np.maximum(s2 - cnt * gap * gap, 0.0) / max(n, 1))
    scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
    return mean, scale, n, cnt


def _maps(mean: np.ndarray, scale: np.ndarray, centre: np.ndarray, unit: np.ndarray, gaps: Sequence[int]) -> np.ndarray:
    """Matrix that turns a model's coefficients into those of ``_seen``: missing values are the model's mean."""
    d = len(mean)
    shift = (centre - mean) / scale
    out = np.zeros((1 + d + len(gaps), 1 + d))
    out[0] = np.concatenate([[1.0], shift])
    out[1 + np.arange(d), 1 + np.arange(d)] = unit / scale
    for row, j in enumerate(gaps):
        out[1 + d + row, 1 + j] = -shift[j]
    return out


class Probes:
    """All (view, repeat, fold) models of ``fit_linear``'s logistic loss, fitted on blocks."""

    def __init__(self, blocks: Blocks):
        self.blocks = blocks
        n_folds, repeats = blocks.n_folds, blocks.repeats
        about, cells = _moments(blocks)
        pooled = _spread(cells[0].sum(axis=0), about)
        per = [[_spread(np.delete(cells[r], f, axis=0).sum(axis=0), about) for f in range(n_folds)] for r in range(repeats)]
        every = cells.sum(axis=1)
        self.frames, self.maps, specs, first = [], [], [], {}
        for v, at in zip(blocks.views, blocks.at):
            gaps = [j for j, c in enumerate(at) if (every[:, 1 + c] < every[:, 0]).any()]
            self.frames.append((at, pooled[0][at], pooled[1][at], gaps))
            for r in range(repeats):
                for f in range(n_folds):
                    mean, scale, n, cnt = per[r][f]
                    first[len(specs)] = (mean[at], scale[at], int(n), int(n * len(at) - cnt[at].sum()))
                    self.maps.append(_maps(mean[at], scale[at], pooled[0][at], pooled[1][at], gaps))
                    specs.append(Spec(v, r, f))
        self.fits: list[Fit] = newton_fits(specs, first, self._scan)

    def _scan(self, trial: dict[int, np.ndarray], _: Statistics) -> Partial:
        """Loss, label sum, units, gradient and second derivatives of the given models at their coefficients."""
        cut, frames, n_folds, per = self.blocks.pieces(), self.frames, self.blocks.n_folds, self.blocks.repeats * self.blocks.n_folds
        jobs = []
        for k, frame in enumerate(frames):
            mine = [i for i in sorted(trial) if i // per == k]
            if mine:
                theta = np.column_stack([self.maps[i] @ trial[i] for i in mine])
                jobs.append((k, frame, np.array([i % per for i in mine]), theta, mine))
        work = [job[:4] for job in jobs]

        def add(pdf: pd.DataFrame, acc: Partial) -> None:
            for x, y, codes in cut(pdf, STEP):
                train = np.repeat(codes >= 0, n_folds, axis=1) - _own(codes, n_folds)
                for k, (at, centre, unit, gaps), cells, theta in work:
                    u, w = _seen(x[:, at], centre, unit, gaps), train[:, cells]
                    eta, yy = u @ theta, y[:, None]
                    e = np.exp(-np.abs(eta))
                    p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
                    value = (w * (np.log(1.0 + e) + np.maximum(eta, 0.0) - yy * eta)).sum(axis=0)
                    curve = w * p * (1.0 - p)
                    rows = [value, y @ w, w.sum(axis=0), *(u.T @ (w * (p - yy)))]
                    for j in range(u.shape[1]):
                        rows.extend((u[:, j:] * u[:, j : j + 1]).T @ curve)
                    add_to(acc, k, np.array(rows))

        sums, out = sum_arrays(self.blocks.df, add), {}
        for k, _, _, theta, mine in jobs:
            p, a = len(theta), sums[k].reshape(-1, len(mine))
            for m, i in enumerate(mine):
                half = np.zeros((p, p))
                half[np.triu_indices(p)] = a[3 + p :, m]
                whole, change = half + np.triu(half, 1).T, self.maps[i]
                out[i] = np.concatenate([a[:3, m], change.T @ a[3 : 3 + p, m], (change.T @ whole @ change).ravel()])
        return out

    def scores(self, repeats: int | None = None) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, int, np.ndarray]]]:
        """(x, codes) -> (view, repeat, p) of the first repeats: the own fold's score, NaN without a fold.

        Column by column, so that equal rows have equal scores wherever they lie.
        """
        frames, n_folds, repeats = self.frames, self.blocks.n_folds, repeats or self.blocks.repeats
        theta = [[self._theta(k, r) for r in range(repeats)] for k in range(len(frames))]

        def run(x: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
            for k, (at, centre, unit, gaps) in enumerate(frames):
                u = _seen(x[:, at], centre, unit, gaps)
                for r in range(repeats):
                    own = (codes[:, r] >= 0) & (codes[:, r] < n_folds)
                    coef = theta[k][r][:, np.where(own, codes[:, r], 0)]
                    eta = coef[0].copy()
                    for j in range(1, u.shape[1]):
                        eta += u[:, j] * coef[j]
                    yield k, r, np.where(own, sigmoid(eta), np.nan)

        return run

    def _theta(self, k: int, r: int) -> np.ndarray:
        n_folds, lo = self.blocks.n_folds, (k * self.blocks.repeats + r) * self.blocks.n_folds
        return np.column_stack([self.maps[i] @ self.fits[i].beta for i in range(lo, lo + n_folds)])

    def _edges(self) -> list[np.ndarray]:
        """Inner bucket edges of every view's scores, from quantiles of each task's scores; they steer balance only."""
        cut, scores = self.blocks.pieces(), self.scores(1)
        buckets = max(8, min(4096, -(-self.blocks.n // BUCKET_SCORES)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[np.ndarray]] = {}
            for pdf in batches:
                for x, _, codes in cut(pdf, STEP):
                    for k, _, p in scores(x, codes):
                        held.setdefault(k, []).append(p[~np.isnan(p)])
            for k, parts in held.items():
                p = np.sort(np.concatenate(parts))
                if len(p):
                    at = np.linspace(0, len(p) - 1, buckets + 1).astype(int)
                    yield pd.DataFrame({"view": [k], "n": [len(p)], "q": [p[at].astype("<f8").tobytes()]})

        rows = self.blocks.df.mapInPandas(run, "view int, n long, q binary").collect()
        out = []
        for k in range(len(self.frames)):
            mine = [(np.frombuffer(r["q"], "<f8"), r["n"]) for r in rows if r["view"] == k]
            if not mine:
                out.append(np.empty(0))
                continue
            q = np.concatenate([a for a, _ in mine])
            w = np.concatenate([np.full(len(a), n / len(a)) for a, n in mine])
            order = np.argsort(q)
            upto = np.cumsum(w[order])
            out.append(np.unique(q[order][np.searchsorted(upto, upto[-1] * np.arange(1, buckets) / buckets)]))
        return out

    def auc(self) -> DataFrame:
        """(head, repeat, n_pos, n_neg, auc) over all own-fold scores: ``metrics.roc_auc`` of them.

        Tasks send sorted scores of a bucket as one byte string, with counts where scores are equal.  A bucket
        gives the pairs inside it, totals of the buckets below it the others.
        """
        cut, scores, edges = self.blocks.pieces(), self.scores(), self._edges()
        names, limit = [v.name for v in self.blocks.views], max(1, HELD // (len(self.frames) * self.blocks.repeats))

        def send(held: dict[tuple[int, int, bool], list[np.ndarray]]) -> Iterator[pd.DataFrame]:
            for (k, r, positive), parts in held.items():
                s = np.sort(np.concatenate(parts))
                new = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
                values, counts = s[new], np.diff(np.append(new, len(s)))
                at = [0, *np.searchsorted(values, edges[k], side="left").tolist(), len(values)]
                rows = []
                for b, (lo, hi) in enumerate(zip(at, at[1:])):
                    if hi > lo:
                        c = counts[lo:hi]
                        tied = c.astype("<i8").tobytes() if c.max() > 1 else b""
                        rows.append((names[k], r, b, positive, values[lo:hi].astype("<f8").tobytes(), tied))
                if rows:
                    yield pd.DataFrame(rows, columns=["head", "repeat", "b", "positive", "s", "c"])

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, n = {}, 0
            for pdf in batches:
                for x, y, codes in cut(pdf, 8 * STEP):
                    for k, r, p in scores(x, codes):
                        for positive in (True, False):
                            held.setdefault((k, r, positive), []).append(p[(y == positive) & ~np.isnan(p)])
                    n += len(y)
                    if n >= limit:
                        yield from send(held)
                        held, n = {}, 0
            yield from send(held)

        def side(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            """Sorted scores, and how many units have the first k of them."""
            s = np.concatenate([np.empty(0), *[np.frombuffer(v, "<f8") for v in pdf["s"]]])
            if not any(pdf["c"]):
                return np.sort(s), np.arange(len(s) + 1)
            c = np.concatenate([np.frombuffer(t, "<i8") if t else np.ones(len(v) // 8, np.int64) for v, t in zip(pdf["s"], pdf["c"])])
            order = np.argsort(s, kind="stable")
            return s[order], np.concatenate([[0], np.cumsum(c[order])])

        def inside(pdf: pd.DataFrame) -> pd.DataFrame:
            (pos, upto), (neg, below) = side(pdf[pdf["positive"]]), side(pdf[~pdf["positive"]])
            twice = below[np.searchsorted(neg, pos, side="left")] + below[np.searchsorted(neg, pos, side="right")]
            first = pdf.iloc[0]
            return pd.DataFrame(
                {"head": [first["head"]], "repeat": [first["repeat"]], "b": [first["b"]], "p": [float(upto[-1])], "n": [float(below[-1])], "u": [int(np.diff(upto) @ twice) / 2]}
            )

        sent = self.blocks.df.mapInPandas(packed, "head string, repeat int, b int, positive boolean, s binary, c binary")
        buckets = sent.groupBy("head", "repeat", "b").applyInPandas(inside, "head string, repeat int, b int, p double, n double, u double")
        across = Window.partitionBy("head", "repeat").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(across), F.lit(0.0))
        pairs = buckets.select("head", "repeat", "p", "n", (F.col("u") + F.col("p") * before).alias("u"))
        return pairs.groupBy("head", "repeat").agg(
            F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), ratio(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc")
        )
