"""Probes over wide features: L-BFGS for many models at once.

A scan adds up value and gradient of every model, so a model moves d numbers each way and no d x d
matrix is ever formed.  Standardisation, projections and column subsets are folded into the weights:
all models of a block are one matrix product over the raw features, and their gradients another.
Blocks bound what a worker and the driver hold, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from groupaudit.operators.arraysum import Partial, add_to, matrix, sum_arrays
from groupaudit.operators.models import LOSSES, Fit, Spec, View, _batch

BLOCK_BYTES = 256 << 20  # iterates and history of one block of models
CELLS = 1 << 18  # rows x models worked on at once: a worker holds a dozen such arrays of numbers
KEYED = 64  # models of one partial sum: sums of a block spread over the reducers


def _add_moments(x: np.ndarray, codes: np.ndarray, pairs, views: dict[int, View], centre, folds: int, acc: Partial) -> None:
    """Adds up every (view, design) of ``pairs``, which are in order of their views: one view's values are held at a time."""
    held = None
    for i, (k, design) in enumerate(pairs):
        if k != held:
            held, v = k, views[k].apply(x) - centre[k]
            ok = ~np.isnan(v)
            z = np.where(ok, v, 0.0)
        code = codes[:, design]
        # folds no model tests on count as one further fold
        cell = (np.where(code < folds, code, folds)[:, None] == np.arange(folds + 1)).astype(float)
        add_to(acc, i, np.hstack([cell.sum(0)[:, None], cell.T @ ok, cell.T @ z, cell.T @ (z * z)]))


def wide_statistics(
    df: DataFrame, models: Sequence[Spec], *, whole_table: bool = False
) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """(mean, scale, n_train, n_imputed) per model as ``train_statistics`` defines them.

    Sums are kept per (view, design, fold), not per model: a model's training rows are all folds' sums
    less its own.
    """
    views, folds = _views(models), max(s.fold for s in models) + 1
    pairs = sorted({(views[id(s.view)], s.design) for s in models})
    one = df.select("x").first()
    if one is None:
        raise ValueError("no rows to fit")
    by_number = {k: s.view for s in models for k in [views[id(s.view)]]}
    centre = {k: np.nan_to_num(v.apply(matrix(pd.Series([one["x"]])))[0]) for k, v in by_number.items()}

    def moments(pdf: pd.DataFrame, acc: Partial) -> None:
        x, _, codes, _, _ = _batch(pdf)
        step = max(1, CELLS // (x.shape[1] + folds))
        for lo in range(0, len(x), step):
            _add_moments(x[lo : lo + step], codes[lo : lo + step], pairs, by_number, centre, folds, acc)

    sums = {p: a.reshape(folds + 1, -1) for p, a in zip(pairs, _in_order(sum_arrays(df, moments)))}
    out = []
    for s in models:
        k = views[id(s.view)]
        a = sums[k, s.design]
        a = a.sum(0) if whole_table else a.sum(0) - a[s.fold]
        n, d = a[0], (len(a) - 1) // 3
        cnt, s1, s2 = a[1 : 1 + d], a[1 + d : 1 + 2 * d], a[1 + 2 * d :]
        gap = s1 / np.maximum(cnt, 1)
        mean = np.where(cnt > 0, centre[k] + gap, 0.0)
        scale = np.sqrt(np.maximum(s2 - cnt * gap * gap, 0.0) / max(n, 1))
        scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
        out.append((mean, scale, int(round(n)), int(round(n * d - cnt.sum()))))
    return out


def _in_order(parts: dict[int, np.ndarray]) -> list[np.ndarray]:
    return [parts[i] for i in sorted(parts)]


def _views(models: Sequence[Spec]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in models:
        out.setdefault(id(s.view), len(out))
    return out


class _Block:
    """Models as columns over the raw features."""

    def __init__(self, models: Sequence[Spec], stats, width: int):
        self.models, m = models, len(models)
        self.mean, self.inverse = np.zeros((width, m)), np.zeros((width, m))
        for i, (s, (mean, scale, _, _)) in enumerate(zip(models, stats)):
            at = slice(None) if s.view.columns is None else list(s.view.columns)
            self.mean[at, i], self.inverse[at, i] = mean, 1 / scale
        self.design, self.fold = np.array([s.design for s in models]), np.array([s.fold for s in models])
        self.group = np.array(list(_views(models).values()))[[list(_views(models)).index(id(s.view)) for s in models]]
        self.basis = {int(g): s.view.basis for g, s in zip(self.group, models)}

    def project(self, w: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Columns ``own`` of the block, each without its view's removed directions."""
        out = w
        for g in np.unique(self.group[own]):
            basis = self.basis[int(g)]
            if basis is not None:
                out = w.copy() if out is w else out
                at = self.group[own] == g
                out[:, at] -= basis @ (basis.T @ out[:, at])
        return out

    def raw(self, beta: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights over raw features, intercepts, contribution of a missing value)."""
        w = self.inverse[:, own] * beta[1:]
        at_mean = self.mean[:, own] * w
        return self.project(w, own), beta[0] - at_mean.sum(axis=0), at_mean

    def slopes(self, total: np.ndarray, xg: np.ndarray, missing: np.ndarray | float, own: np.ndarray) -> np.ndarray:
        """Gradient over the standardised features from sums over the raw ones."""
        mean = self.mean[:, own]
        return np.vstack([total, self.inverse[:, own] * (self.project(xg, own) + mean * missing - mean * total)])


def _filled(x: np.ndarray, own: np.ndarray, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values with zeros where missing, and what is missing: for a projected view all of a row that misses any."""
    gone = np.isnan(x)
    if projected:
        gone = np.broadcast_to(gone.any(axis=1)[:, None], x.shape)
    return np.where(gone, 0.0, x), gone.astype(float)


def _scan(df: DataFrame, block: _Block, beta: np.ndarray, own: np.ndarray, per_row, holes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, weighted share of ones, gradient) of the models ``own`` at ``beta``, without the penalty."""
    width, m = len(beta) - 1, len(own)
    weights, intercepts, at_mean = block.raw(beta, own)
    projected = np.array([block.basis[int(g)] is not None for g in block.group[own]])
    design, fold = block.design[own], block.fold[own]

    def pass_(pdf: pd.DataFrame, acc: Partial) -> None:
        x_all, y_all, codes_all, _, w_all = _batch(pdf)
        step = max(1, CELLS // m)
        for lo in range(0, len(x_all), step):
            x, y, codes, w = x_all[lo : lo + step], y_all[lo : lo + step, design], codes_all[lo : lo + step, design], w_all[lo : lo + step, None]
            train = (codes != fold) & (codes >= 0)
            parts = [(slice(None), None)] if not np.isnan(x).any() else [(np.flatnonzero(projected == p), p) for p in (False, True)]
            for at, kind in parts:
                if kind is not None and not len(at):
                    continue
                v, gone = (x, None) if kind is None else _filled(x, own, kind)
                eta = v @ weights[:, at] + intercepts[at]
                if gone is not None:
                    eta += gone @ at_mean[:, at]
                value, slope, _ = per_row(eta, y[:, at])
                use = train[:, at] * w
                g = use * slope
                rows = [(use * value).sum(0), (use * y[:, at]).sum(0), use.sum(0), g.sum(0)]
                sums = np.vstack([*rows, v.T @ g] + ([gone.T @ g if gone is not None else np.zeros((width, g.shape[1]))] if holes else []))
                columns = np.arange(m)[at]
                for k in np.unique(columns // KEYED):
                    mine = columns // KEYED == k
                    whole = np.zeros((len(sums), min(KEYED, m - k * KEYED)))
                    whole[:, columns[mine] - k * KEYED] = sums[:, mine]
                    add_to(acc, int(k), whole)

    parts = [a.reshape(4 + width * (1 + holes), -1) for a in _in_order(sum_arrays(df, pass_))]
    a = np.hstack(parts)
    for j in range(m):
        if a[1, j] <= 0 or a[1, j] >= a[2, j]:
            raise ValueError(f"one training class for {block.models[own[j]]}")
    missing = a[4 + width :] if holes else 0.0
    return a[0], a[2], block.slopes(a[3], a[4 : 4 + width], missing, own)


class _History:
    """Steps and gradient changes of every model, one ring for all."""

    def __init__(self, length: int):
        self.length, self.s, self.y, self.rho = length, [], [], []

    def push(self, s: np.ndarray, y: np.ndarray) -> None:
        sy = (s * y).sum(axis=0)
        good = sy > 1e-12 * np.sqrt((s * s).sum(axis=0) * (y * y).sum(axis=0))
        self.s.append(s * good)
        self.y.append(y * good)
        self.rho.append(np.divide(1.0, sy, out=np.zeros_like(sy), where=good))
        if len(self.s) > self.length:
            self.s.pop(0), self.y.pop(0), self.rho.pop(0)

    def direction(self, g: np.ndarray) -> np.ndarray:
        q, alphas = g.copy(), []
        for s, y, rho in zip(reversed(self.s), reversed(self.y), reversed(self.rho)):
            alphas.append(rho * (s * q).sum(axis=0))
            q -= alphas[-1] * y
        gamma = np.ones(g.shape[1])
        for s, y in zip(self.s, self.y):  # the latest usable pair scales the start
            yy = (y * y).sum(axis=0)
            gamma = np.where(yy > 0, np.divide((s * y).sum(axis=0), yy, out=np.ones_like(yy), where=yy > 0), gamma)
        q *= gamma
        for s, y, rho, alpha in zip(self.s, self.y, self.rho, reversed(alphas)):
            q += (alpha - rho * (y * q).sum(axis=0)) * s
        return -q

    def keep(self, columns: np.ndarray) -> None:
        self.s, self.y = [s[:, columns] for s in self.s], [y[:, columns] for y in self.y]
        self.rho = [r[columns] for r in self.rho]


def _fit_block(df: DataFrame, models: Sequence[Spec], stats, width: int, *, loss: str, l2: float, tol: float, max_iter: int, history: int) -> list[Fit]:
    block, per_row, m = _Block(models, stats, width), LOSSES[loss], len(models)
    holes = any(s[3] for s in stats) or _has_holes(df)
    penalty = np.full((width + 1, 1), l2)
    penalty[0] = 0.0
    n = np.array([max(1, s[2]) for s in stats], dtype=float)
    beta, residual, iterations = np.zeros((width + 1, m)), np.full(m, np.inf), np.zeros(m, int)
    own = np.arange(m)
    at, past = beta.copy(), _History(history)
    value, _, g = _scan(df, block, at, own, per_row, holes)
    direction, step = -g / np.maximum(1.0, np.abs(g).max(axis=0)), np.ones(m)
    for _ in range(max_iter):
        residual[own] = np.abs(g).max(axis=0) / n[own]
        beta[:, own] = at
        live = residual[own] > tol
        if not live.all():
            own, at, g, value, direction, step = own[live], at[:, live], g[:, live], value[live], direction[:, live], step[live]
            past.keep(live)
        if not len(own):
            return [
                Fit(s, st[0], st[1], _own_columns(beta[:, i], s.view), st[2], st[3], int(iterations[i]), float(residual[i]))
                for i, (s, st) in enumerate(zip(models, stats))
            ]
        iterations[own] += 1
        trial = at + step * direction
        v, _, gt = _scan(df, block, trial, own, per_row, holes)
        v = v + 0.5 * (penalty * trial * trial).sum(axis=0)
        gt = gt + penalty * trial
        fine = v <= value + 1e-4 * step * (g * direction).sum(axis=0) + 1e-12 * np.abs(value)
        past.push((trial - at) * fine, (gt - g) * fine)
        at, g, value = np.where(fine, trial, at), np.where(fine, gt, g), np.where(fine, v, value)
        fresh = past.direction(g)
        downhill = (fresh * g).sum(axis=0) < 0
        fresh = np.where(downhill, fresh, -g / n[own])
        direction, step = np.where(fine, fresh, direction), np.where(fine, 1.0, step / 2)
    raise RuntimeError(f"{len(own)} models have not converged in {max_iter} scans, first {models[own[0]]}")


def _own_columns(beta: np.ndarray, view: View) -> np.ndarray:
    return beta if view.columns is None else beta[[0, *(c + 1 for c in view.columns)]]


def _has_holes(df: DataFrame) -> bool:
    return not df.where("exists(x, v -> isnan(v) OR v IS NULL)").isEmpty()


def fit_wide(
    df: DataFrame,
    models: Sequence[Spec],
    *,
    loss: str = "logistic",
    l2: float = 1.0,
    whole_table: bool = False,
    tol: float = 1e-7,
    max_iter: int = 1000,
    history: int = 10,
) -> list[Fit]:
    """What ``fit_linear`` fits, for any width: a free, unpenalised intercept and standardised features.

    ``kkt`` of a fit is the largest gradient component of its objective over its training rows; a model
    is done at ``tol``.  One that is not after ``max_iter`` scans is an error.
    """
    if any(s.own or s.view.max_rank is not None for s in models):
        raise ValueError("fit_wide takes fold models without ranks")
    stats = wide_statistics(df, models, whole_table=whole_table)
    missing = [s for s, st in zip(models, stats) if not st[2]]
    if missing:
        raise ValueError(f"no training rows for {missing[0]}")
    width = len(df.select("x").first()["x"])
    size = max(1, BLOCK_BYTES // ((2 * history + 8) * (width + 1) * 8))
    out: list[Fit] = []
    for lo in range(0, len(models), size):
        part = slice(lo, lo + size)
        out += _fit_block(df, models[part], stats[part], width, loss=loss, l2=l2, tol=tol, max_iter=max_iter, history=history)
    return out
