"""Many small models in one pass: logistic probes over repeats, folds and feature views.

A unit carries its feature array ``x`` (NaN = missing), label ``y`` and an array ``codes`` with
one partition code per design (for repeated folds: its fold in every repeat).  Model (view,
design, fold) trains on rows with another non-negative code and predicts the rows with its own.
All models advance together: one scan per Newton step, whatever their number.  An optional array
``ys`` gives every design its own label (permuted labels, for instance) in place of ``y``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.operators.arraysum import Partial, add_to, matrix, sum_arrays
from groupaudit.session import materialise, spread

if TYPE_CHECKING:
    from groupaudit.operators.foldblocks import Probes


@dataclass(frozen=True)
class View:
    """What a probe sees: a subset of columns, or all columns minus a projected-out basis."""

    name: str
    columns: tuple[int, ...] | None = None
    basis: np.ndarray | None = field(default=None, compare=False)
    max_rank: int | None = None  # train on groups whose rank is at most this

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = x if self.columns is None else x[:, list(self.columns)]
        return out if self.basis is None else out - (out @ self.basis) @ self.basis.T


@dataclass(frozen=True)
class Spec:
    view: View
    design: int
    fold: int
    own: bool = False  # train on the rows with this very code (a calibration slice)


@dataclass
class Fit:
    spec: Spec
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  # intercept first
    n_train: int
    n_imputed: int
    iterations: int
    kkt: float = float("nan")  # largest gradient component over the training rows


def attach_codes(units: DataFrame, folds: DataFrame, *, group: str) -> DataFrame:
    """Adds ``codes``: the group's fold in every repeat, in repeat order (one short array per group)."""
    codes = folds.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"]).alias("codes")
    )
    return units.join(codes, group)


def specs(views: Sequence[View], designs: int, folds: int) -> list[Spec]:
    return [Spec(v, d, f) for v in views for d in range(designs) for f in range(folds)]


def _train_mask(codes: np.ndarray, ranks: np.ndarray | None, s: Spec) -> np.ndarray:
    c = codes[:, s.design]
    mask = c == s.fold if s.own else (c != s.fold) & (c >= 0)
    if s.view.max_rank is not None:
        mask &= ranks[:, s.design] <= s.view.max_rank
    return mask


def _batch(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    codes = np.array(pdf["codes"].tolist(), dtype=np.int64)
    ranks = np.array(pdf["ranks"].tolist(), dtype=np.int64) if "ranks" in pdf else None
    w = pdf["w"].to_numpy(float) if "w" in pdf else np.ones(len(pdf))
    if "ys" in pdf:
        y = matrix(pdf["ys"])
    else:
        y = np.broadcast_to(pdf["y"].to_numpy(float)[:, None], codes.shape)
    return matrix(pdf["x"]), y, codes, ranks, w


def _counts(pdf: pd.DataFrame) -> np.ndarray:
    """How many units a row stands for."""
    return pdf["n"].to_numpy(float) if "n" in pdf else np.ones(len(pdf))


Statistics = dict[int, tuple[np.ndarray, np.ndarray, int, int]]


def train_statistics(df: DataFrame, models: Sequence[Spec], *, whole_table: bool = False) -> Statistics:
    """(mean, scale, n_train, n_imputed) per model, from training rows only by default.

    Missing values count as the training mean.  Standard deviations are population ones and a
    constant column gets scale 1.  ``whole_table`` is the leaky scope: test rows are included.
    Sums are taken about one row's values, so that a large offset costs no digits.
    """
    one = df.select("x").first()
    about = {id(s.view): np.nan_to_num(s.view.apply(matrix(pd.Series([one["x"]])))[0]) for s in models} if one else {}
    centre = [about.get(id(s.view)) for s in models]

    def moments(pdf: pd.DataFrame, acc: Partial) -> None:
        x, _, codes, ranks, _ = _batch(pdf)
        n = _counts(pdf)
        seen: dict[int, np.ndarray] = {}
        for i, s in enumerate(models):
            v = seen.setdefault(id(s.view), s.view.apply(x))
            use = codes[:, s.design] >= 0 if whole_table else _train_mask(codes, ranks, s)
            rows, m = v[use], n[use]
            ok = ~np.isnan(rows)
            z = np.where(ok, rows - centre[i], 0.0)
            add_to(acc, i, np.concatenate([[m.sum()], m @ ok, m @ z, m @ (z * z)]))

    out = {}
    for i, a in sum_arrays(df, moments).items():
        n, d = a[0], (len(a) - 1) // 3
        cnt, s1, s2 = a[1 : 1 + d], a[1 + d : 1 + 2 * d], a[1 + 2 * d :]
        gap = s1 / np.maximum(cnt, 1)
        mean = np.where(cnt > 0, centre[i] + gap, 0.0)
        # imputed rows sit at the mean, so they add nothing to the spread
        var = np.maximum(s2 - cnt * gap * gap, 0.0) / max(n, 1)
        scale = np.sqrt(var)
        scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
        out[i] = (mean, scale, int(n), int(n * d - cnt.sum()))
    return out


def _standard(v: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.nan_to_num((v - mean) / scale, nan=0.0)
    return np.column_stack([np.ones(len(z)), z])


def _logistic(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss per row with its first and second derivative in eta."""
    p = 1.0 / (1.0 + np.exp(-eta))
    return np.logaddexp(0.0, eta) - y * eta, p - y, p * (1 - p)


def _squared_hinge(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = 2 * y - 1
    gap = np.maximum(0.0, 1 - s * eta)
    return gap * gap, -2 * s * gap, 2.0 * (gap > 0)


LOSSES = {"logistic": _logistic, "squared_hinge": _squared_hinge}


def fit_linear(
    df: DataFrame,
    models: Sequence[Spec],
    *,
    loss: str = "logistic",
    l2: float = 1.0,
    scale: bool = True,
    intercept: bool = True,
    penalise_intercept: bool = False,
    whole_table: bool = False,
    tol: float = 1e-8,
    max_iter: int = 50,
) -> list[Fit]:
    """Newton's method on sum of losses + l2/2 |w|^2, all models per scan.

    With the logistic loss, l2 = 1 and a free intercept this is the usual C = 1 logistic
    regression.  Steps are halved for a model whose objective went up.  Meant for d up to a few
    hundred: one scan adds up a d x d matrix per model.  A model that has not converged after
    ``max_iter`` scans is an error: its coefficients are not used as if fitted.
    """
    first = train_statistics(df, models, whole_table=whole_table)
    per_row = LOSSES[loss]

    def scan(trial: dict[int, np.ndarray], stats: Statistics) -> Partial:
        def newton(pdf: pd.DataFrame, acc: Partial) -> None:
            x, y, codes, ranks, w = _batch(pdf)
            w = w * _counts(pdf)
            for i, b in trial.items():
                s = models[i]
                m = _train_mask(codes, ranks, s)
                if not m.any():
                    continue
                z = _standard(s.view.apply(x[m]), stats[i][0], stats[i][1])
                if not intercept:
                    z[:, 0] = 0.0
                yy, ww = y[m, s.design], w[m]
                value, slope, curve = per_row(z @ b, yy)
                grad = z.T @ (ww * slope)
                hess = (z * (ww * curve)[:, None]).T @ z
                add_to(acc, i, np.concatenate([[ww @ value, ww @ yy, ww.sum()], grad, hess.ravel()]))

        return sum_arrays(df, newton)

    return newton_fits(
        models, first, scan, l2=l2, scale=scale, intercept=intercept, penalise_intercept=penalise_intercept, tol=tol, max_iter=max_iter
    )


def newton_fits(
    models: Sequence[Spec],
    first: Statistics,
    scan: Callable[[dict[int, np.ndarray], Statistics], Partial],
    *,
    l2: float = 1.0,
    scale: bool = True,
    intercept: bool = True,
    penalise_intercept: bool = False,
    tol: float = 1e-8,
    max_iter: int = 50,
) -> list[Fit]:
    """The steps of ``fit_linear``: ``scan`` gives sums (loss, labels, weights, gradient, Hessian) at coefficients."""
    missing = [s for i, s in enumerate(models) if i not in first or first[i][2] == 0]
    if missing:
        raise ValueError(f"no training rows for {missing[0]}")
    stats = {
        i: (m if scale else np.zeros_like(m), s if scale else np.ones_like(s), n, k) for i, (m, s, n, k) in first.items()
    }
    beta = {i: np.zeros(len(stats[i][0]) + 1) for i in stats}
    step = {i: np.zeros_like(b) for i, b in beta.items()}
    best = {i: np.inf for i in beta}
    iters = {i: 0 for i in beta}
    kkt = {i: np.inf for i in beta}
    active = set(beta)
    for _ in range(max_iter):
        trial = {i: beta[i] + step[i] for i in active}
        for i, a in scan(trial, stats).items():
            b, d = trial[i], len(trial[i])
            if a[1] <= 0 or a[1] >= a[2]:
                raise ValueError(f"one training class for {models[i]}")
            reg = np.full(d, l2)
            if not penalise_intercept:
                reg[0] = 0.0 if intercept else 1.0
            value = a[0] + 0.5 * float(reg @ (b * b))
            iters[i] += 1
            if not np.isfinite(value) or value > best[i] + 1e-9 * max(1.0, abs(best[i])):
                step[i] = step[i] / 2
            else:
                beta[i], best[i] = b, value
                grad, hess = a[3 : 3 + d] + reg * b, a[3 + d :].reshape(d, d) + np.diag(reg)
                step[i] = -np.linalg.lstsq(hess, grad, rcond=None)[0]
                kkt[i] = float(np.abs(grad).max() / max(1, stats[i][2]))
            if np.abs(step[i]).max() < tol:
                active.discard(i)
        if not active:
            break
    if active:
        raise RuntimeError(f"{len(active)} models have not converged in {max_iter} scans, first {models[min(active)]}")
    return [Fit(s, stats[i][0], stats[i][1], beta[i], stats[i][2], stats[i][3], iters[i], kkt[i]) for i, s in enumerate(models)]


def sigmoid(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-eta))


PREDICTIONS = "head string, repeat int, fold int, unit_id string, group_id string, y int, p double"


def predict(
    df: DataFrame,
    fits: Sequence[Fit],
    *,
    unit: str,
    group: str,
    code: int | None = None,
    platt: Sequence[tuple[float, float]] | None = None,
    margin: bool = False,
) -> DataFrame:
    """Long prediction table: each model scores the rows of its own fold, or those with ``code``.

    ``p`` is the logistic of the margin, of ``b0 + b1 * margin`` with ``platt`` pairs, or the bare margin.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, codes, _, _ = _batch(pdf)
            for i, f in enumerate(fits):
                m = codes[:, f.spec.design] == (f.spec.fold if code is None else code)
                if not m.any():
                    continue
                eta = _standard(f.spec.view.apply(x[m]), f.mean, f.scale) @ f.beta
                if platt is not None:
                    eta = platt[i][0] + platt[i][1] * eta
                yield pd.DataFrame(
                    {
                        "head": f.spec.view.name,
                        "repeat": f.spec.design,
                        "fold": f.spec.fold,
                        "unit_id": pdf["_unit"].to_numpy()[m],
                        "group_id": pdf["_group"].to_numpy()[m],
                        "y": y[m, f.spec.design].astype(int),
                        "p": eta if margin else sigmoid(eta),
                    }
                )

    extra = ["ys"] if "ys" in df.columns else []
    d = df.select("x", "y", "codes", *extra, F.col(unit).cast("string").alias("_unit"), F.col(group).cast("string").alias("_group"))
    return d.mapInPandas(run, PREDICTIONS)


def out_of_fold(
    units: DataFrame,
    folds: DataFrame,
    *,
    unit: str,
    group: str,
    views: Sequence[View],
    n_folds: int,
    repeats: int,
    provenance: str | None = None,
    fit=None,
    **fit_args,
) -> DataFrame:
    """Gate, scale on train, fit and score every (view, repeat, fold); the result is materialised once.

    ``fit`` is ``fit_linear`` unless another is given (``wide.fit_wide`` for wide features).
    """
    from groupaudit.operators.splits import require_disjoint

    folds = materialise(folds.select(group, "repeat", "fold"))
    # units get their fold through the group key, so the gate on the group table covers them
    require_disjoint(folds, group=group)
    if provenance and not units.where(F.col(provenance) != "participant").isEmpty():
        raise ValueError("group ids are recording proxies: no group-disjoint claim is possible")
    data = spread(attach_codes(units, folds, group=group))
    fits = (fit or fit_linear)(data, specs(views, repeats, n_folds), **fit_args)
    return materialise(predict(data, fits, unit=unit, group=group))


def _counted(df: DataFrame, columns: Sequence[int], counts: Sequence[Column]) -> DataFrame:
    # what the view does not see is 0, so that it tells no rows apart
    seen = F.transform("x", lambda e, i: F.when(i.isin(list(columns)), e).otherwise(0.0))
    return df.withColumn("x", seen).groupBy("x", "y").agg(*counts)


def _collapsed(data: DataFrame, views: Sequence[View], *, n_folds: int, repeats: int, together: bool = False) -> DataFrame:
    """Units counted by what one view sees of them, label, repeat and fold; view k has the designs from k * repeats.

    ``together`` counts once by what all views see, and adds these counts up for each view.
    """
    cells = [(r, f, f"n{r}_{f}") for r in range(repeats) for f in range(n_folds)]
    units, add = [F.count_if(F.get("codes", F.lit(r)) == f).alias(n) for r, f, n in cells], [F.sum(n).alias(n) for _, _, n in cells]
    base = materialise(_counted(data, sorted({c for v in views for c in v.columns}), units)) if together else None
    out = None
    for k, v in enumerate(views):
        counts = _counted(base, v.columns, add) if together else _counted(data, v.columns, units)
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(f).alias("f"), F.col(n).alias("n")) for r, f, n in cells]))
        rows = counts.select("x", "y", each.alias("c")).where("c.n > 0")
        at = F.lit(k * repeats) + F.col("c.r")
        codes = F.transform(F.sequence(F.lit(0), F.lit(len(views) * repeats - 1)), lambda i: F.when(i == at, F.col("c.f")).otherwise(-1))
        part = rows.select("x", "y", codes.alias("codes"), F.col("c.n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


SCORES = "head string, repeat int, y int, p double, n long"
REPEATED = 4  # units of one count from which counting pays


def predict_counts(df: DataFrame, fits: Sequence[Fit], *, repeats: int) -> DataFrame:
    """Scores of every model's own fold without ids: (head, repeat, y, p) and how many units of a batch have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, codes, _, _ = _batch(pdf)
            n = _counts(pdf)
            for f in fits:
                m = codes[:, f.spec.design] == f.spec.fold
                if not m.any():
                    continue
                p = sigmoid(_standard(f.spec.view.apply(x[m]), f.mean, f.scale) @ f.beta)
                yield pd.DataFrame(
                    {"head": f.spec.view.name, "repeat": f.spec.design % repeats, "y": y[m, f.spec.design].astype(int), "p": p, "n": n[m].astype(int)}
                )

    extra = [c for c in ("n",) if c in df.columns]
    return df.select("x", "y", "codes", *extra).mapInPandas(run, SCORES)


def _in_turn(
    units: DataFrame, folds: DataFrame, *, group: str, views: Sequence[View], n_folds: int, repeats: int
) -> tuple[DataFrame, list[tuple[DataFrame, list[Fit]]], Probes | None]:
    """Units with codes, (table, fits) of the views taken row by row or by counts, and the probes fitted on blocks.

    Views that see few distinct values are fitted on counts of equal rows, other narrow ones on blocks, the rest
    row by row.  Which way a view takes changes the work and not the models: sums over counts are sums over rows.
    """
    from groupaudit.operators import foldblocks
    from groupaudit.operators.splits import require_disjoint

    folds = materialise(folds.select(group, "repeat", "fold"))
    require_disjoint(folds, group=group)
    data = spread(attach_codes(units, folds, group=group).select("x", "y", "codes"))
    plain = [k for k, v in enumerate(views) if v.columns is not None and v.basis is None and v.max_rank is None]
    seen = [F.approx_count_distinct(F.array(*[F.get("x", F.lit(c)) for c in views[k].columns])).alias(f"v{k}") for k in plain]
    size = data.agg(F.count("*").alias("n"), *seen).first()
    least = 2 * n_folds * REPEATED
    few = [k for k in plain if size[f"v{k}"] * least <= size["n"]]
    narrow = [views[k] for k in plain if k not in few and 0 < len(views[k].columns) <= foldblocks.NARROW]
    many = [v for k, v in enumerate(views) if k not in few and not any(v is w for w in narrow)]
    out = []
    if few:
        most, covered = 1, set()  # of the rows all these views tell apart
        for k in sorted(few, key=lambda k: -len(views[k].columns)):
            if not covered.issuperset(views[k].columns):
                most, covered = most * size[f"v{k}"], covered | set(views[k].columns)
        seldom = [views[k] for k in few]
        cells = spread(_collapsed(data, seldom, n_folds=n_folds, repeats=repeats, together=most * least <= size["n"]))
        models = [Spec(v, k * repeats + r, f) for k, v in enumerate(seldom) for r in range(repeats) for f in range(n_folds)]
        out.append((cells, fit_linear(cells, models)))
    if many:
        out.append((data, fit_linear(data, specs(many, repeats, n_folds))))
    if not narrow:
        return data, out, None
    return data, out, foldblocks.Probes(foldblocks.Blocks(data, narrow, n_folds=n_folds, repeats=repeats, n=size["n"]))


def out_of_fold_counts(
    units: DataFrame, folds: DataFrame, *, group: str, views: Sequence[View], n_folds: int, repeats: int
) -> DataFrame:
    """``out_of_fold`` for metrics that need no ids: (head, repeat, y, p, n), n units each."""
    data, fitted, probes = _in_turn(units, folds, group=group, views=views, n_folds=n_folds, repeats=repeats)
    fitted += [(data, probes.fits)] if probes else []
    return materialise(reduce(DataFrame.unionByName, [predict_counts(df, fits, repeats=repeats) for df, fits in fitted]))


def out_of_fold_auc(
    units: DataFrame, folds: DataFrame, *, group: str, views: Sequence[View], n_folds: int, repeats: int
) -> DataFrame:
    """(head, repeat, n_pos, n_neg, auc) of ``out_of_fold``'s scores, which are no table of rows where views are narrow."""
    from groupaudit.operators.metrics import roc_auc

    _, fitted, probes = _in_turn(units, folds, group=group, views=views, n_folds=n_folds, repeats=repeats)
    out = [probes.auc()] if probes else []
    if fitted:
        counts = materialise(reduce(DataFrame.unionByName, [predict_counts(df, fits, repeats=repeats) for df, fits in fitted]))
        out.append(roc_auc(counts, score="p", label="y", by=["head", "repeat"], weight="n"))
    return reduce(DataFrame.unionByName, out)


def confound_features(df: DataFrame, *, age: str, sex: str, duration: str, rms: str) -> DataFrame:
    """Covariates as one array: age (NaN when missing), male flag, duration, loudness."""
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    male = F.upper(F.coalesce(F.col(sex), F.lit(""))).startswith("M").cast("double")
    return df.withColumn("x", F.array(num(age), male, num(duration), num(rms)))


# The six confound sets as columns of ``confound_features``.
CONFOUND_SETS = {
    "age_only": (0,),
    "sex_only": (1,),
    "age_sex": (0, 1),
    "duration_only": (2,),
    "intensity_rms_only": (3,),
    "age_sex_duration_rms": (0, 1, 2, 3),
}


def confound_views(names: Sequence[str] = tuple(CONFOUND_SETS)) -> list[View]:
    unknown = sorted(set(names) - set(CONFOUND_SETS))
    if unknown:
        raise ValueError(f"unknown confound set {unknown[0]!r}; known: {sorted(CONFOUND_SETS)}")
    return [View(f"confound::{n}", CONFOUND_SETS[n]) for n in names]


def svm_platt(
    units: DataFrame, inner: DataFrame, *, unit: str, group: str, n_outer: int, n_inner: int, c: float = 0.1
) -> DataFrame:
    """Linear SVM (squared hinge) with sigmoid calibration on group-disjoint inner folds.

    ``inner`` has (outer_fold, group, inner_fold) for training groups.  Every (outer, inner) copy
    is fitted at once, calibrated on its held-out inner fold and averaged on the outer test rows.
    """
    designs = inner.select(F.col("outer_fold").alias("repeat"), group, F.col("inner_fold").alias("fold"))
    people = units.select(group).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_outer - 1))))
    # a group without an inner fold is on the outer test side
    codes = people.join(designs, ["repeat", group], "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    data = spread(attach_codes(units, codes, group=group))
    fits = fit_linear(
        data, specs([View("linsvm")], n_outer, n_inner), loss="squared_hinge", l2=1.0 / c, penalise_intercept=True
    )
    held = predict(data, fits, unit=unit, group=group, margin=True)
    slices = held.select("y", F.array("p").alias("x"), F.array(F.col("repeat") * n_inner + F.col("fold")).alias("codes"))
    every = range(n_outer * n_inner)
    sig = fit_linear(
        materialise(slices), [Spec(View("platt"), 0, k, own=True) for k in every], l2=1e-6, scale=False
    )
    out = predict(data, fits, unit=unit, group=group, code=-1, platt=[tuple(s.beta) for s in sig])
    return out.groupBy("head", F.col("repeat").alias("fold"), "unit_id", "group_id", "y").agg(F.avg("p").alias("p"))


# --- residualisation ------------------------------------------------------------------


def residualise(df: DataFrame, *, covariates: str, train: str) -> DataFrame:
    """Replace ``x`` by its residual on the covariates, with coefficients from training rows only."""

    def normal(pdf: pd.DataFrame, acc: Partial) -> None:
        m = pdf[train].to_numpy(bool)
        z, x = matrix(pdf[covariates])[m], matrix(pdf["x"])[m]
        z = np.column_stack([np.ones(len(z)), z])
        add_to(acc, 0, np.column_stack([z.T @ z, z.T @ x]))

    flat = sum_arrays(df.select(covariates, "x", train), normal)[0]
    k = df.select(F.size(covariates)).first()[0] + 1
    both = flat.reshape(k, -1)
    coef = np.linalg.lstsq(both[:, :k], both[:, k:], rcond=None)[0]
    schema = df.schema

    def subtract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                z = matrix(pdf[covariates])
                pdf = pdf.assign(x=list(matrix(pdf["x"]) - np.column_stack([np.ones(len(z)), z]) @ coef))
            yield pdf

    return df.mapInPandas(subtract, schema)


def propensity_weights(predictions: DataFrame, *, floor: float = 0.01) -> DataFrame:
    """Inverse of the fitted probability of the observed class, clipped away from 0."""
    p_own = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return predictions.withColumn("w", 1 / F.greatest(p_own, F.lit(floor)))
