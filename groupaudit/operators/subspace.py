"""Identity subspaces: extraction, variance controls, projection and their gates.

Only d x d scatter matrices reach the driver (d up to a few thousand); rows stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupaudit.functions.hashing import hash_key, poisson_weight, uniform
from groupaudit.operators.arraysum import Partial, add_to, matrix, sum_arrays
from groupaudit.operators.ranks import hash_rank
from groupaudit.operators.signals import vector_functionals
from groupaudit.session import materialise


def group_means(units: DataFrame, *, group: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per group: mean vector, number of units and first values of ``extra``."""
    means = vector_functionals(units, by=[group], vector="x").select(group, F.col("mean").alias("x"), "n")
    if not extra:
        return means
    rest = units.groupBy(group).agg(*[F.min(c).alias(c) for c in extra])
    return means.join(rest, group)


def scatter(df: DataFrame, *, keep: Sequence[str]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(n, mean, centred covariance) of ``x`` over the rows each boolean column keeps, in one scan."""

    def acc_fn(pdf: pd.DataFrame, acc: Partial) -> None:
        x = matrix(pdf["x"])
        for i, c in enumerate(keep):
            v = x[pdf[c].to_numpy(bool)]
            add_to(acc, i, np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]))

    out = {}
    for i, a in sum_arrays(df.select("x", *keep), acc_fn).items():
        d = int(round((-1 + np.sqrt(1 + 4 * (len(a) - 1))) / 2))
        n, mean = a[0], a[1 : 1 + d] / max(a[0], 1.0)
        out[i] = (n, mean, a[1 + d :].reshape(d, d) / max(n, 1.0) - np.outer(mean, mean))
    return out


def top_directions(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(d x k basis of the largest directions, full spectrum in descending order)."""
    vals, vecs = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(vals)[::-1]
    return vecs[:, order[:k]], np.maximum(vals[order], 0.0)


def variance_share(basis: np.ndarray, cov: np.ndarray) -> float:
    return float(np.trace(basis.T @ cov @ basis) / np.trace(cov))


def variance_matched(cov: np.ndarray, k: int, target: float) -> tuple[np.ndarray, float]:
    """Principal rank-k subspace whose last member is chosen so that its share comes closest to a target.

    Shares fall along the spectrum; members past the first share at or below the target come no closer.
    """
    full, spectrum = top_directions(cov, len(cov))
    frac = spectrum / spectrum.sum()
    head = frac[: k - 1].sum()
    tail = head + frac[k - 1 :]
    reached = int(np.searchsorted(-tail, -target))
    best = int(np.abs(tail[: reached + 1] - target).argmin())
    return full[:, [*range(k - 1), k - 1 + best]], float(tail[best])


def haar_basis(d: int, k: int, seed: int) -> np.ndarray:
    """Uniformly random rank-k subspace."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, k)))
    return q * np.sign(np.diag(r))


def project_out(df: DataFrame, basis: np.ndarray) -> DataFrame:
    """``x`` minus its component in the span of an orthonormal basis."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["x"])
                pdf = pdf.assign(x=list(x - (x @ basis) @ basis.T))
            yield pdf

    return df.mapInPandas(run, df.schema)


def identity_probe(
    units: DataFrame, *, unit: str, group: str, n_way: int = 60, min_units: int = 12, seed: int = 0
) -> tuple[float, float]:
    """(accuracy, chance) of telling groups apart on units held out within each group.

    ``n_way`` groups of at least ``min_units`` units are drawn; half of each group's units train one
    softmax probe with standardised features and a penalty of 1/2 |w|^2.
    """
    sizes = units.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_units)
    drawn = hash_rank(sizes.withColumn("_h", hash_key(seed, group)), key="_h", out="_r").where(F.col("_r") <= n_way)
    rows = units.join(drawn.select(group, "_n", (F.col("_r") - 1).cast("double").alias("label")), group)
    rows = hash_rank(rows.withColumn("_h", hash_key(seed, group, unit)), part=[group], key="_h", out="_k")
    train = F.col("_k") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2))
    data = materialise(rows.select("label", array_to_vector("x").alias("raw"), train.alias("train")))
    fit, held = data.where("train"), data.where("NOT train")
    n, ways = fit.count(), drawn.count()
    if ways < 2:
        raise ValueError(f"fewer than two groups of {min_units} units: identity cannot be probed")
    centre = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(fit)
    # a column that is constant but for rounding, as projections leave them, is not blown up
    wide = [1 / s if s > 1e-12 * max(1.0, abs(m)) else 1.0 for m, s in zip(centre.mean, centre.std)]
    scale = ElementwiseProduct(inputCol="centred", outputCol="features", scalingVec=Vectors.dense(wide))
    probe = LogisticRegression(family="multinomial", regParam=1 / n, standardization=False, maxIter=200, tol=1e-4)
    scored = probe.fit(scale.transform(centre.transform(fit))).transform(scale.transform(centre.transform(held)))
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0], 1 / ways


@dataclass
class WithinClass:
    basis: np.ndarray
    spectrum: np.ndarray
    direction: np.ndarray
    max_cos: float
    in_span: float
    status: str


def within_class_subspace(means: DataFrame, k: int) -> WithinClass:
    """Between-group scatter around each class mean, and the gate that it holds no class direction.

    ``means`` has x, n, y per training group.  The class means are means over units.
    """

    def sums(pdf: pd.DataFrame, acc: Partial) -> None:
        x, n, y = matrix(pdf["x"]), pdf["n"].to_numpy(float), pdf["y"].to_numpy(int)
        for c in (0, 1):
            v, w = x[y == c], n[y == c]
            add_to(acc, c, np.concatenate([[w.sum()], w @ v, ((v * w[:, None]).T @ v).ravel()]))

    parts = sum_arrays(means.select("x", "n", "y"), sums)
    d = means.select(F.size("x")).first()[0]
    mu, s_b = {}, np.zeros((d, d))
    for c, a in parts.items():
        mu[c] = a[1 : 1 + d] / a[0]
        s_b += a[1 + d :].reshape(d, d) - a[0] * np.outer(mu[c], mu[c])
    basis, spectrum = top_directions(s_b, k)
    w = mu[1] - mu[0]
    unit = w / np.linalg.norm(w)
    cos = np.abs(basis.T @ unit)
    max_cos, span = float(cos.max()), float(np.linalg.norm(basis.T @ unit))
    return WithinClass(basis, spectrum, unit, max_cos, span, "OK" if max_cos < 0.10 and span < 0.20 else "BROKEN")


def direction_stability(means: DataFrame, *, group: str, n_boot: int = 100, seed: int = 0) -> np.ndarray:
    """Cosines between the class-mean direction and its re-extractions from resampled groups.

    Replicate weights are a hash expression per group, so all re-extractions take one scan.
    """
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: poisson_weight(uniform(seed, b, F.col(group)))
    )

    def sums(pdf: pd.DataFrame, acc: Partial) -> None:
        x, y = matrix(pdf["x"]), pdf["y"].to_numpy(int)
        w = np.column_stack([np.ones(len(pdf)), matrix(pdf["w"])])
        for c in (0, 1):
            v, ww = x[y == c], w[y == c]
            add_to(acc, c, np.column_stack([ww.sum(0), ww.T @ v]))

    parts = sum_arrays(means.select("x", "y", draws.alias("w")), sums)
    mu = {c: a.reshape(n_boot + 1, -1) for c, a in parts.items()}
    diff = mu[1][:, 1:] / mu[1][:, :1] - mu[0][:, 1:] / mu[0][:, :1]
    unit = diff / np.linalg.norm(diff, axis=1, keepdims=True)
    return unit[1:] @ unit[0]
