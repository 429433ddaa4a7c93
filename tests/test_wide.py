"""Wide probes against the narrow solver and their own optimality conditions."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupaudit.operators import models as mod
from groupaudit.operators import wide
from groupaudit.operators.wide import fit_wide
from groupaudit.session import materialise


def table(spark, n=240, d=12, holes=False, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.uniform(0.1, 50, d) + rng.uniform(-900, 900, d)
    z = (x - x.mean(0)) / x.std(0)
    y = (z @ rng.standard_normal(d) / np.sqrt(d) + rng.standard_normal(n) > 0).astype(int)
    if holes:
        x[rng.random((n, d)) < 0.05] = np.nan
    codes = np.column_stack([rng.integers(-1, 3, n), rng.integers(0, 3, n)])
    pdf = pd.DataFrame({"u": range(n), "g": [str(i) for i in range(n)], "y": y, "x": x.tolist(), "codes": codes.tolist()})
    df = spark.createDataFrame(pdf).withColumn("codes", F.col("codes").cast("array<int>")).withColumn("w", F.lit(1.0) + F.col("u") % 3)
    return materialise(df.repartition(3))


def views(d, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, 3)))
    return [mod.View("all"), mod.View("some", (1, 4, 2)), mod.View("removed", basis=q)]


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("whole", [False, True])
def test_equals_the_narrow_solver(spark, holes, whole):
    df = table(spark, holes=holes)
    specs = mod.specs(views(12), 2, 3)
    a = mod.fit_linear(df, specs, whole_table=whole)
    b = fit_wide(df, specs, whole_table=whole, tol=1e-9)
    for x, y in zip(a, b):
        assert x.spec == y.spec and (x.n_train, x.n_imputed) == (y.n_train, y.n_imputed)
        assert y.mean == pytest.approx(x.mean, rel=1e-9, abs=1e-9) and y.scale == pytest.approx(x.scale, rel=1e-8)
        assert y.beta == pytest.approx(x.beta, abs=2e-5) and y.kkt <= 1e-9


def test_blocks_do_not_change_a_fit(spark, monkeypatch):
    df, specs = table(spark), mod.specs(views(12), 2, 3)
    whole = fit_wide(df, specs)
    monkeypatch.setattr("groupaudit.operators.wide.BLOCK_BYTES", 1)
    monkeypatch.setattr("groupaudit.operators.wide.CELLS", 50)
    for x, y in zip(whole, fit_wide(df, specs)):
        assert x.beta == pytest.approx(y.beta, abs=1e-4)


def test_more_features_than_rows(spark):
    df = table(spark, n=60, d=300)
    fits = fit_wide(df, mod.specs([mod.View("all")], 2, 3))
    assert all(f.kkt <= 1e-7 and len(f.beta) == 301 for f in fits)
    rows = df.toPandas()
    x, codes = np.array(rows.x.tolist()), np.array(rows.codes.tolist())
    for f in fits:  # the gradient of the stated objective, computed apart
        use = (codes[:, f.spec.design] != f.spec.fold) & (codes[:, f.spec.design] >= 0)
        z = np.column_stack([np.ones(use.sum()), (x[use] - x[use].mean(0)) / x[use].std(0)])
        w = rows.w.to_numpy()[use]
        g = z.T @ (w * (1 / (1 + np.exp(-z @ f.beta)) - rows.y.to_numpy()[use])) + f.beta * np.r_[0, np.ones(300)]
        assert np.abs(g).max() / use.sum() <= 1.01e-7


def test_errors(spark):
    df = table(spark)
    with pytest.raises(RuntimeError, match="not converged"):
        fit_wide(df, mod.specs([mod.View("all")], 1, 1), max_iter=2)
    with pytest.raises(ValueError, match="one training class"):
        fit_wide(df.withColumn("y", F.lit(1)), mod.specs([mod.View("all")], 1, 1))
    with pytest.raises(ValueError, match="no rows"):
        fit_wide(df.where("false"), mod.specs([mod.View("all")], 1, 1))


def test_statistics_hold_one_view_at_a_time():
    rng = np.random.default_rng(0)
    x, codes = rng.standard_normal((2_000, 32)), rng.integers(0, 3, (2_000, 2))
    many = {k: v for k, v in enumerate(views(32) * 20)}
    pairs = [(k, d) for k in many for d in range(2)]
    centre = {k: np.zeros(v.apply(x[:1]).shape[1]) for k, v in many.items()}
    tracemalloc.start()
    wide._add_moments(x, codes, pairs, many, centre, 3, acc := {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(acc) == len(pairs) and peak < 8 * x.nbytes
