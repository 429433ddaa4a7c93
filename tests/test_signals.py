"""Frame functionals against plain loops."""

import numpy as np
import pandas as pd
import pytest

from groupaudit.operators import inference as inf
from groupaudit.operators import signals as sg
from groupaudit.operators import splits as sp


def slopes(x):
    """Nine-frame regression slopes; the outermost windows give those of the four frames beyond them."""
    n, k = len(x), np.arange(-4, 5)
    inner = np.array([k @ x[t - 4 : t + 5] / 60 for t in range(4, n - 4)])
    return np.concatenate([np.repeat(inner[:1], 4, axis=0), inner, np.repeat(inner[-1:], 4, axis=0)])


@pytest.mark.parametrize("cell", [4, 7, 4096])
def test_coefficient_functionals_across_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(sg, "CELL", cell)
    rng = np.random.default_rng(2)
    tracks = {f"r{n}": rng.standard_normal((n, 3)).cumsum(axis=0) for n in (1, 9, 10, 11, 40)}
    rows = [(name, 5 * i - 3, x.tolist()) for name, t in tracks.items() for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "rec string, t int, x array<double>").repartition(5)
    got = {r["rec"]: r for r in sg.coefficient_functionals(df, rec="rec", frame="t", vector="x").collect()}
    for name, t in tracks.items():
        assert got[name]["n"] == len(t) and got[name]["mean"] == pytest.approx(t.mean(0))
        assert got[name]["std"] == pytest.approx(t.std(0), abs=1e-9)
        want = slopes(t).std(0) if len(t) > 9 else np.zeros(3)
        assert got[name]["delta_std"] == pytest.approx(want, abs=1e-9)


def test_block_shuffle_keeps_each_blocks_labels(spark):
    pdf = pd.DataFrame({"g": range(100), "t": [i * 7 % 100 for i in range(100)], "y": [int(i * 7 % 100 < 50) for i in range(100)]})
    df = spark.createDataFrame(pdf)
    moved = sp.shuffle_labels(df, group="g", label="y", mode="block", time="t", n_blocks=4, seed=3).toPandas().merge(pdf, on="g")
    for k, b in moved.groupby("block"):
        assert len(b) == 25 and b.t.min() == 25 * k and b.y.sum() == b.y_shuffled.sum()
    with pytest.raises(ValueError, match="lacks its time"):
        sp.shuffle_labels(df, group="g", label="y", mode="block")
    with pytest.raises(ValueError, match="unknown shuffle mode"):
        sp.shuffle_labels(df, group="g", label="y", mode="soft")


def test_chance_follows_metric_and_classes(spark):
    df = spark.createDataFrame([(c,) for c in ["a"] * 5 + ["b"] * 3 + ["c"] * 2 + [None]], "y string")
    level = {m: inf.chance_baseline(df, label="y", metric=m).first()["chance"] for m in ("auc", "accuracy", "uar", "r2")}
    assert level == {"auc": 0.5, "accuracy": 0.5, "uar": pytest.approx(1 / 3), "r2": 0.0}
    with pytest.raises(ValueError, match="no rule"):
        inf.chance_baseline(df, label="y", metric="bleu")
    scores = spark.createDataFrame([("m", 0.9, 0.34, 1 / 3)] * 3, "k string, real double, shuffled double, c double")
    from pyspark.sql import functions as F

    assert inf.shuffle_verdict(scores, by=["k"], chance=F.col("c")).first()["verdict"] == "PASS"
    assert inf.shuffle_verdict(scores, by=["k"]).first()["verdict"] == "WEAK"
