"""Metrics against brute force, under skew and under different partition counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupaudit.operators import metrics as m
from groupaudit.operators import ranks as rk


def brute_auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    num = den = 0.0
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            num += w[i] * w[j] * (1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0)
            den += w[i] * w[j]
    return num / den


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame(
        {
            "unit": np.arange(n),
            # one group holds half of all rows and one score holds a third of them
            "g": np.where(np.arange(n) % 2 == 0, 0, rng.integers(1, 6, n)),
            "y": rng.integers(0, 2, n),
            "s": np.where(rng.random(n) < 0.35, 0.5, rng.integers(0, 40, n) / 40.0),
            "w": rng.integers(0, 3, n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 5, 32])
@pytest.mark.parametrize("bounds", [None, [], [0.2, 0.5, 0.9]])
def test_auc_is_exact_for_any_bucketing(spark, scored, parts, bounds):
    pdf, df = scored
    got = m.roc_auc(df.repartition(parts), score="s", label="y", weight="w", bounds=bounds).first()["auc"]
    assert got == pytest.approx(brute_auc(pdf.y.to_numpy(), pdf.s.to_numpy(), pdf.w.to_numpy()), abs=1e-12)


def test_auc_by_group_and_one_class(spark, scored):
    pdf, df = scored
    got = {r["g"]: r["auc"] for r in m.roc_auc(df, score="s", label="y", by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(brute_auc(part.y.to_numpy(), part.s.to_numpy()), abs=1e-12)
    one = m.roc_auc(df.where("y = 1"), score="s", label="y").first()
    assert one["auc"] is None and one["n_neg"] == 0


def test_missing_scores_are_excluded(spark):
    rows = [(1, 0.9), (0, 0.1), (1, float("nan")), (0, None), (None, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    r = m.roc_auc(df, score="s", label="y").first()
    assert (r["n_pos"], r["n_neg"], r["auc"]) == (1.0, 1.0, 1.0)


def test_ece_bin_edges(spark):
    rows = [(1, 1.0), (0, 0.0), (1, 1 / 15), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    bins = [r[0] for r in df.select(m.width_bin(F.col("s")).alias("b")).collect()]
    assert bins == [14, 0, 1, 7]


def test_equal_mass_sizes_match_an_even_split(spark, scored):
    pdf, df = scored
    got = sorted((r["bin"], r["n"]) for r in m.equal_mass_bins(df, score="s", label="y", unit="unit").collect())
    want = [(i, len(b)) for i, b in enumerate(np.array_split(np.arange(len(pdf)), 15))]
    assert got == want


def test_murphy_identity_for_binned_scores(spark):
    rows = [(int(i % 3 == 0), (i % 15 + 0.5) / 15) for i in range(300)]
    r = m.brier_decomposition(spark.createDataFrame(rows, "y int, s double"), score="s", label="y").first()
    assert r["brier"] == pytest.approx(r["reliability"] - r["resolution"] + r["uncertainty"], abs=1e-12)


def test_f1_is_zero_without_any_positive(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    r = m.threshold_metrics(df, score="s", label="y").first()
    assert (r["f1"], r["uar"], r["accuracy"]) == (0.0, 1.0, 1.0)


def test_group_label_half_goes_to_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 0, 0.4), ("b", 1, 0.9)], "g string, y int, s double")
    got = {r["g"]: (r["y"], r["p"]) for r in m.to_group_scores(df, group="g", score="s", label="y").collect()}
    assert got["a"][0] == 0 and got["a"][1] == pytest.approx(0.3) and got["b"] == (1, 0.9)


@pytest.mark.parametrize("ascending", [True, False])
def test_value_rank_with_a_hot_value(spark, scored, ascending):
    pdf, df = scored
    ranked = rk.value_rank(df, value="s", tie="unit", out="rn", ascending=ascending).toPandas()
    assert sorted(ranked.rn) == list(range(1, len(pdf) + 1))
    by_rank = ranked.sort_values("rn").s.to_numpy()
    assert (np.diff(by_rank) >= 0).all() if ascending else (np.diff(by_rank) <= 0).all()


def test_running_before_matches_pandas(spark, scored):
    pdf, df = scored
    got = rk.running_before(
        df, part=["g"], order="unit", tie="unit", last={"prev": "s"}, sums={"tot": "w"}, maxs={"best": "s"}
    ).toPandas().sort_values("unit")
    p = pdf.sort_values("unit")
    grouped = p.groupby("g")
    assert np.allclose(got.prev.to_numpy(float), grouped.s.shift().to_numpy(float), equal_nan=True)
    assert (got.tot.to_numpy() == (grouped.w.cumsum() - p.w).to_numpy()).all()
    assert np.allclose(got.best.to_numpy(float), grouped.s.transform(lambda x: x.cummax().shift()).to_numpy(float), equal_nan=True)


def test_exact_percentiles_equal_numpy(spark, scored):
    pdf, df = scored
    got = {r["g"]: r for r in rk.exact_percentiles(df, by=["g"], value="s", qs={"a": 0.2, "b": 0.5, "c": 0.87}).collect()}
    for g, part in pdf.groupby("g"):
        assert [got[g][k] for k in "abc"] == pytest.approx(np.percentile(part.s, [20, 50, 87]))


@pytest.mark.parametrize("n", [0, 1, 63, 300, 1000])
def test_bucket_of_any_number_of_edges(spark, n):
    rng = np.random.default_rng(n)
    bounds = sorted({float(b) for b in rng.random(n).round(4)})
    x = np.concatenate([rng.random(200), bounds, [-1.0, 2.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = df.select("x", rk.bucket_of(F.col("x"), bounds).alias("b")).toPandas()
    assert (got.b.to_numpy() == np.searchsorted(bounds, got.x, side="right")).all()
