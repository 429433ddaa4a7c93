"""Folds, gates and matching on deliberately bad and skewed inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupaudit.operators import audits as au
from groupaudit.operators import designs as ds
from groupaudit.operators import splits as sp


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(2)
    n = 600
    # group 0 owns a third of all units
    pdf = pd.DataFrame({"u": np.arange(n), "g": np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 60, n))})
    pdf["y"] = (pdf.g % 2).astype(int)
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 32])
def test_folds_balance_groups_of_each_label(units, parts):
    f = sp.stratified_folds(units.repartition(parts), group="g", label="y", n_folds=5, repeats=2).toPandas()
    assert len(f) == 2 * f.g.nunique()
    for _, part in f.groupby(["repeat", "y"]):
        sizes = part.fold.value_counts().reindex(range(5), fill_value=0)
        assert sizes.max() - sizes.min() <= 1


def test_folds_do_not_depend_on_partitioning(units):
    a, b = (sp.stratified_folds(units.repartition(n), group="g", label="y").orderBy("g").toPandas() for n in (1, 32))
    assert a.equals(b)


def test_round_robin_equals_fewest_first():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 101)
    counts = np.zeros((5, 2), int)
    seen = [0, 0]
    for lab in labels:
        fewest = int(np.argmin(counts[:, lab]))
        assert fewest == seen[lab] % 5
        counts[fewest, lab] += 1
        seen[lab] += 1


def test_balanced_folds_stay_within_the_bound(units):
    r = sp.fold_balance(sp.balanced_folds(units, group="g", repeats=2)).collect()
    assert all(x["within_bound"] for x in r)


def test_inner_folds_never_touch_the_outer_test_side(units):
    f = sp.balanced_folds(units, group="g")
    inner = sp.inner_folds(f, group="g", outer=5)
    both = inner.join(f.select("g", F.col("fold").alias("own")), "g").where("own = outer_fold")
    assert both.isEmpty()


def test_leaky_fold_is_refused(spark):
    rows = [(0, 0, "a"), (0, 1, "a"), (0, 1, "b")]
    df = spark.createDataFrame(rows, "repeat int, fold int, g string")
    with pytest.raises(ValueError, match="group leakage"):
        sp.require_disjoint(df, group="g")
    clean = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "repeat int, fold int, g string")
    sp.require_disjoint(clean, group="g")


def test_disjointness_is_told_by_one_aggregation_and_no_fold_beside_a_fold_is_a_leak(spark, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "repeat int, g string, fold int")
    calls, whole = [], sp.disjointness_evidence
    monkeypatch.setattr(sp, "disjointness_evidence", lambda *a, **k: calls.append(1) or whole(*a, **k))
    sp.require_disjoint(rows((0, "a", 0), (0, "a", 0), (0, "b", None), (1, "a", 1), (1, None, 2)), group="g")
    assert not calls
    for leak in (rows((0, "a", 0), (0, "a", None), (0, "b", 1)), rows((0, "b", 1), (1, "a", 0), (1, "a", 1))):
        with pytest.raises(ValueError, match="group leakage"):
            sp.require_disjoint(leak, group="g")


def test_proxy_ids_cannot_carry_a_split_claim(spark):
    rows = [(0, 0, "a", "participant"), (0, 1, "b", "recording_proxy")]
    df = spark.createDataFrame(rows, "repeat int, fold int, g string, p string")
    status = {r["fold"]: r["status"] for r in sp.disjointness_evidence(df, group="g", provenance="p", min_test_groups=1).collect()}
    assert status[0] == "PASS" and status[1].startswith("REFUSED")


def test_one_class_training_side_is_reported(spark):
    rows = [(0, 0, 1), (0, 0, 1), (0, 1, 0)]
    r = sp.fold_report(spark.createDataFrame(rows, "repeat int, fold int, y int"), label="y").orderBy("fold").collect()
    assert [x["usable"] for x in r] == [False, False]


def test_overlap_keeps_the_training_size(units):
    s = sp.controlled_overlap(units, group="g", unit="u", seed=1)
    per = s.where("side = 'train'").groupBy("rho").count().toPandas()
    assert per["count"].nunique() == 1
    shared = (
        s.where("side <> 'dropped'").groupBy("rho", "g").agg(F.count_distinct("side").alias("k")).where("k = 2").groupBy("rho").count().toPandas()
    )
    assert 0.0 not in set(shared.rho) and 1.0 in set(shared.rho)


def test_shuffled_labels_are_a_permutation(units):
    g = units.groupBy("g").agg(F.min("y").alias("y"))
    moved = sp.shuffle_group_labels(g, group="g", label="y", seed=4).join(g, "g").toPandas()
    assert len(moved) == g.count() and moved.y.sum() == moved.y_shuffled.sum() and (moved.y != moved.y_shuffled).any()


def test_matching_is_one_to_one_within_caliper_and_maximal_per_cell(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "y": rng.integers(0, 2, n), "age": rng.integers(20, 60, n), "sex": rng.choice(["F", "M"], n)})
    p = ds.caliper_match(spark.createDataFrame(pdf), group="id", label="y", age="age", exact="sex", tol=3).toPandas()
    info = pdf.set_index("id")
    assert p.control.is_unique and p.case.is_unique
    assert (info.loc[p.control, "y"] == 0).all() and (info.loc[p.case, "y"] == 1).all()
    assert (info.loc[p.control, "sex"].to_numpy() == info.loc[p.case, "sex"].to_numpy()).all()
    assert (p.age_case - p.age_control).abs().max() <= 3
    # no unmatched pair is left inside the caliper
    left = pdf[~pdf.id.isin([*p.control, *p.case])]
    rest = left[left.y == 0].merge(left[left.y == 1], on="sex")
    assert not ((rest.age_x - rest.age_y).abs() <= 3).any()


def matched(spark, pdf, tol):
    p = ds.caliper_match(spark.createDataFrame(pdf), group="id", label="y", age="age", exact="sex", tol=tol).toPandas()
    info = pdf.set_index("id")
    used = [*p.control, *p.case]
    assert len(set(used)) == len(used)
    assert (info.loc[p.control, "y"] == 0).all() and (info.loc[p.case, "y"] == 1).all()
    assert (info.loc[p.control, "sex"].to_numpy() == info.loc[p.case, "sex"].to_numpy()).all()
    gap = (info.loc[p.case, "age"].to_numpy() - info.loc[p.control, "age"].to_numpy()).astype(float)
    assert (abs(gap) <= tol).all()
    left = pdf[~pdf.id.isin(used)]
    rest = left[left.y == 0].merge(left[left.y == 1], on="sex")
    assert not ((rest.age_x - rest.age_y).abs() <= tol).any(), "a pair that could be made is left"
    return p


@pytest.mark.parametrize("cases", [0.5, 0.15])
def test_fractional_ages_leave_no_pair_that_could_be_made(spark, cases):
    rng = np.random.default_rng(4)
    n = 300
    pdf = pd.DataFrame({"id": range(n), "y": (rng.random(n) < cases).astype(int), "age": rng.random(n) * 40 + 20, "sex": rng.choice(["F", "M"], n)})
    assert len(matched(spark, pdf, 2)) > 0.7 * min(pdf.y.sum(), (1 - pdf.y).sum())


def test_equal_fractional_ages_a_caliper_apart_match_at_once(spark):
    """All controls propose to one age: counts are matched, not one pair a round."""
    n = 400
    pdf = pd.DataFrame({"id": range(n), "y": [i % 2 for i in range(n)], "age": [30.5 + 2.0 * (i % 2) for i in range(n)], "sex": "F"})
    assert len(matched(spark, pdf, 2)) == n // 2
    pdf.loc[0, "age"] = 90.25
    assert len(matched(spark, pdf, 2)) == n // 2 - 1
    assert len(matched(spark, pdf[pdf.y == 1], 2)) == 0


def test_lookback_sees_only_earlier_rows(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"u": range(n), "k": np.where(np.arange(n) % 3 == 0, 0, 1), "v": rng.random(n)})
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5 * 86_400, n), unit="s")
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = au.lookback_mean(df, key="k", ts="ts", value="v", unit="u", seconds=86_400).toPandas().set_index("u").expected
    for r in pdf.itertuples():
        w = pdf[(pdf.k == r.k) & (pdf.ts < r.ts) & (pdf.ts >= r.ts - pd.Timedelta(days=1))]
        assert np.isnan(got[r.u]) if w.empty else got[r.u] == pytest.approx(w.v.mean())


def test_lookback_of_one_hot_key_is_exact_and_spreads(spark):
    """One user with nearly all events, equal times and holes; no task of the prefix windows sees the whole key."""
    rng = np.random.default_rng(6)
    n = 4000
    pdf = pd.DataFrame({"u": range(n), "k": np.where(np.arange(n) < 3900, "hot", "cold"), "v": rng.random(n) * 1e6})
    pdf["sec"] = rng.integers(0, 3000, n)
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.sec, unit="s")
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = au.lookback_mean(df, key="k", ts="ts", value="v", unit="u", seconds=60)
    got = out.toPandas().set_index("u").expected
    assert len(got) == n
    for k, own in pdf.groupby("k"):
        own = own.sort_values("sec")
        good = own[own.v.notna()]
        total = np.concatenate([[0.0], np.cumsum(good.v)])
        hi, lo = (np.searchsorted(good.sec, own.sec - back, side="left") for back in (0, 60))
        for u, a, b in zip(own.u, lo, hi):
            assert np.isnan(got[u]) if a == b else got[u] == pytest.approx(good.v.to_numpy()[a:b].mean(), rel=1e-12)


def test_split_tables_of_their_own(spark):
    a = spark.createDataFrame([(1, 0.5, "x")], "i int, v double, z string")
    b = spark.createDataFrame([(1, 0.5)], "i int, v double")
    ok = au.split_schemas({"train": b, "val": b}, train="train", features=["i", "v"]).first()
    assert ok["status"] == "PASS"
    bad = au.split_schemas({"train": b, "val": a}, train="train", features=["i", "v", "w"]).first()
    assert (bad["n_violations"], bad["example"]) == (2, "extra:val:z")
    with pytest.raises(ValueError, match="no split"):
        au.split_schemas({"val": a}, train="train", features=["i"])


def test_stale_and_changed_splits_are_refused(units):
    s = units.withColumn("split", F.when(F.col("g") % 5 == 0, "test").otherwise("train"))
    fp = au.reproducibility(s, unit="u", split="split", features=["a"]).first()
    again = au.reproducibility(s.repartition(17), unit="u", split="split", features=["a"], expected=fp["fingerprint"]).first()
    assert fp["status"] == again["status"] == "PASS"
    assert au.reproducibility(s, unit="u", split="split", features=["a"], age_hours=25).first()["status"] == "REFUSED: stale"
    fewer = au.reproducibility(s.where("u > 0"), unit="u", split="split", features=["a"], expected=fp["fingerprint"]).first()
    assert fewer["status"] == "REFUSED: changed"


def test_contract_reports_a_schema_change(units):
    ev = units.withColumn("y", F.col("y").cast("string"))
    rows = {r["check"]: r["status"] for r in au.loader_contract(units, ev, unit="u", target="y", features=["g"]).collect()}
    assert rows["schema_equal"] == "FAIL" and rows["index_pair"] == "PASS"
