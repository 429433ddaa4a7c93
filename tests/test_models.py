"""Batched models against pyspark.ml, gates and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from groupaudit.operators import foldblocks as fb
from groupaudit.operators import heads as hd
from groupaudit.operators.battery import MEMBERS, confound_battery, strongest
from groupaudit.operators import metrics as m
from groupaudit.operators import models as mod
from groupaudit.operators import splits as sp
from groupaudit.operators import subspace as sub
from groupaudit.operators.scaling import fold_statistics
from groupaudit.plans import studies as st
from groupaudit.session import materialise

KEYS = dict(unit="u", group="g")


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(6)
    n, d = 300, 5
    g = rng.integers(0, 40, n)
    y = g % 2
    x = rng.standard_normal((n, d)) + 1.6 * y[:, None] * np.array([1, 0, 0, 0, 0]) + rng.standard_normal((40, d))[g] * 0.5
    pdf = pd.DataFrame({"u": range(n), "g": g.astype(str), "y": y.astype(np.int32), "x": x.tolist()})
    return materialise(spark.createDataFrame(pdf).repartition(4))


@pytest.fixture(scope="module")
def oof(units):
    folds = sp.stratified_folds(units, group="g", label="y", n_folds=4, repeats=2)
    return mod.out_of_fold(units, folds, views=[mod.View("a"), mod.View("b", (0, 1))], n_folds=4, repeats=2, **KEYS)


@pytest.mark.parametrize("repeated", [0, 1, 1 << 40])
def test_counts_of_equal_rows_give_the_scores_of_all_rows(units, monkeypatch, repeated):
    few = F.transform("x", lambda v, i: F.when((i == 1) & (v > 1), float("nan")).when(i < 2, F.round(v)).otherwise(v))
    u = materialise(units.withColumn("x", few))
    folds = sp.stratified_folds(u, group="g", label="y", n_folds=4, repeats=2)
    views = [mod.View("a", (0,)), mod.View("b", (0, 1)), mod.View("c", (1, 3))]
    monkeypatch.setattr(mod, "REPEATED", repeated)
    calls = []
    whole = mod._collapsed
    monkeypatch.setattr(mod, "_collapsed", lambda data, few, **k: calls.append([v.name for v in few]) or whole(data, few, **k))
    got = mod.out_of_fold_counts(u, folds, group="g", views=views, n_folds=4, repeats=2)
    assert calls == {0: [["a", "b", "c"]], 1: [["a", "b"]], 1 << 40: []}[repeated]
    want = mod.out_of_fold(u, folds, views=views, n_folds=4, repeats=2, **KEYS)
    tally = lambda df, n: df.groupBy("head", "repeat", "y", F.round("p", 8).alias("p")).agg(F.sum(n).alias("n"))
    a, b = ({tuple(r) for r in tally(df, n).collect()} for df, n in ((got, F.col("n")), (want, F.lit(1))))
    assert a == b and sum(r[-1] for r in a) == 3 * 2 * u.count()


@pytest.mark.parametrize("repeated", [0, 1, 1 << 40])
def test_auc_on_blocks_is_that_of_all_scored_rows(units, monkeypatch, repeated):
    tied = F.transform("x", lambda v, i: F.when((i == 1) & (v > 1), float("nan")).when(i < 3, F.round(v, 1)).otherwise(v))
    u = materialise(units.withColumn("x", tied))
    folds = sp.stratified_folds(u, group="g", label="y", n_folds=4, repeats=2)
    basis = np.eye(5)[:, :1]
    views = [mod.View("a", (0,)), mod.View("b", (1, 4)), mod.View("c", (1, 2, 3)), mod.View("d", (2,)), mod.View("e", None, basis)]
    monkeypatch.setattr(mod, "REPEATED", repeated)
    monkeypatch.setattr(fb, "BUCKET_SCORES", 20)
    monkeypatch.setattr(fb, "HELD", 1)
    got = mod.out_of_fold_auc(u, folds, group="g", views=views, n_folds=4, repeats=2)
    want = m.roc_auc(mod.out_of_fold(u, folds, views=views, n_folds=4, repeats=2, **KEYS), score="p", label="y", by=["head", "repeat"])
    a, b = ({(r["head"], r["repeat"]): (r["n_pos"], r["n_neg"], r["auc"]) for r in df.collect()} for df in (got, want))
    assert len(a) == 10 and a.keys() == b.keys()
    assert all(a[k][:2] == b[k][:2] and a[k][2] == pytest.approx(b[k][2], abs=1e-9) for k in a)


def test_blocks_fit_the_models_of_rows_and_groups_without_a_fold_do_not_count(units):
    u = units.withColumn("x", F.transform("x", lambda v, i: F.when((i == 1) & (v > 1), float("nan")).otherwise(v * 1e3 + 1e6)))
    folds = sp.stratified_folds(u, group="g", label="y", n_folds=4, repeats=2)
    folds = folds.withColumn("fold", F.when((F.col("g") == "3") & (F.col("repeat") == 1), -1).otherwise(F.col("fold")))
    data = materialise(mod.attach_codes(u, folds, group="g").select("x", "y", "codes"))
    views = [mod.View("a", (0,)), mod.View("b", (4, 1))]
    probes = fb.Probes(fb.Blocks(data, views, n_folds=4, repeats=2, n=data.count()))
    assert probes.blocks.df.count() < data.count() / 10  # a scan reads matrices, not rows
    for got, want in zip(probes.fits, mod.fit_linear(data, mod.specs(views, 2, 4)), strict=True):
        assert (got.spec, got.n_train, got.n_imputed) == (want.spec, want.n_train, want.n_imputed)
        for a, b in ((got.mean, want.mean), (got.scale, want.scale), (got.beta, want.beta)):
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    auc = {(r["head"], r["repeat"]): r["n_pos"] + r["n_neg"] for r in probes.auc().collect()}
    absent = u.where("g = '3'").count()
    assert absent and auc == {(h, r): u.count() - r * absent for h in "ab" for r in (0, 1)}


def test_one_frequent_score_and_one_class_on_blocks(spark, units):
    u = units.withColumn("x", F.transform("x", lambda v, i: F.when(F.col("u") % 3 > 0, 0.0).otherwise(v)))
    folds = sp.stratified_folds(u, group="g", label="y", n_folds=4, repeats=1)
    data = materialise(mod.attach_codes(u, folds, group="g").select("x", "y", "codes"))
    probes = fb.Probes(fb.Blocks(data, [mod.View("a", (0,))], n_folds=4, repeats=1, n=300))
    want = m.roc_auc(mod.predict_counts(data, probes.fits, repeats=1), score="p", label="y", by=["head"]).first()
    got = probes.auc().first()
    assert (got["n_pos"], got["n_neg"]) == (want["n_pos"], want["n_neg"]) and got["auc"] == pytest.approx(want["auc"], abs=1e-12)
    with pytest.raises(ValueError, match="one training class"):
        fb.Probes(fb.Blocks(data.withColumn("y", F.lit(1)), [mod.View("a", (0,))], n_folds=4, repeats=1, n=300))


def test_every_unit_is_predicted_once_per_repeat_and_head(units, oof):
    per = oof.groupBy("head", "repeat", "unit_id").count()
    assert per.count() == 4 * units.count() and per.where("count <> 1").isEmpty()


def test_batched_newton_equals_pyspark_logistic_regression(units):
    data = materialise(units.withColumn("codes", F.array(F.when(F.col("g").cast("int") < 10, 0).otherwise(1))))
    fit = mod.fit_linear(data, [mod.Spec(mod.View("a"), 0, 0)])[0]
    tr = data.where("codes[0] = 1")
    n = tr.count()
    scaled = np.array(tr.select("x").toPandas().x.tolist())
    assert fit.mean == pytest.approx(scaled.mean(0)) and fit.scale == pytest.approx(scaled.std(0))
    cols = F.array(*[(F.get("x", F.lit(i)) - float(fit.mean[i])) / float(fit.scale[i]) for i in range(5)])
    lr = LogisticRegression(maxIter=500, tol=1e-12, regParam=1 / n, standardization=False, labelCol="y")
    ref = lr.fit(tr.select("y", array_to_vector(cols).alias("features")))
    assert fit.beta == pytest.approx([ref.intercept, *ref.coefficients], abs=1e-5)
    assert fit.iterations < 15


def test_missing_values_are_imputed_from_training_rows_only(spark):
    rows = [(0, "a", 0, [1.0], [1]), (1, "b", 1, [3.0], [1]), (2, "c", 1, [float("nan")], [1]), (3, "d", 0, [100.0], [0])]
    df = materialise(spark.createDataFrame(rows, "u int, g string, y int, x array<double>, codes array<int>"))
    mean, scale, n, imputed = mod.train_statistics(df, [mod.Spec(mod.View("a"), 0, 0)])[0]
    assert mean[0] == 2.0 and n == 3 and imputed == 1 and scale[0] == pytest.approx(np.std([1, 3, 2]))


def test_one_class_training_side_raises(spark):
    rows = [(0, "a", 1, [1.0], [1]), (1, "b", 1, [3.0], [1]), (2, "c", 0, [2.0], [0])]
    df = spark.createDataFrame(rows, "u int, g string, y int, x array<double>, codes array<int>")
    with pytest.raises(ValueError, match="one training class"):
        mod.fit_linear(df, [mod.Spec(mod.View("a"), 0, 0)])


def test_unknown_confound_set_is_an_error():
    with pytest.raises(ValueError, match="unknown confound set"):
        mod.confound_views(["age_only", "shoe_size"])
    with pytest.raises(ValueError, match="unknown head"):
        hd.make_head("forest", 3, 10, 0)


def test_svm_platt_predicts_each_unit_and_ranks_like_the_signal(units):
    folds = sp.stratified_folds(units, group="g", label="y", n_folds=4)
    inner = sp.inner_folds(folds, group="g", outer=4)
    p = materialise(mod.svm_platt(units, inner, n_outer=4, n_inner=3, **KEYS))
    assert p.count() == units.count() and p.where("p <= 0 OR p >= 1").isEmpty()
    assert m.roc_auc(p, score="p", label="y").first()["auc"] > 0.6


def test_monotone_calibration_keeps_auc(oof):
    p = oof.where("head = 'a' AND repeat = 0")
    q = p.withColumn("p", 1 / (1 + F.exp(-(0.3 + 2.5 * F.log(F.col("p") / (1 - F.col("p")))))))
    a, b = (m.roc_auc(t, score="p", label="y").first()["auc"] for t in (p, q))
    assert a == pytest.approx(b, abs=1e-12)


def test_shuffled_labels_fall_to_chance(units):
    r = st.shuffle_test(units, repeats=4, n_folds=4, **KEYS).first()
    assert r["real_score"] > 0.65 and abs(r["shuffled_mean"] - 0.5) < 0.2 < r["real_score"] - 0.4


def test_projection_is_idempotent_and_removes_the_basis(units):
    cov = sub.scatter(units.withColumn("k", F.lit(True)), keep=["k"])[0][2]
    basis, spectrum = sub.top_directions(cov, 2)
    assert basis.T @ basis == pytest.approx(np.eye(2), abs=1e-10) and (np.diff(spectrum) <= 1e-12).all()
    x0 = np.array(units.orderBy("u").toPandas().x.tolist())
    assert cov == pytest.approx(np.cov(x0.T, bias=True), abs=1e-9)
    once = sub.project_out(units, basis)
    x1, x2 = (np.array(t.orderBy("u").toPandas().x.tolist()) for t in (once, sub.project_out(once, basis)))
    assert x1 == pytest.approx(x2, abs=1e-12) and np.abs(x1 @ basis).max() < 1e-12


def test_variance_match_stops_at_the_closest_member():
    cov = np.diag([5.0, 4.0, 3.0, 2.0, 1.0])
    basis, share = sub.variance_matched(cov, 2, target=7 / 15)
    assert share == pytest.approx(7 / 15) and np.abs(basis[:, 1]).argmax() == 3
    _, top = sub.variance_matched(cov, 2, target=0.99)
    assert top == pytest.approx(9 / 15)


def test_class_direction_removal_collapses_auc(units):
    means = materialise(sub.group_means(units, group="g", extra=["y"]))
    w = sub.within_class_subspace(means, 1)
    views = [mod.View("full"), mod.View("removed", basis=w.direction.reshape(-1, 1))]
    auc = {r["head"]: r["auc"] for r in st.grouped_auc(units, views=views, repeats=1, n_folds=4, **KEYS).collect()}
    assert auc["full"] > auc["removed"] + 0.15
    x = means.toPandas()
    mu = {c: np.average(np.array(p.x.tolist()), axis=0, weights=p.n) for c, p in x.groupby("y")}
    diff = mu[1] - mu[0]
    assert w.direction == pytest.approx(diff / np.linalg.norm(diff))


def test_haar_basis_is_orthonormal_and_seeded():
    b = sub.haar_basis(9, 3, 1)
    assert b.T @ b == pytest.approx(np.eye(3), abs=1e-12) and (b == sub.haar_basis(9, 3, 1)).all()


def test_direction_stability_bounds(units):
    means = materialise(sub.group_means(units, group="g", extra=["y"]))
    cos = sub.direction_stability(means, group="g", n_boot=50)
    assert len(cos) == 50 and (np.abs(cos) <= 1 + 1e-12).all() and cos.mean() > 0.5


def test_residuals_are_uncorrelated_with_covariates_on_train(units):
    d = units.withColumn("z", F.array(F.get("x", F.lit(1)), F.col("u").cast("double"))).withColumn("t", F.col("u") % 4 != 0)
    out = mod.residualise(d, covariates="z", train="t").where("t").toPandas()
    x, z = np.array(out.x.tolist()), np.array(out.z.tolist())
    assert np.abs((x - x.mean(0)).T @ (z - z.mean(0))).max() < 1e-6 * len(x)


def test_overlap_raises_auc_when_identity_is_the_only_signal(spark):
    rng = np.random.default_rng(8)
    g = np.repeat(np.arange(60), 10)
    who = rng.standard_normal((60, 30)) * 3
    pdf = pd.DataFrame({"u": range(600), "g": g.astype(str), "y": (rng.integers(0, 2, 60)[g]).astype(np.int32)})
    pdf["x"] = (who[g] + rng.standard_normal((600, 30))).tolist()
    r = {x["rho"]: x for x in st.overlap_sweep(spark.createDataFrame(pdf), rhos=[0.0, 1.0], seed=1, **KEYS).collect()}
    assert r[0.0]["n_train_rows"] == r[1.0]["n_train_rows"] and r[1.0]["auc"] > r[0.0]["auc"] + 0.15


def test_a_large_offset_costs_no_digits(spark):
    rng = np.random.default_rng(2)
    x = 1.7e9 + rng.standard_normal(200)
    rows = [(i, str(i % 10), i % 2, [float(v)], [i % 4]) for i, v in enumerate(x)]
    df = materialise(spark.createDataFrame(rows, "u int, g string, y int, x array<double>, codes array<int>").repartition(3))
    mean, scale, _, _ = mod.train_statistics(df, [mod.Spec(mod.View("a"), 0, 0)])[0]
    train = x[np.arange(200) % 4 != 0]
    assert mean[0] == pytest.approx(train.mean(), rel=1e-14) and scale[0] == pytest.approx(train.std(), rel=1e-5)
    long = spark.createDataFrame([(0, i % 4, float(v)) for i, v in enumerate(x)], "repeat int, fold int, v double")
    got = {r["fold"]: r for r in fold_statistics(long, features=["v"]).collect()}
    for k in range(4):
        own = x[np.arange(200) % 4 != k]
        assert got[k]["mean"] == pytest.approx(own.mean(), rel=1e-14) and got[k]["std"] == pytest.approx(own.std(), rel=1e-5)


def test_a_model_that_does_not_converge_is_an_error(units):
    data = materialise(units.withColumn("codes", F.array(F.when(F.col("g").cast("int") < 10, 0).otherwise(1))))
    with pytest.raises(RuntimeError, match="not converged"):
        mod.fit_linear(data, [mod.Spec(mod.View("a"), 0, 0)], max_iter=2)


def test_a_killed_study_goes_on_with_what_is_missing(units, tmp_path, monkeypatch):
    study = dict(ranks=[1, 2], repeats=3, n_folds=3, n_way=5, min_units=4, **KEYS)
    key = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    fresh = key(st.subspace_ablation(units, state=f"{tmp_path}/fresh", together=3, **study).collect())
    whole, asked = st._ablation_repeats, []

    def dies(df, *, wanted, **k):
        asked.extend(wanted)
        if wanted == [1] and asked.count(1) == 1:
            raise KeyboardInterrupt
        return whole(df, wanted=wanted, **k)

    monkeypatch.setattr(st, "_ablation_repeats", dies)
    with pytest.raises(KeyboardInterrupt):
        st.subspace_ablation(units, state=f"{tmp_path}/killed", **study)
    assert key(st.subspace_ablation(units, state=f"{tmp_path}/killed", **study).collect()) == fresh
    assert asked == [0, 1, 1, 2]
    other = units.withColumn("y", 1 - F.col("y"))  # other data do not resume these
    st.subspace_ablation(other, state=f"{tmp_path}/killed", **study | {"repeats": 1})
    assert asked == [0, 1, 1, 2, 0]


def test_identity_probe_finds_voices_and_chance(spark):
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(12), 16)
    x = rng.standard_normal((12, 6))[g] * 3 + rng.standard_normal((192, 6))
    df = spark.createDataFrame(pd.DataFrame({"u": range(192), "g": g.astype(str), "x": x.tolist()}))
    acc, chance = sub.identity_probe(df, unit="u", group="g", n_way=8, min_units=12)
    assert chance == 1 / 8 and acc > 0.8
    gone, _ = sub.identity_probe(sub.project_out(df, np.eye(6)), unit="u", group="g", n_way=8, min_units=12)
    assert gone < 0.35
    with pytest.raises(ValueError, match="fewer than two"):
        sub.identity_probe(df, unit="u", group="g", min_units=17)


def test_battery_has_nine_rows_whatever_the_table_holds(units):
    folds = materialise(sp.stratified_folds(units, group="g", label="y", n_folds=4))
    args = dict(unit="u", group="g", label="y", n_folds=4, repeats=1)
    nothing = {r["member"]: r for r in confound_battery(units, folds, {"age": "birth"}, **args).collect()}
    assert sorted(nothing) == sorted(MEMBERS) and all(r["n_repeats"] == 0 and r["auc_mean"] is None for r in nothing.values())
    assert nothing["age_sex_only"]["status"] == "NOT_APPLICABLE(column birth is absent; no column for sex)"
    table = units.withColumn("age", F.get("x", F.lit(0))).withColumn("sex", F.when(F.col("u") % 3 == 0, "M").when(F.col("u") % 3 == 1, "f"))
    table = table.withColumn("dev", F.lit("one")).withColumn("sil", F.slice("x", 2, 3)).withColumn("db", F.lit(float("nan")))
    got = {r["member"]: r for r in confound_battery(table, folds, {"age": "age", "sex": "sex", "site": "dev", "silence": "sil", "snr": "db"}, **args).collect()}
    assert {n for n, r in got.items() if r["status"] == "OK"} == {"age_only", "age_sex_only", "sex_only", "silence_only"}
    assert got["device_or_site_only"]["status"] == "NOT_APPLICABLE(column dev has one value)"
    assert got["snr_only"]["status"] == "NOT_APPLICABLE(column db holds no value)" and got["silence_only"]["n_features"] == 3
    assert got["age_only"]["auc_mean"] > 0.8 > got["sex_only"]["auc_mean"]
    assert strongest(confound_battery(table, folds, {"age": "age", "sex": "sex"}, **args)).first()["member"] in ("age_only", "age_sex_only")
    with pytest.raises(ValueError, match="unknown battery input"):
        confound_battery(table, folds, {"shoe": "u"}, **args)


def test_matched_outcome_pairs_seeds_and_checks_the_matching(spark):
    rows = [(s, arm, auc + 0.01 * s, 40, 0.5, "RUN") for s in range(4) for arm, auc in (("age_only", 0.5), ("wide", 0.8), ("narrow", 0.7))]
    rows += [(s, "short", None, 40, 0.5, "SKIPPED: rows without a partner") for s in range(4)]
    runs = spark.createDataFrame(rows, "seed int, arm string, auc double, n_pairs long, age_gap double, status string")
    got = {(r["a"], r["b"]): r for r in st.matched_outcome(runs, contrasts=[("wide", "narrow"), ("narrow", "wide"), ("wide", "short")]).collect()}
    up, down, none = got["wide", "narrow"], got["narrow", "wide"], got["wide", "short"]
    assert up["a_wins"] and not down["a_wins"] and up["delta"] == pytest.approx(0.1) and up["n_seeds"] == 4 and up["matching_worked"]
    assert up["mean_auc_age_only"] == pytest.approx(0.515) and up["mean_pairs"] == 40
    assert none["a_wins"] is None and none["n_seeds"] == 0 and none["status"].startswith("SKIPPED")
    aged = runs.withColumn("auc", F.when(F.col("arm") == "age_only", 0.7).otherwise(F.col("auc")))
    assert not st.matched_outcome(aged, contrasts=[("wide", "narrow")]).first()["matching_worked"]
