"""Queries that fit models: every one runs over its whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from groupaudit.operators import heads as hd
from groupaudit.operators import metrics as m
from groupaudit.operators import models as mod
from groupaudit.operators.battery import confound_battery, strongest
from groupaudit.operators import inference as inf
from groupaudit.operators.wide import fit_wide
from groupaudit.operators import scaling as sc
from groupaudit.operators import splits as sp
from groupaudit.operators import subspace as sub
from groupaudit.plans import fixtures as fx
from groupaudit.plans import studies as st
from groupaudit.plans.q_metrics import auc_sql, r
from groupaudit.plans.q_splits import FOLDS, folds
from groupaudit.plans.registry import query
from groupaudit.session import materialise

_ASSIGNED = f"""{FOLDS}, a AS (SELECT repeat, fold, session_id, s.y, CASE WHEN speaker_id % 9 = 0 THEN NULL ELSE CAST(s.age AS DOUBLE) END AS age, duration
   FROM sessions s JOIN folds USING (speaker_id))"""


def assigned(spark, d):
    """Sessions with their folds and a partly missing age."""
    s = fx.sessions(spark, d).withColumn("age", F.when(F.col("speaker_id") % 9 != 0, F.col("age").cast("double")))
    return s.join(folds(spark, d).select("repeat", "fold", "speaker_id"), "speaker_id")


@query(
    "p10_confound_matrix",
    f"""WITH {_ASSIGNED}, t AS (SELECT repeat, sum(age) AS ts, count(age) AS tn FROM a GROUP BY 1), f AS (SELECT repeat, fold, sum(age) AS s, count(age) AS n FROM a GROUP BY ALL),
      mu AS (SELECT repeat, fold, (ts - s) / (tn - n) AS mean FROM f JOIN t USING (repeat))
    SELECT repeat, fold, session_id, y, round(coalesce(age, mean), 6) AS age_imputed, age IS NULL AS was_imputed FROM a JOIN mu USING (repeat, fold)""",
)
def p10(spark, d):
    out = sc.impute_from_train(assigned(spark, d), column="age")
    return out.select("repeat", "fold", "session_id", "y", r("age_imputed"), "was_imputed")


@query(
    "p11_fold_scaling",
    f"""WITH {_ASSIGNED}, l AS (SELECT repeat, fold, 'age' AS feature, age AS v FROM a UNION ALL SELECT repeat, fold, 'duration', duration FROM a),
      k AS (SELECT DISTINCT repeat, fold FROM a)
    SELECT 'train' AS scope, k.repeat, k.fold, feature, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM k JOIN l ON l.repeat = k.repeat AND l.fold <> k.fold GROUP BY ALL
    UNION ALL SELECT 'all', k.repeat, k.fold, feature, count(v), round(avg(v), 4), round(stddev_pop(v), 4) FROM k JOIN l ON l.repeat = k.repeat GROUP BY ALL""",
)
def p11(spark, d):
    a = assigned(spark, d)
    parts = [
        sc.fold_statistics(a, features=["age", "duration"], scope=s).select(
            F.lit(s).alias("scope"), "repeat", "fold", "feature", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")
        )
        for s in ("train", "all")
    ]
    return parts[0].unionByName(parts[1])


# --- confounds -------------------------------------------------------------------------


def confound_units(spark, d):
    s = fx.sessions(spark, d)
    s = s.withColumn("age", F.when(F.col("speaker_id") % 9 != 0, F.col("age"))).withColumn("rms", F.col("site") + 0.5)
    s = mod.confound_features(s, age="age", sex="sex", duration="duration", rms="rms")
    return s.select("session_id", "speaker_id", "y", "x", "age", "sex")


def old_age_units(spark, d, years=20):
    """Sessions whose label follows the age of the speaker, but for noise: what age probes must find, others not."""
    noise = F.crc32(F.col("speaker_id").cast("string")) % years
    s = fx.sessions(spark, d).withColumn("y", (F.col("age") + noise > 50 + years / 2).cast("int")).withColumn("rms", F.crc32(F.col("session_id").cast("string")) % 7)
    s = s.withColumn("age", F.when(F.col("speaker_id") % 9 != 0, F.col("age")))
    s = mod.confound_features(s, age="age", sex="sex", duration="duration", rms="rms")
    return materialise(s.select("session_id", "speaker_id", "y", "x", "age", "sex"))


@query(
    "m02_grouped_logistic",
    "SELECT CAST(repeat AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, TRUE AS age_raises, TRUE AS age_outweighs_sex, TRUE AS some_imputed, TRUE AS converged FROM (SELECT unnest(range(3)) AS repeat), (SELECT unnest(range(5)) AS fold)",
)
def m02b(spark, d):
    """All (repeat, fold) probes of one covariate set from shared Newton scans: their coefficients."""
    units = old_age_units(spark, d)
    data = materialise(mod.attach_codes(units.drop("age", "sex"), folds(spark, d), group="speaker_id"))
    fits = mod.fit_linear(data, mod.specs([mod.View("age_sex", (0, 1))], 3, 5))
    rows = [
        (f.spec.design, f.spec.fold, bool(f.beta[1] > 1), bool(abs(f.beta[1]) > 3 * abs(f.beta[2])), f.n_imputed > 0, f.kkt < 1e-7) for f in fits
    ]
    return spark.createDataFrame(rows, "repeat int, fold int, age_raises boolean, age_outweighs_sex boolean, some_imputed boolean, converged boolean")


def confound_oof(spark, d, names=tuple(mod.CONFOUND_SETS), repeats=3, years=20):
    units = old_age_units(spark, d, years).drop("age", "sex")
    f = sp.stratified_folds(units, group="speaker_id", label="y", repeats=repeats, seed=7)
    views = mod.confound_views(names)
    return mod.out_of_fold(units, f, unit="session_id", group="speaker_id", views=views, n_folds=5, repeats=repeats)


@query(
    "m06_confound_battery",
    """SELECT * FROM (VALUES ('confound::age_only', TRUE), ('confound::sex_only', FALSE), ('confound::age_sex', TRUE), ('confound::duration_only', FALSE),
      ('confound::intensity_rms_only', FALSE), ('confound::age_sex_duration_rms', TRUE)) AS t(head, found), (SELECT CAST(8 AS BIGINT) AS n_repeats)""",
)
def m06(spark, d):
    units = old_age_units(spark, d).drop("age", "sex")
    f = sp.stratified_folds(units, group="speaker_id", label="y", repeats=8, seed=7)
    auc = mod.out_of_fold_auc(units, f, group="speaker_id", views=mod.confound_views(), n_folds=5, repeats=8)
    return auc.groupBy("head").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_repeats")).select("head", found(), "n_repeats")


_BATTERY = """(VALUES ('age_only', 'OK', 1, TRUE), ('age_sex_only', 'OK', 2, TRUE), ('device_or_site_only', 'OK', 32, FALSE), ('duration_only', 'OK', 1, FALSE),
  ('intensity_rms_only', 'NOT_APPLICABLE(column rms is absent)', 0, NULL), ('metadata_only', 'OK', 34, TRUE), ('sex_only', 'OK', 1, FALSE),
  ('silence_only', 'NOT_APPLICABLE(column pauses holds no value)', 0, NULL), ('snr_only', 'NOT_APPLICABLE(column snr has one value)', 0, NULL)) AS t(member, status, n_features, found)"""


@query(
    "m06_pinned_battery",
    f"SELECT member, status, n_features, CASE WHEN status = 'OK' THEN 8 ELSE 0 END::BIGINT AS n_repeats, found, 'age' AS bar FROM {_BATTERY}",
)
def m06_pinned(spark, d):
    """An illness of the old is planted: probes that see the age find it, the others do not, three cannot run."""
    noise = F.crc32(F.col("speaker_id").cast("string")) % 40
    s = fx.sessions(spark, d).withColumn("y", (F.col("age") + noise > 70).cast("int"))
    s = s.withColumn("pauses", F.array().cast("array<double>")).withColumn("snr", F.lit(20.0))
    f = sp.stratified_folds(s, group="speaker_id", label="y", repeats=8, seed=7)
    names = {"age": "age", "sex": "sex", "site": "site", "duration": "duration", "rms": "rms", "silence": "pauses", "snr": "snr"}
    out = materialise(confound_battery(s, f, names, unit="session_id", group="speaker_id", label="y", n_folds=5, repeats=8))
    bar = F.regexp_extract(strongest(out).select("member").scalar(), "^(age|metadata)", 1)
    found = F.when(F.col("status") == "OK", F.col("auc_mean") > 0.8)
    return out.select("member", "status", "n_features", "n_repeats", found.alias("found"), F.regexp_replace(bar, "metadata", "age").alias("bar"))


_BASE = f"""{fx.SESSIONS}, b AS (SELECT *, CASE WHEN sex = 'F' THEN 1 ELSE 0 END AS female FROM sessions), per AS (SELECT speaker_id, count(*) AS n FROM b GROUP BY 1)"""


@query(
    "m08_metadata_baseline",
    f"""WITH {_BASE} SELECT count(*) AS n_sessions, CAST(sum(y) AS BIGINT) AS n_pathological, CAST(sum(1 - y) AS BIGINT) AS n_healthy,
      round(avg(age) FILTER (y = 0), 6) AS mean_age_healthy, round(avg(age) FILTER (y = 1), 6) AS mean_age_pathological, (SELECT count(*) FROM per) AS n_speakers,
      (SELECT count(*) FILTER (n > 1) FROM per) AS speakers_with_multiple_sessions, (SELECT max(n) FROM per) AS max_sessions_per_speaker,
      round((SELECT auc FROM ({auc_sql('b', 'age', 'y')})), 9) AS auc_age_only, round((SELECT auc FROM ({auc_sql('b', 'female', 'y')})), 9) AS auc_sex_only FROM b""",
)
def m08(spark, d):
    out = st.metadata_baseline(fx.sessions(spark, d), group="speaker_id", label="y", age="age", sex="sex")
    fixed = {c: r(c, 6) for c in ("mean_age_healthy", "mean_age_pathological")}
    return out.withColumns({**fixed, "auc_age_only": r("auc_age_only", 9), "auc_sex_only": r("auc_sex_only", 9)})


@query("m08_fitted_age_sex", "SELECT 'confound::age_sex' AS head, CAST(0 AS INTEGER) AS repeat, TRUE AS found")
def m08_fitted(spark, d):
    """Age and sex fitted under group folds, so the bar itself is not leakage-inflated."""
    units = old_age_units(spark, d).drop("age", "sex")
    auc = st.grouped_auc(units, unit="session_id", group="speaker_id", views=mod.confound_views(["age_sex"]), repeats=1, n_folds=5)
    return auc.select("head", "repeat", found())


# --- feature vectors ---------------------------------------------------------------------


def vectors(spark, d):
    return fx.features(spark, d).select("recording_id", "speaker_id", "y", "x")


KEYS = dict(unit="recording_id", group="speaker_id")


def planted_voices(spark, d, *, voice=3.0, illness=0.35):
    """Embeddings plus what the operators must find: a voice of each speaker in four columns, an illness in one."""
    return planted(vectors(spark, d), voice, illness)


def planted(u, voice, illness):
    sung = lambda j: voice * F.sin(F.crc32(F.concat_ws("|", "speaker_id", F.lit(j))).cast("double"))
    x = [F.get("x", F.lit(j)) + (sung(j) if j < 4 and voice else F.lit(0.0)) + (illness * F.col("y") if j == 10 else F.lit(0.0)) for j in range(64)]
    return u.withColumn("x", F.array(*x))


def ill(spark, d):
    return planted_voices(spark, d, voice=0.0)


CLASSES = """CAST((SELECT count(*) FILTER (label < 5) FROM embeddings) AS DOUBLE) AS n_pos, CAST((SELECT count(*) FILTER (label >= 5) FROM embeddings) AS DOUBLE) AS n_neg"""


def found(auc="auc", floor=0.75):
    return (F.col(auc) > floor).alias("found")


@query(
    "m01_out_of_fold",
    "SELECT 'logreg' AS head, CAST(repeat AS INTEGER) AS repeat, count(*) AS n_predictions, count(DISTINCT vec_id) AS n_units, TRUE AS found FROM embeddings, (SELECT unnest(range(2)) AS repeat) GROUP BY repeat",
)
def m01(spark, d):
    """Every unit is predicted once per repeat, and the planted illness is found."""
    u = ill(spark, d)
    f = sp.stratified_folds(u, group="speaker_id", label="y", n_folds=5, repeats=2)
    oof = mod.out_of_fold(u, f, views=[mod.View("logreg")], n_folds=5, repeats=2, fit=fit_wide, **KEYS)
    n = oof.groupBy("head", "repeat").agg(F.count("*").alias("n_predictions"), F.count_distinct("unit_id").alias("n_units"))
    return st.auc_per_repeat(oof).join(n, ["head", "repeat"]).select("head", "repeat", "n_predictions", "n_units", found())


@query(
    "m01_kkt_residuals",
    "SELECT CAST(repeat AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, TRUE AS optimal, TRUE AS illness_heaviest FROM (SELECT unnest(range(2)) AS repeat), (SELECT unnest(range(5)) AS fold)",
)
def m01_kkt(spark, d):
    """Optimality of every model of the wide solver, its gradient summed up again in plain columns."""
    u = ill(spark, d)
    f = materialise(sp.stratified_folds(u, group="speaker_id", label="y", n_folds=5, repeats=2))
    data = materialise(mod.attach_codes(u, f, group="speaker_id"))
    out = None
    for fit in fit_wide(data, mod.specs([mod.View("logreg")], 2, 5)):
        lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
        z = F.zip_with(F.zip_with("x", lit(fit.mean), lambda a, b: a - b), lit(fit.scale), lambda a, b: a / b)
        rows = data.where(F.get("codes", F.lit(fit.spec.design)) != fit.spec.fold).select("y", z.alias("z"))
        eta = F.aggregate(F.zip_with("z", lit(fit.beta[1:]), lambda a, b: a * b), F.lit(float(fit.beta[0])), lambda a, b: a + b)
        slope = 1 / (1 + F.exp(-eta)) - F.col("y")
        sums = [F.abs(F.sum(slope * F.get("z", F.lit(j))) + float(fit.beta[1 + j])) for j in range(64)] + [F.abs(F.sum(slope))]
        one = rows.select("y", "z").agg((F.greatest(*sums) / F.count("*") < 2e-7).alias("optimal"))
        heaviest = F.lit(int(abs(fit.beta[1:]).argmax()) == 10).alias("illness_heaviest")
        one = one.select(F.lit(fit.spec.design).alias("repeat"), F.lit(fit.spec.fold).alias("fold"), "optimal", heaviest)
        out = one if out is None else out.unionByName(one)
    return out


def _heads(spark, d, names, n_folds):
    u = ill(spark, d)
    f = sp.stratified_folds(u, group="speaker_id", label="y", n_folds=n_folds)
    return _head_auc(hd.heads_out_of_fold(u, f, heads=names, **KEYS))


def _head_auc(oof):
    return m.roc_auc(oof, score="p", label="y", by=["head"]).select("head", "n_pos", "n_neg", found())


@query("m02_logistic_head", f"SELECT 'logreg' AS head, {CLASSES}, TRUE AS found")
def m02(spark, d):
    return _heads(spark, d, ["logreg"], 3)


@query("m03_svm_platt", f"SELECT 'linsvm' AS head, {CLASSES}, TRUE AS found")
def m03(spark, d):
    u = ill(spark, d)
    f = sp.stratified_folds(u, group="speaker_id", label="y", n_folds=5)
    inner = sp.inner_folds(f, group="speaker_id", outer=5)
    return _head_auc(materialise(mod.svm_platt(u, inner, n_outer=5, n_inner=3, **KEYS)))


@query("m04_mlp_head", f"SELECT 'mlp' AS head, {CLASSES}, TRUE AS found")
def m04(spark, d):
    return _heads(spark, d, ["mlp"], 2)


@query("m05_gbt_head", f"SELECT 'gbt' AS head, {CLASSES}, TRUE AS found")
def m05(spark, d):
    return _heads(spark, d, ["gbt"], 2)


@query("m09_identity_probe", "SELECT CAST(25 AS INTEGER) AS n_ways, 0.04::DOUBLE AS chance, TRUE AS voices_told_apart, TRUE AS chance_without_voices")
def m09(spark, d):
    u = fx.features(spark, d).withColumn("speaker_id", (F.col("recording_id") % 25).cast("string")).select("recording_id", "speaker_id", "y", "x")
    parts = []
    for voice in (3.0, 0.0):
        half = sp.half_split(planted(u, voice, 0.0), group="speaker_id", unit="recording_id", min_units=6, n_groups=60)
        parts.append(hd.identity_probe(half, group="speaker_id"))
    heard, silent = parts[0], parts[1].select("accuracy").scalar()
    return heard.select("n_ways", "chance", (F.col("accuracy") > 4 * F.col("chance")).alias("voices_told_apart"), (silent < 4 * F.col("chance")).alias("chance_without_voices"))


@query(
    "m10_calibrators",
    "SELECT calibrator, TRUE AS keeps_auc, TRUE AS brier_no_worse FROM (SELECT unnest(['none', 'temperature', 'platt', 'beta', 'isotonic']) AS calibrator)",
)
def m10(spark, d):
    """Calibrators fitted on an inner training slice: ECE and Brier move, AUC does not."""
    u = ill(spark, d)
    f = sp.stratified_folds(u, group="speaker_id", label="y", n_folds=3)
    slices = mod.attach_codes(u, f, group="speaker_id")
    data = materialise(slices)
    # fold 2 is the test side, fold 1 the inner slice, fold 0 fits the score itself
    base = materialise(data.withColumn("codes", F.array(F.when(F.get("codes", F.lit(0)) == 0, 1).otherwise(0))))
    fit = mod.fit_linear(base, [mod.Spec(mod.View("raw"), 0, 0)])
    scored = mod.predict(base, fit, **KEYS).join(f.select(F.col("speaker_id").alias("group_id"), F.col("fold").alias("part")), "group_id")
    scored = materialise(scored.select("unit_id", "group_id", "y", "p", "part"))
    out = scored.where("part = 2").select(F.lit("none").alias("calibrator"), "unit_id", "y", "p")
    for name, cols in hd.calibration_features().items():
        t = scored.select("unit_id", "group_id", "y", F.array(*cols).alias("x"), F.array(F.when(F.col("part") == 2, 0).otherwise(1)).alias("codes"))
        cal = mod.fit_linear(materialise(t), [mod.Spec(mod.View(name), 0, 0)], l2=1e-6, scale=False, intercept=name != "temperature")
        p = mod.predict(t, cal, unit="unit_id", group="group_id")
        out = out.unionByName(p.select(F.lit(name).alias("calibrator"), "unit_id", "y", "p"))
    iso = hd.isotonic(scored.where("part = 1"), scored.where("part = 2"))
    out = out.unionByName(iso.select(F.lit("isotonic").alias("calibrator"), "unit_id", "y", F.col("p_cal").alias("p")))
    out = materialise(out)
    by = ["calibrator"]
    res = m.roc_auc(out, score="p", label="y", by=by).select("calibrator", r("auc"))
    res = res.join(m.ece_equal_width(out, score="p", label="y", by=by).select("calibrator", r("ece")), by)
    res = materialise(res.join(m.brier_decomposition(out, score="p", label="y", by=by).select("calibrator", "brier"), by))
    plain = lambda c: res.where("calibrator = 'none'").select(c).scalar()
    # a step function ties scores, the others keep every order
    near = F.when(F.col("calibrator") == "isotonic", 0.05).otherwise(1e-6)
    return res.select("calibrator", (F.abs(F.col("auc") - plain("auc")) <= near).alias("keeps_auc"), (F.col("brier") <= plain("brier") + 0.02).alias("brier_no_worse"))


@query("m11_residualisation", "SELECT TRUE AS has_rows, TRUE AS gone_0, TRUE AS gone_1, TRUE AS gone_2, TRUE AS was_there")
def m11(spark, d):
    """Vectors with duration-like covariates regressed out on training rows: what correlation is left."""
    u = vectors(spark, d).withColumn("z", F.array((F.col("recording_id") % 60).cast("double"), F.get("x", F.lit(0)) + F.get("x", F.lit(1))))
    g = sp.holdout(u.select("speaker_id").distinct(), group="speaker_id", exact=True)
    u = u.join(g, "speaker_id")
    res = mod.residualise(u, covariates="z", train="is_train")
    z1 = F.get("z", F.lit(1))
    corr = lambda i: F.abs(F.corr(F.get("x", F.lit(i)), z1))
    before = u.where("is_train").agg((corr(0) > 0.3).alias("was_there")).scalar()
    left = res.where("is_train").agg((F.count("*") > 0).alias("has_rows"), *[(corr(i) < 1e-9).alias(f"gone_{i}") for i in (0, 1, 2)])
    return left.withColumn("was_there", before)


@query("m12_inverse_propensity", "SELECT * FROM (VALUES ('none', TRUE), ('ipw', FALSE)) AS t(weighting, confounded)")
def m12(spark, d):
    """A score that is nothing but age: inverse class propensity on age takes its AUC away."""
    oof = confound_oof(spark, d, ["age_sex"], repeats=1, years=200)
    w = mod.propensity_weights(oof, floor=0.01).select(F.col("unit_id").cast("bigint").alias("session_id"), "y", "w")
    s = fx.sessions(spark, d).select("session_id", F.col("age").alias("s")).join(w, "session_id")
    parts = [
        m.roc_auc(s.withColumn("w", c), score="s", label="y", weight="w").select(F.lit(n).alias("weighting"), (F.col("auc") > 0.585).alias("confounded"))
        for n, c in (("none", F.lit(1.0)), ("ipw", F.col("w")))
    ]
    return parts[0].unionByName(parts[1])


_CORPORA = """c AS (SELECT CASE WHEN vec_id % 6 < 3 THEN 'A' ELSE 'B' END AS target, CAST(count(*) FILTER (label < 5) AS DOUBLE) AS n_pos, CAST(count(*) FILTER (label >= 5) AS DOUBLE) AS n_neg FROM embeddings GROUP BY 1)"""


@query("m13_cross_corpus_transfer", f"WITH {_CORPORA} SELECT head, target, n_pos, n_neg, TRUE AS found FROM c, (SELECT unnest(['within', 'across']) AS head)")
def m13(spark, d):
    """The planted illness is the same in both corpora, so it transfers."""
    u = planted_voices(spark, d, voice=0.0, illness=0.6).withColumn("corpus", F.when(F.col("recording_id") % 6 < 3, "A").otherwise("B"))
    return st.transfer(u, corpus="corpus", **KEYS).select("head", "target", "n_pos", "n_neg", found())


@query("m14_origin_probe", "SELECT * FROM (VALUES ('device', TRUE), ('nothing', FALSE)) AS t(trace, clears_floor)")
def m14(spark, d):
    """Predict where a recording came from instead of its label: with a planted trace of the device, and without."""
    out = None
    for trace, size in (("device", 0.4), ("nothing", 0.0)):
        u = vectors(spark, d).withColumn("y", (F.floor(F.col("recording_id") / 7) % 2).cast("int"))
        u = planted(u.withColumn("speaker_id", F.concat_ws("-", "speaker_id", "y")), 0.0, size)
        auc = st.grouped_auc(u, views=[mod.View("origin")], repeats=1, n_folds=5, **KEYS)
        row = auc.select(F.lit(trace).alias("trace"), *m.directionless("auc", 0.68)).select("trace", "clears_floor")
        out = row if out is None else out.unionByName(row)
    return out


CURVE = {"all64": None, "first8": tuple(range(8))}


@query(
    "m15_learning_curve",
    "SELECT view, CAST(n_train AS INTEGER) AS n_train, CASE WHEN view = 'all64' AND n_train >= 40 THEN TRUE END AS found, TRUE AS more_is_no_worse FROM (SELECT unnest(['all64', 'first8']) AS view), (SELECT unnest([10, 20, 40, 60]) AS n_train)",
)
def m15(spark, d):
    """The view that holds the planted illness finds it with enough groups, and more groups do not hurt."""
    sizes = [10, 20, 40, 60]
    curve = materialise(st.learning_curve(ill(spark, d), views=CURVE, sizes=sizes, n_folds=3, repeats=8, **KEYS))
    first = curve.where("view = 'all64' AND n_train = 10").select("auc").scalar()
    last = curve.where("view = 'all64' AND n_train = 60").select("auc").scalar()
    seen = F.when((F.col("view") == "all64") & (F.col("n_train") >= 40), F.col("auc") > 0.75)
    return curve.select("view", "n_train", seen.alias("found"), (last >= first - 0.02).alias("more_is_no_worse"))


@query(
    "m16_overlap_sweep",
    "SELECT rho::DOUBLE AS rho, TRUE AS same_size, CASE WHEN rho = 1 THEN TRUE END AS overlap_pays FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS rho)",
)
def m16(spark, d):
    """Labels that only a voice tells: known speakers in training raise the AUC, at one training size."""
    u = fx.mixed_features(spark, d).select("recording_id", "speaker_id", "x").withColumn("y", (F.crc32("speaker_id") % 2).cast("int"))
    out = materialise(st.overlap_sweep(planted(u, 3.0, 0.0), rhos=[0.0, 0.25, 0.5, 0.75, 1.0], **KEYS))
    none = out.where("rho = 0").select("auc").scalar()
    size = out.where("rho = 0").select("n_train_rows").scalar()
    return out.select("rho", (F.col("n_train_rows") == size).alias("same_size"), F.when(F.col("rho") == 1, F.col("auc") > none + 0.03).alias("overlap_pays"))


def _people_means(spark, d):
    u = vectors(spark, d)
    return u, materialise(sub.group_means(u, group="speaker_id", extra=["y"]))


@query(
    "m17_identity_subspace",
    "SELECT CAST(k AS INTEGER) AS k, k >= 4 AS holds_the_voices, TRUE AS share_rises FROM (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k)",
)
def m17(spark, d):
    """Variance share of the top-k identity subspace, train groups only."""
    u = planted_voices(spark, d)
    g = sp.holdout(u.select("speaker_id").distinct(), group="speaker_id", exact=True)
    rows = materialise(u.join(g, "speaker_id"))
    total = sub.scatter(rows, keep=["is_train"])[0][2]
    between = sub.scatter(sub.group_means(rows, group="speaker_id", extra=["is_train"]), keep=["is_train"])[0][2]
    basis, _ = sub.top_directions(between, 32)
    share = {k: sub.variance_share(basis[:, :k], total) for k in (1, 2, 4, 8, 16, 32)}
    rises = all(a <= b for a, b in zip(list(share.values()), list(share.values())[1:]))
    return spark.createDataFrame([(k, v > 0.85, rises) for k, v in share.items()], "k int, holds_the_voices boolean, share_rises boolean")


@query(
    "m18_variance_controls",
    "SELECT CAST(k AS INTEGER) AS k, TRUE AS topk_is_most, TRUE AS matched_is_closer, TRUE AS matched_at_most_topk FROM (SELECT unnest([1, 2, 4, 8, 16]) AS k)",
)
def m18(spark, d):
    u = vectors(spark, d).withColumn("all_rows", F.lit(True))
    total = sub.scatter(u, keep=["all_rows"])[0][2]
    between = sub.scatter(sub.group_means(u, group="speaker_id").withColumn("all_rows", F.lit(True)), keep=["all_rows"])[0][2]
    basis, _ = sub.top_directions(between, 16)
    _, spectrum = sub.top_directions(total, 1)
    out = []
    for k in (1, 2, 4, 8, 16):
        target = sub.variance_share(basis[:, :k], total)
        _, matched = sub.variance_matched(total, k, target)
        top = float(spectrum[:k].sum() / spectrum.sum())
        out.append((k, top >= target - 1e-12, abs(matched - target) <= abs(top - target) + 1e-12, matched <= top + 1e-12))
    return spark.createDataFrame(out, "k int, topk_is_most boolean, matched_is_closer boolean, matched_at_most_topk boolean")


@query("m19_project_out", "SELECT vec_id AS recording_id, TRUE AS gone, TRUE AS shorter, TRUE AS twice_is_once FROM embeddings")
def m19(spark, d):
    """Removing a subspace twice changes nothing, and nothing of it is left."""
    u = vectors(spark, d)
    cov = sub.scatter(u.withColumn("all_rows", F.lit(True)), keep=["all_rows"])[0][2]
    basis, _ = sub.top_directions(cov, 8)
    once = sub.project_out(u.withColumn("was", F.col("x")), basis)
    twice = sub.project_out(once.withColumn("once", F.col("x")), basis)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    along = [F.abs(dot("once", F.array(*[F.lit(float(v)) for v in basis[:, k]]))) for k in range(8)]
    moved = F.aggregate(F.zip_with("x", "once", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda t, v: t + v)
    return twice.select("recording_id", (F.greatest(*along) < 1e-12).alias("gone"), (dot("once", "once") < dot("was", "was")).alias("shorter"), (moved < 1e-12).alias("twice_is_once"))


ABLATION_RANKS = [1, 2, 4, 16, 32]


@query(
    "m20_subspace_ablation",
    f"""SELECT k, CAST(5 AS BIGINT) AS n_repeats, TRUE AS converged, TRUE AS identity_was_there, k >= 4 AS identity_is_gone,
      TRUE AS illness_found, k >= 16 AS illness_gone, TRUE AS topk_removes_most
    FROM (SELECT unnest({ABLATION_RANKS})::INTEGER AS k)""",
)
def m20(spark, d):
    """Planted voices go with the first four directions, the planted illness only with later ones."""
    out = st.subspace_ablation(planted_voices(spark, d), ranks=ABLATION_RANKS, repeats=5, together=5, n_folds=5, n_way=20, min_units=2, **KEYS)
    sure = 2 * F.col("speaker_id_chance")
    return out.select(
        "k",
        "n_repeats",
        (F.col("kkt") <= 1e-6).alias("converged"),
        (F.col("speaker_id_full") > 3 * F.col("speaker_id_chance")).alias("identity_was_there"),
        (F.col("speaker_id_after") < F.greatest(sure, F.col("speaker_id_full") / 2)).alias("identity_is_gone"),
        (F.col("auc_full") > 0.8).alias("illness_found"),
        (F.col("auc_speaker_removed") < 0.6).alias("illness_gone"),
        (F.col("variance_pca_topk") >= F.col("variance_speaker") - 1e-9).alias("topk_removes_most"),
    )


@query("m21_within_class_gate", "SELECT CAST(k AS INTEGER) AS k, TRUE AS in_range, TRUE AS span_grows, TRUE AS follows_rule FROM (SELECT unnest([1, 4, 8]) AS k)")
def m21(spark, d):
    _, means = _people_means(spark, d)
    out = []
    for k in (1, 4, 8):
        w = sub.within_class_subspace(means, k)
        rule = "OK" if w.max_cos < 0.10 and w.in_span < 0.20 else "BROKEN"
        grows = not out or w.in_span >= last - 1e-12
        last = w.in_span
        out.append((k, 0 <= w.max_cos <= w.in_span + 1e-12 <= 1 + 1e-9, bool(grows), w.status == rule))
    return spark.createDataFrame(out, "k int, in_range boolean, span_grows boolean, follows_rule boolean")


@query(
    "m22_extra_directions",
    f"SELECT head, {CLASSES}, found FROM (VALUES ('full', TRUE), ('haar8', TRUE), ('class_direction', FALSE)) AS t(head, found)",
)
def m22(spark, d):
    """AUC after removing a random rank-8 subspace (stays) and the class direction itself (must collapse)."""
    u = planted_voices(spark, d, voice=0.0, illness=0.8)
    means = materialise(sub.group_means(u, group="speaker_id", extra=["y"]))
    w = sub.within_class_subspace(means, 1).direction.reshape(-1, 1)
    views = [mod.View("full"), mod.View("haar8", basis=sub.haar_basis(64, 8, 0)), mod.View("class_direction", basis=w)]
    auc = st.grouped_auc(u, views=views, repeats=1, n_folds=5, **KEYS)
    return auc.select("head", "n_pos", "n_neg", found())


@query("m23_direction_stability", "SELECT * FROM (VALUES ('strong', 200, TRUE), ('none', 200, FALSE)) AS t(illness, n_boot, stable)")
def m23(spark, d):
    """A planted class direction comes back from resampled groups, one that is not there does not."""
    rows = []
    for name, size in (("strong", 1.0), ("none", 0.0)):
        means = materialise(sub.group_means(planted_voices(spark, d, voice=0.0, illness=size), group="speaker_id", extra=["y"]))
        cos = sub.direction_stability(means, group="speaker_id", n_boot=200)
        rows.append((name, len(cos), bool(np.percentile(cos, 5) >= 0.85)))
    return spark.createDataFrame(rows, "illness string, n_boot int, stable boolean")


@query("m25_shuffle_test", "SELECT 'hard' AS mode, TRUE AS found, 0.5::DOUBLE AS chance_baseline, CAST(8 AS BIGINT) AS n_repeats, TRUE AS falls_to_chance")
def m25(spark, d):
    out = st.shuffle_test(ill(spark, d), repeats=8, n_folds=5, **KEYS)
    return out.select("mode", found("real_score"), "chance_baseline", "n_repeats", (F.col("verdict") != "FAIL").alias("falls_to_chance"))


@query("m26_scaler_scope", "SELECT 'vectors' AS head, TRUE AS found, TRUE AS found_per_fold, CAST(10 AS BIGINT) AS n_repeats, TRUE AS scope_hardly_matters")
def m26(spark, d):
    out = st.scaler_scope(ill(spark, d), views=[mod.View("vectors")], repeats=10, n_folds=5, **KEYS)
    return out.select("head", found("auc_fit_on_all"), found("auc_fit_per_fold").alias("found_per_fold"), "n_repeats", (F.abs("mean") < 0.02).alias("scope_hardly_matters"))


@query("m27_shortcut_probe", "SELECT * FROM (VALUES ('silence_only', TRUE, CAST(10 AS BIGINT)), ('duration_intensity_only', NULL, 10)) AS t(head, clears_floor, n_repeats)")
def m27(spark, d):
    """Silence statistics and duration with loudness as the only features of a user."""
    from groupaudit.operators.signals import silence_features

    e = fx.recordings(spark, d)
    # the ill pause: every second frame of theirs is silent
    e = e.withColumn("duration", F.when((F.col("y") == 1) & (F.col("recording_id") % 2 == 0), 0.0).otherwise(F.col("duration")))
    e = e.withColumn("rec", F.concat_ws("-", "speaker_id", F.dayofmonth("ts") % 5))
    sil = silence_features(e, rec="rec", frame="recording_id", energy="duration")
    cols = ("silence_ratio", "n_pauses", "mean_pause_s", "max_pause_s", "log_duration", "speech_s", "n_transitions")
    own = e.groupBy("rec", "speaker_id").agg(F.min("y").alias("y"), F.sqrt(F.avg(F.col("duration") * F.col("duration"))).alias("rms"), F.count("*").cast("double").alias("dur"))
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(c), nan) for c in cols], "dur", "rms", F.log1p("dur"))
    units = own.join(sil, "rec").select("rec", "speaker_id", "y", x.alias("x"))
    views = [mod.View("silence_only", tuple(range(7))), mod.View("duration_intensity_only", (7, 8, 9))]
    out = st.shortcut_probe(units, unit="rec", group="speaker_id", views=views, repeats=10, n_folds=5)
    return out.select("head", F.when(F.col("head") == "silence_only", F.col("clears_floor")).alias("clears_floor"), "n_repeats")


@query(
    "m28_matched_comparison",
    """SELECT a, b, CAST(n AS BIGINT) AS n_seeds, TRUE AS matching_worked, wins AS a_wins, status FROM (VALUES ('full', 'first8', 5, TRUE, 'RUN'),
      ('full', 'partial', 0, NULL, 'SKIPPED: no seed ran full and partial')) AS t(a, b, n, wins, status)""",
)
def m28(spark, d):
    """The arm that holds the planted illness beats the one that does not; one that lacks rows is not compared."""
    f = planted_voices(spark, d, voice=0.0, illness=0.8)
    who = F.crc32("speaker_id")
    people = f.select("recording_id", "speaker_id", "y", "x", (who % 12 + 30).alias("age"), F.when(who % 2 == 0, "F").otherwise("M").alias("sex"))
    arms = {"full": f.select("recording_id", "x"), "partial": f.where("recording_id % 2 = 0").select("recording_id", "x"), "first8": f.select("recording_id", F.slice("x", 1, 8).alias("x"))}
    runs = materialise(st.matched_comparison(people, arms, age="age", sex="sex", tol=3, seeds=5, n_folds=5, **KEYS))
    out = st.matched_outcome(runs, contrasts=[("full", "first8"), ("full", "partial")])
    return out.select("a", "b", "n_seeds", "matching_worked", "a_wins", "status")


@query("w07_ensemble_heads", f"SELECT {CLASSES}, TRUE AS found")
def w07(spark, d):
    """Rank average of several probes chosen per fold by training-only inner AUC."""
    u = planted_voices(spark, d, voice=0.0, illness=0.8)
    f = materialise(sp.stratified_folds(u, group="speaker_id", label="y", n_folds=3))
    views = [mod.View(f"dims{a}_{a + 15}", tuple(range(a, a + 16))) for a in (0, 16, 32, 48)]
    oof = mod.out_of_fold(u, f, views=views, n_folds=3, repeats=1, **KEYS)
    inner = materialise(sp.inner_folds(f, group="speaker_id", outer=3))
    # one design per outer fold: inner folds as codes, the outer test fold left out
    by_outer = inner.select(F.col("outer_fold").alias("repeat"), "speaker_id", F.col("inner_fold").alias("fold"))
    every = f.select("speaker_id").distinct().withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    codes = every.join(by_outer, ["repeat", "speaker_id"], "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    data = materialise(mod.attach_codes(u, codes, group="speaker_id"))
    inner_oof = mod.predict(data, mod.fit_linear(data, mod.specs(views, 3, 3)), **KEYS)
    auc = m.roc_auc(inner_oof, score="p", label="y", by=["repeat", "head"]).select(
        F.lit(0).alias("repeat"), F.col("repeat").alias("fold"), "head", "auc"
    )
    ens = hd.rank_ensemble(oof, auc).join(oof.select("unit_id", "y").distinct(), "unit_id")
    return m.roc_auc(ens, score="rank_score", label="y").select("n_pos", "n_neg", found(floor=0.65))


@query("m06_benchmark_verdicts", f"SELECT 'logreg' AS head, TRUE AS ahead_of_the_bar, TRUE AS group_ahead, '{inf.CLEARED}' AS verdict")
def bench_verdicts(spark, d):
    """Vectors with a planted illness against confounds that know nothing of it, on identical folds: cleared."""
    u = planted_voices(spark, d, voice=0.0, illness=0.8)
    c = fx.features(spark, d).withColumn("age", F.crc32("speaker_id") % 50 + 20).withColumn("sex", F.when(F.crc32("speaker_id") % 3 == 0, "M").otherwise("F"))
    c = c.withColumn("dur", (F.col("recording_id") % 60).cast("double")).withColumn("rms", F.get("x", F.lit(0)) * F.get("x", F.lit(0)))
    cov = mod.confound_features(c, age="age", sex="sex", duration="dur", rms="rms").select("recording_id", "speaker_id", "y", "x")
    out = st.benchmark(u, cov, n_folds=5, repeats=8, n_boot=2000, **KEYS)
    return out.select("head", (F.col("unit_delta") > 0.2).alias("ahead_of_the_bar"), (F.col("group_lo") > 0).alias("group_ahead"), "verdict")