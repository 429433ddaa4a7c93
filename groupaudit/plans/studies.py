"""Composed studies: the operators of one audit in one declarative flow."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupaudit.operators import designs as ds
from groupaudit.operators import inference as inf
from groupaudit.operators import metrics as m
from groupaudit.operators import models as mod
from groupaudit.operators import resampling as rs
from groupaudit.operators import splits as sp
from groupaudit.operators import subspace as sub
from groupaudit.operators.ranks import running_before
from groupaudit.operators.wide import fit_wide
from groupaudit.session import materialise, scratch_path, spread


def margins(long: DataFrame, draw: rs.Draw, *, n_repeats: int) -> DataFrame:
    """Every audio head against the strongest confound, at unit and at group grain.

    ``long`` has kind (audio / confound), head, unit_id, group_id, y, s.  The bar is chosen by
    unit-grain AUC; both grains use the same group draws.
    """
    auc = m.roc_auc(long, score="s", label="y", by=["kind", "head"])
    bar = inf.best_by(auc.where("kind = 'confound'"), by=[], kind="kind", name="head", value="auc")
    bar_name = bar.first()["best"]  # one row: the name of the bar
    by_group = (
        long.groupBy("kind", "head", "group_id")
        .agg(F.round(F.avg("s"), 9).alias("s"), F.bround(F.avg("y"), 0).cast("int").alias("y"))
        .withColumn("unit_id", F.col("group_id"))
    )
    n_heads = auc.where("kind = 'audio'").agg(F.count("*")).scalar()
    out = None
    for grain, table in (("unit", long), ("group", by_group)):
        audio = table.where("kind = 'audio'").select("head", "unit_id", "group_id", "y", F.col("s").alias("p_head"))
        conf = table.where(F.col("head") == bar_name).select("unit_id", F.col("s").alias("p_bar"))
        deltas = rs.paired_bootstrap(
            audio.join(conf, "unit_id"), draw, group="group_id", label="y", a="p_head", b="p_bar", by=["head"]
        ).select("head", *[F.col(c).alias(f"{grain}_{c}") for c in ("delta", "lo", "hi")])
        out = deltas if out is None else out.join(deltas, "head")
    feasible = inf.power_columns(F.lit(n_repeats), n_heads)[2]
    return out.withColumn("bar", F.lit(bar_name)).withColumn(
        "verdict", inf.clearance(F.col("unit_lo"), F.col("group_lo"), feasible)
    )


# --- studies that fit models ---------------------------------------------------------------


def auc_per_repeat(predictions: DataFrame) -> DataFrame:
    return m.roc_auc(predictions, score="p", label="y", by=["head", "repeat"])


def grouped_auc(units: DataFrame, *, unit: str, group: str, views, repeats: int, n_folds: int, seed: int = 0, **fit) -> DataFrame:
    """(head, repeat, auc) under size-balanced group folds."""
    folds = sp.balanced_folds(units, group=group, n_folds=n_folds, repeats=repeats, seed=seed)
    oof = mod.out_of_fold(units, folds, unit=unit, group=group, views=views, n_folds=n_folds, repeats=repeats, **fit)
    return auc_per_repeat(oof)


def metadata_baseline(sessions: DataFrame, *, group: str, label: str, age: str, sex: str) -> DataFrame:
    """The no-model confound bar: counts, class means, raw covariate AUCs and leakage exposure."""
    d = sessions.where(F.col(age).isNotNull()).withColumn("female", (F.col(sex) == "F").cast("int"))
    base = d.agg(
        F.count("*").alias("n_sessions"),
        F.sum(label).cast("bigint").alias("n_pathological"),
        F.sum(1 - F.col(label)).cast("bigint").alias("n_healthy"),
        F.avg(F.when(F.col(label) == 0, F.col(age))).alias("mean_age_healthy"),
        F.avg(F.when(F.col(label) == 1, F.col(age))).alias("mean_age_pathological"),
    )
    per = d.groupBy(group).agg(F.count("*").alias("_n"))
    spread = per.agg(F.count("*").alias("g"), F.count_if(F.col("_n") > 1).alias("multi"), F.max("_n").alias("top"))
    covariates = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in (("age", age), ("sex", "female"))])
    auc = m.roc_auc(d.select(label, F.explode(covariates).alias("_c")).select(label, "_c.*"), score="v", label=label, by=["k"])
    one = lambda k: auc.where(F.col("k") == k).select("auc").scalar()
    return base.select(
        "*",
        spread.select("g").scalar().alias("n_speakers"),
        spread.select("multi").scalar().alias("speakers_with_multiple_sessions"),
        spread.select("top").scalar().alias("max_sessions_per_speaker"),
        one("age").alias("auc_age_only"),
        one("sex").alias("auc_sex_only"),
    )


def scaler_scope(units: DataFrame, *, unit: str, group: str, views, repeats: int, n_folds: int, seed: int = 0) -> DataFrame:
    """Leaky minus clean scaling on identical folds: mean delta, CI and the +-0.01 flag."""
    folds = sp.balanced_folds(units, group=group, n_folds=n_folds, repeats=repeats, seed=seed)
    arms = {}
    for name, leak in (("leak", True), ("clean", False)):
        oof = mod.out_of_fold(
            units, folds, unit=unit, group=group, views=views, n_folds=n_folds, repeats=repeats, whole_table=leak, fit=fit_wide
        )
        arms[name] = auc_per_repeat(oof).select("head", "repeat", F.col("auc").alias(name))
    both = materialise(arms["leak"].join(arms["clean"], ["head", "repeat"]).withColumn("delta", F.col("leak") - F.col("clean")))
    ci = rs.bootstrap_mean(both, study="head", order="repeat", value="delta")
    means = both.groupBy("head").agg(F.avg("leak").alias("auc_fit_on_all"), F.avg("clean").alias("auc_fit_per_fold"))
    return means.join(ci.drop("excludes_zero"), "head").withColumn("within", (F.col("lo") > -0.01) & (F.col("hi") < 0.01))


def shortcut_probe(units: DataFrame, *, unit: str, group: str, views, repeats: int, n_folds: int, floor: float = 0.60) -> DataFrame:
    """Mean AUC with CI of content-free features; a shortcut that predicts the wrong way still counts."""
    auc = materialise(grouped_auc(units, unit=unit, group=group, views=views, repeats=repeats, n_folds=n_folds))
    ci = rs.bootstrap_mean(auc, study="head", order="repeat", value="auc").withColumnRenamed("mean", "auc")
    return ci.drop("excludes_zero").select("*", *m.directionless("auc", floor))


def matched_comparison(
    units: DataFrame, arms: dict[str, DataFrame], *, unit: str, group: str, age: str, sex: str, tol: int, seeds: int, n_folds: int
) -> DataFrame:
    """Representations on one demographically matched subset per seed, the age-only check first.

    An arm that does not cover every matched unit is reported as skipped, not trimmed to fit.
    Seeds are designs of one table (unmatched rows carry code -1), so all arms and seeds share scans.
    """
    people = materialise(
        units.groupBy(group).agg(F.bround(F.avg("y"), 0).cast("int").alias("y"), F.min(age).alias(age), F.min(sex).alias(sex))
    )
    reports, folds = None, None
    for s in range(seeds):
        pairs = ds.caliper_match(people, group=group, label="y", age=age, exact=sex, tol=tol, seed=s)
        chosen = pairs.select(F.explode(F.array("control", "case")).alias(group))
        f = sp.balanced_folds(units.join(chosen, group, "left_semi"), group=group, n_folds=n_folds, seed=s)
        f = f.select(group, F.lit(s).alias("repeat"), "fold")
        rep = ds.match_report(pairs).select(F.lit(s).alias("seed"), "n_pairs", "age_gap")
        folds, reports = (f, rep) if folds is None else (folds.unionByName(f), reports.unionByName(rep))
    folds = materialise(folds)
    sp.require_disjoint(folds, group=group)
    every = people.select(group, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("repeat"))
    codes = every.join(folds, [group, "repeat"], "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    table = mod.attach_codes(units.drop("x"), codes, group=group)
    views, parts, at = {"age_only": (0,)}, [F.array(F.col(age).cast("double"))], 1
    for name, arm in arms.items():
        d = arm.select(F.size("x")).first()[0]
        table = table.join(arm.select(unit, F.col("x").alias(f"_x_{name}")), unit, "left")
        gap = F.array_repeat(F.lit(float("nan")), d)
        parts.append(F.coalesce(F.transform(f"_x_{name}", lambda v: v.cast("double")), gap))
        views[name], at = tuple(range(at, at + d)), at + d
    has = F.array(F.lit(True), *[F.col(f"_x_{name}").isNotNull() for name in arms])
    data = spread(table.select(unit, group, "y", "codes", F.concat(*parts).alias("x"), has.alias("has")))
    # how many matched units of each seed every arm covers
    cover = (
        data.select(F.posexplode("codes").alias("seed", "code"), "has")
        .where("code >= 0")
        .groupBy("seed")
        .agg(F.count("*").alias("n_units"), *[F.count_if(F.get("has", F.lit(i))).alias(n) for i, n in enumerate(views)])
    )
    rows = {r["seed"]: r for r in cover.collect()}  # one row per seed
    models = [
        mod.Spec(mod.View(n, cols), s, k)
        for n, cols in views.items()
        for s, r in rows.items()
        if r[n] == r["n_units"]
        for k in range(n_folds)
    ]
    auc = auc_per_repeat(mod.predict(data, mod.fit_linear(data, models), unit=unit, group=group)).select(
        F.col("repeat").alias("seed"), F.col("head").alias("arm"), "auc"
    )
    plan = cover.select("seed", "n_units", F.explode(F.array(*[F.lit(n) for n in views])).alias("arm"))
    status = F.when(F.col("auc").isNull(), "SKIPPED: rows without a partner").otherwise("RUN")
    return plan.join(reports, "seed").join(auc, ["seed", "arm"], "left").withColumn("status", status)


def matched_outcome(runs: DataFrame, *, contrasts, floor: float = 0.60) -> DataFrame:
    """Verdict of matched comparisons per contrast (a, b) of arms, over the seeds in which both ran.

    The matching worked if age alone stays below ``floor`` on average, which is checked and not taken
    from the construction.  The delta is paired by seed; a wins if its interval lies above zero.  A
    contrast with an arm that never ran is a row with the reason and no numbers.
    """
    spark = runs.sparkSession
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(contrasts)], "i int, a string, b string")
    ran = runs.where("status = 'RUN'").select("seed", "arm", "auc")
    side = lambda n: ran.select("seed", F.col("arm").alias(n), F.col("auc").alias(f"auc_{n}"))
    both = materialise(pairs.join(side("a"), "a").join(side("b"), ["b", "seed"]).withColumn("delta", F.col("auc_a") - F.col("auc_b")))
    ci = rs.bootstrap_mean(both, study="i", order="seed", value="delta").select(
        "i", F.col("mean").alias("delta"), "lo", "hi", (F.col("lo") > 0).alias("a_wins"), F.col("n_repeats").alias("n_seeds")
    )
    means = both.groupBy("i").agg(F.avg("auc_a").alias("mean_auc_a"), F.avg("auc_b").alias("mean_auc_b"))
    per_seed = runs.groupBy("seed").agg(F.max("n_pairs").alias("n_pairs"), F.max("age_gap").alias("age_gap"), F.max(F.when(F.col("arm") == "age_only", F.col("auc"))).alias("age_only"))
    whole = per_seed.agg(F.avg("n_pairs").alias("mean_pairs"), F.avg("age_gap").alias("mean_age_gap"), F.avg("age_only").alias("mean_auc_age_only"))
    out = pairs.join(means, "i", "left").join(ci, "i", "left").join(whole.hint("broadcast"), F.lit(True))  # one row
    reason = F.when(F.col("delta").isNull(), F.concat(F.lit("SKIPPED: no seed ran "), "a", F.lit(" and "), "b")).otherwise("RUN")
    worked = F.coalesce(F.col("mean_auc_age_only") < floor, F.lit(False))
    return out.withColumns({"matching_worked": worked, "status": reason, "n_seeds": F.coalesce("n_seeds", F.lit(0).cast("long"))}).drop("i")


def transfer(units: DataFrame, *, unit: str, group: str, corpus: str, n_folds: int = 3) -> DataFrame:
    """AUC and ECE within and across corpora, each direction fitted on one corpus and scored on the other."""
    names = [r[0] for r in units.select(corpus).distinct().orderBy(corpus).collect()]
    if len(names) != 2:
        raise ValueError("transfer needs exactly two corpora")
    code = (F.col(corpus) == names[1]).cast("int")
    data = spread(units.withColumn("codes", F.array(code)))
    # model (fold f) trains on the other corpus and scores corpus f
    across = mod.predict(data, mod.fit_linear(data, mod.specs([mod.View("across")], 1, 2)), unit=unit, group=group)
    parts = [across.withColumn("target", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("fold") + 1))]
    for n in names:
        own = units.where(F.col(corpus) == n)
        folds = sp.stratified_folds(own, group=group, label="y", n_folds=n_folds)
        oof = mod.out_of_fold(own, folds, unit=unit, group=group, views=[mod.View("within")], n_folds=n_folds, repeats=1)
        parts.append(oof.withColumn("target", F.lit(n)))
    p = parts[0]
    for q in parts[1:]:
        p = p.unionByName(q)
    p = materialise(p)
    auc = m.roc_auc(p, score="p", label="y", by=["head", "target"])
    bins = m.equal_mass_bins(p, score="p", label="y", unit="unit_id", by=["head", "target"])
    return auc.join(m.ece_from_bins(bins, ["head", "target"]).drop("n"), ["head", "target"])


def learning_curve(units: DataFrame, *, unit: str, group: str, views: dict, sizes, n_folds: int, repeats: int, seed: int = 0) -> DataFrame:
    """AUC per (view, n_train groups) from nested samples: the heads of one hash order per repeat."""
    people = units.select(group).distinct()
    ranks = sp.nested_ranks(people, group=group, repeats=repeats, seed=seed)
    folds = sp.stratified_folds(units, group=group, label="y", n_folds=n_folds, repeats=repeats, seed=seed)
    data = spread(mod.attach_codes(units, folds, group=group).join(ranks, group))
    every = [mod.View(f"{name}|{n}", cols, max_rank=n) for name, cols in views.items() for n in sizes]
    fits = mod.fit_linear(data, mod.specs(every, repeats, n_folds))
    p = materialise(mod.predict(data, fits, unit=unit, group=group))
    auc = auc_per_repeat(p).groupBy("head").agg(F.avg("auc").alias("auc"))
    cut = F.split("head", r"\|")
    return auc.select(F.get(cut, F.lit(0)).alias("view"), F.get(cut, F.lit(1)).cast("int").alias("n_train"), "auc")


def crossover(curve: DataFrame, *, a: str, b: str) -> DataFrame:
    """Smallest n_train at which the leader changes from the size before."""
    pick = lambda v: F.max(F.when(F.col("view") == v, F.col("auc")))
    wide = curve.groupBy("n_train").agg((pick(a) - pick(b)).alias("gap"))
    prev = running_before(wide, order="n_train", tie="n_train", last={"before": "gap"})
    return prev.agg(F.min(F.when(F.signum("gap") != F.signum("before"), F.col("n_train"))).alias("crossover_n"))


def overlap_sweep(units: DataFrame, *, unit: str, group: str, rhos, seed: int = 0) -> DataFrame:
    """AUC on the fixed test side as rho of its groups also enter training of constant size."""
    sides = sp.controlled_overlap(units, group=group, unit=unit, rhos=rhos, seed=seed)
    code = F.when(F.col("side") == "test", 0).when(F.col("side") == "train", 1).otherwise(-1)
    codes = sides.groupBy(unit).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rho", code.alias("c")))), lambda s: s["c"]).alias("codes")
    )
    data = spread(units.join(codes, unit))
    fits = mod.fit_linear(data, [mod.Spec(mod.View("overlap"), i, 0) for i in range(len(rhos))])
    auc = auc_per_repeat(mod.predict(data, fits, unit=unit, group=group))
    table = F.element_at(F.array(*[F.lit(float(r)) for r in sorted(rhos)]), F.col("repeat") + 1)
    n_train = {i: f.n_train for i, f in enumerate(fits)}
    return auc.select(
        table.alias("rho"),
        F.element_at(F.array(*[F.lit(n_train[i]) for i in range(len(rhos))]), F.col("repeat") + 1).alias("n_train_rows"),
        "n_pos",
        "n_neg",
        "auc",
    )


def shuffle_test(
    units: DataFrame, *, unit: str, group: str, repeats: int, n_folds: int, seed: int = 0, within=(), mode: str | None = None,
    time: str | None = None, n_blocks: int = 5, tolerance: float = 0.05,
) -> DataFrame:
    """Real AUC against the AUC under permuted group labels, with a PASS / WEAK / FAIL verdict.

    Design 0 keeps the labels, the others permute them: over all groups, inside strata ``within``, or
    inside blocks of ``time``.  All share folds and scans.
    """
    mode = mode or ("within_group" if within else "hard")
    folds = materialise(sp.balanced_folds(units, group=group, n_folds=n_folds, repeats=1, seed=seed))
    sp.require_disjoint(folds, group=group)
    first = [F.min(time).alias(time)] if time else []
    people = materialise(units.groupBy(group, *within).agg(F.min("y").alias("y"), *first))
    labels = people.select(group, F.lit(0).alias("k"), "y")
    for s in range(repeats):
        moved = sp.shuffle_labels(people, group=group, label="y", mode=mode, seed=seed + 10 * s, within=list(within), time=time, n_blocks=n_blocks)
        labels = labels.unionByName(moved.select(group, F.lit(s + 1).alias("k"), F.col("y_shuffled").alias("y")))
    ys = labels.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda v: v["y"]).alias("ys")
    )
    codes = folds.select(group, F.array_repeat("fold", repeats + 1).alias("codes"))
    data = spread(units.join(codes, group).join(ys, group))
    fits = mod.fit_linear(data, mod.specs([mod.View("probe")], repeats + 1, n_folds))
    auc = materialise(auc_per_repeat(mod.predict(data, fits, unit=unit, group=group)))
    real = auc.where("repeat = 0").select("auc").scalar()
    scores = auc.where("repeat > 0").select(
        F.lit(mode).alias("mode"), real.alias("real"), F.col("auc").alias("shuffled")
    )
    chance = inf.chance_baseline(people, label="y", metric="auc").select("chance").scalar()
    return inf.shuffle_verdict(scores, by=["mode"], chance=chance, tolerance=tolerance)


ARMS = ("speaker", "pca_topk", "var_matched")
ABLATION = "repeat int, arm string, k int, auc double, share double, kkt double"


def _ablation_repeats(units: DataFrame, *, unit: str, group: str, ranks, wanted: list[int], n_folds: int, seed: int) -> DataFrame:
    """Some repeats: subspaces of each one's training groups, and a model per repeat, arm, rank and fold."""
    people = units.select(group).distinct()
    for r in wanted:
        people = sp.holdout(people, group=group, seed=10_000 + seed + r, exact=True).withColumnRenamed("is_train", f"t{r}")
    keep = [f"t{r}" for r in wanted]
    rows = materialise(units.join(materialise(people), group))
    between, total = sub.scatter(sub.group_means(rows, group=group, extra=keep), keep=keep), sub.scatter(rows, keep=keep)
    models, shares, folds = [], {}, None
    for i, r in enumerate(wanted):
        cov = total[i][2]
        directions, _ = sub.top_directions(between[i][2], max(ranks))
        principal, spectrum = sub.top_directions(cov, max(ranks))
        views = [mod.View("full|0")]
        shares[r, "full|0"] = 0.0
        for k in ranks:
            own = sub.variance_share(directions[:, :k], cov)
            matched, matched_share = sub.variance_matched(cov, k, own)
            top = float(spectrum[:k].sum() / spectrum.sum())
            for arm, basis, v in zip(ARMS, (directions[:, :k], principal[:, :k], matched), (own, top, matched_share)):
                views.append(mod.View(f"{arm}|{k}", basis=basis))
                shares[r, f"{arm}|{k}"] = v
        models += [mod.Spec(v, i, f) for v in views for f in range(n_folds)]
        f = sp.balanced_folds(units, group=group, n_folds=n_folds, repeats=1, seed=seed + r).withColumn("repeat", F.lit(i))
        folds = f if folds is None else folds.unionByName(f)
    data = spread(mod.attach_codes(units, folds, group=group))
    fits = fit_wide(data, models, tol=1e-6)
    worst: dict[tuple[int, str], float] = {}
    for f in fits:
        key = wanted[f.spec.design], f.spec.view.name
        worst[key] = max(worst.get(key, 0.0), f.kkt)
    info = units.sparkSession.createDataFrame(
        [(wanted.index(r), name, r, *name.split("|"), share, worst[r, name]) for (r, name), share in shares.items()],
        "design int, head string, number int, arm string, k string, share double, kkt double",
    )
    auc = auc_per_repeat(mod.predict(data, fits, unit=unit, group=group)).withColumnRenamed("repeat", "design")
    return auc.join(info, ["design", "head"]).select(F.col("number").alias("repeat"), "arm", F.col("k").cast("int").alias("k"), "auc", "share", "kkt")


def table_fingerprint(df: DataFrame, columns) -> str:
    """Order-free digest of rows: sums of their hashes, so that no row is sorted or collected."""
    h = [F.xxhash64(F.lit(i), *columns).cast("decimal(38,0)") for i in range(2)]
    return "|".join(str(v) for v in df.agg(F.count("*"), *[F.sum(x) for x in h]).first())


def subspace_ablation(
    units: DataFrame,
    *,
    unit: str,
    group: str,
    ranks,
    repeats: int,
    n_folds: int,
    seed: int = 0,
    state: str | None = None,
    together: int = 1,
    n_way: int = 60,
    min_units: int = 12,
) -> DataFrame:
    """AUC after removing the identity subspace and two variance controls, per rank.

    Each repeat is a row set of a state table under ``state``, keyed by study, settings and data; a
    killed study goes on with the repeats that are not there yet.  ``together`` repeats share scans and
    are finished at once.  The wide solver's largest gradient component is reported as ``kkt``.  An identity probe before and after
    the removal tells whether removal did what it claims.
    """
    spark, ranks = units.sparkSession, sorted(ranks)
    settings = [ranks, n_folds, seed, table_fingerprint(units, [unit, group, "y", "x"])]
    config = hashlib.sha256(json.dumps(settings).encode()).hexdigest()[:16]
    folder = f"{state or scratch_path(spark, 'studies')}/study=subspace_ablation/config={config}"
    want = 1 + len(ranks) * len(ARMS)

    def done() -> DataFrame:
        try:
            found = spark.read.schema(ABLATION).option("recursiveFileLookup", "true").parquet(folder)
            found.limit(0).count()
        except AnalysisException:  # nothing finished yet
            return spark.createDataFrame([], ABLATION)
        # a repeat that two runs wrote counts once; they are equal
        return found.dropDuplicates(["repeat", "arm", "k"])

    whole = done().groupBy("repeat").agg(F.count("*").alias("n")).where(F.col("n") == want)
    todo = spark.range(repeats).select(F.col("id").cast("int").alias("repeat")).join(whole, "repeat", "left_anti")
    open_ = sorted(x["repeat"] for x in todo.collect())
    for lo in range(0, len(open_), together):
        wanted = open_[lo : lo + together]
        some = materialise(_ablation_repeats(units, unit=unit, group=group, ranks=ranks, wanted=wanted, n_folds=n_folds, seed=seed))
        for r in wanted:
            some.where(F.col("repeat") == r).coalesce(1).write.parquet(f"{folder}/repeat_{r}", mode="overwrite")
    result = materialise(done().where(F.col("repeat") < repeats))

    pick = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    wide = materialise(
        result.where("k > 0").groupBy("k", "repeat").agg(
            *[pick(a, "auc").alias(a) for a in ARMS], *[pick(a, "share").alias(f"share_{a}") for a in ARMS], F.max("kkt").alias("kkt")
        )
    )
    full = result.where("arm = 'full'").agg(F.avg("auc")).first()[0]
    out = wide.groupBy("k").agg(
        F.lit(full).alias("auc_full"),
        *[F.avg(c).alias(f"auc_{c}_removed") for c in ARMS],
        (F.lit(full) - F.avg("speaker")).alias("drop_from_full"),
        *[F.avg(f"share_{c}").alias(f"variance_{c}") for c in ARMS],
        F.max("kkt").alias("kkt"),
        F.count("*").alias("n_repeats"),
    )
    for c in ARMS[1:]:
        d = wide.select("k", "repeat", (F.col(c) - F.col("speaker")).alias("d"))
        ci = rs.bootstrap_mean(d, study="k", order="repeat", value="d").select(
            "k", *[F.col(x).alias(f"d_{c}_{x}") for x in ("mean", "lo", "hi", "excludes_zero")]
        )
        out = out.join(ci, "k")
    # the manipulation check removes the subspace of all groups, as a user of the result would
    means = sub.group_means(units, group=group).withColumn("all_rows", F.lit(True))
    every, _ = sub.top_directions(sub.scatter(means, keep=["all_rows"])[0][2], max(ranks))
    probe = dict(unit=unit, group=group, n_way=n_way, min_units=min_units, seed=seed)
    before, chance = sub.identity_probe(units, **probe)
    after = [(k, sub.identity_probe(sub.project_out(units, every[:, :k]), **probe)[0]) for k in ranks]
    checks = spark.createDataFrame(after, "k int, speaker_id_after double")
    return out.join(checks, "k").withColumn("speaker_id_full", F.lit(before)).withColumn("speaker_id_chance", F.lit(chance))


def benchmark(
    units: DataFrame, covariates: DataFrame, *, unit: str, group: str, n_folds: int, repeats: int, n_boot: int, seed: int = 0
) -> DataFrame:
    """Learned features against the confound battery on identical folds, with margins and verdicts.

    The pooled prediction table is the one materialisation; all later numbers are queries on it.
    """
    folds = materialise(sp.stratified_folds(units, group=group, label="y", n_folds=n_folds, repeats=repeats, seed=seed))
    fit = dict(unit=unit, group=group, n_folds=n_folds, repeats=repeats)
    audio = mod.out_of_fold(units, folds, views=[mod.View("logreg")], **fit).withColumn("kind", F.lit("audio"))
    conf = mod.out_of_fold(covariates, folds, views=mod.confound_views(), **fit).withColumn("kind", F.lit("confound"))
    pooled = inf.pooled_repeats(audio.unionByName(conf), keys=["kind", "head", "unit_id", "group_id", "y"])
    long = materialise(pooled.withColumnRenamed("p", "s"))
    draw = rs.cluster_weights(long.select("group_id").distinct(), group="group_id", n_boot=n_boot, seed=seed + 777)
    return margins(long, draw, n_repeats=repeats)
