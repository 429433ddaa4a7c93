"""Tests, corrections and verdicts over tables of results."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.operators.metrics import ratio
from groupaudit.operators.ranks import quantile_bounds, running_before
from groupaudit.session import materialise


def power_columns(n: Column, m: Column, alpha: float = 0.05) -> list[Column]:
    """Can n paired repeats clear the tightest Holm threshold of a family of m at all?"""
    p_min = F.when(n > 0, 2 / F.pow(F.lit(2.0), n)).otherwise(F.lit(1.0))
    holm = F.lit(alpha) / F.greatest(m, F.lit(1))
    need = F.greatest(F.lit(1), F.ceil(F.log2(2 / holm))).cast("int")
    return [
        p_min.alias("min_attainable_p"),
        holm.alias("holm_tightest"),
        (p_min <= holm).alias("feasible"),
        need.alias("min_n"),
    ]


def holm(df: DataFrame, *, family: str, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p per family (monotone, at most 1) and the rejection flag.

    Equal p values get equal results, whatever their order (``tie`` only names rows), so prefix counts and
    maxima run over the distinct p values of a family, in buckets of p: a family with all tests spreads.
    A missing p is no test: it does not count and stays missing.
    """
    pts = df.where(F.col(p).isNotNull()).groupBy(F.col(family).alias("_f"), F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    pts = materialise(pts)
    bounds = quantile_bounds(pts, "_p")
    sizes = pts.groupBy("_f").agg(F.sum("_n").alias("_m"))
    before = running_before(pts, part=["_f"], order="_p", tie="_p", sums={"_before": "_n"}, bounds=bounds)
    steps = before.join(sizes.withColumnRenamed("_f", "_g"), F.col("_f").eqNullSafe(F.col("_g"))).drop("_g")
    steps = steps.withColumn("_step", F.col("_p") * (F.col("_m") - F.col("_before")))
    top = running_before(steps, part=["_f"], order="_p", tie="_p", maxs={"_top": "_step"}, bounds=bounds)
    adjusted = top.select("_f", "_p", F.least(F.lit(1.0), F.greatest("_step", "_top")).alias("p_holm"))
    out = df.join(adjusted, F.col(family).eqNullSafe(F.col("_f")) & (F.col(p) == F.col("_p")), "left").drop("_f", "_p")
    return out.withColumn("reject", F.col("p_holm") <= alpha)


# Two-sided 95 % Student t quantiles for 1 to 30 degrees of freedom.
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def t_975(df: Column) -> Column:
    """Table value up to 30 degrees of freedom, Cornish-Fisher expansion beyond."""
    z = NormalDist().inv_cdf(0.975)
    tail = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    return F.when(df <= len(T_975), F.get(F.array(*[F.lit(t) for t in T_975]), (df - 1).cast("int"))).otherwise(tail)


def corrected_resampled_t(df: DataFrame, *, by: str, delta: str, test_train_ratio: float) -> DataFrame:
    """Nadeau-Bengio interval: repeats share training data, so variance gains n_test/n_train."""
    g = df.groupBy(by).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean"), F.var_samp(delta).alias("_v"))
    se = F.sqrt((1 / F.col("n") + test_train_ratio) * F.col("_v"))
    q = t_975(F.col("n") - 1)
    return g.where("n > 1").select(
        by,
        "n",
        "mean",
        se.alias("se"),
        ratio(F.col("mean"), se).alias("t"),
        (F.col("mean") - q * se).alias("lo"),
        (F.col("mean") + q * se).alias("hi"),
    )


def more_conservative(df: DataFrame, *, lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> DataFrame:
    """Of two intervals of one effect, the outer hull binds."""
    return df.withColumn("lo", F.least(lo_a, lo_b)).withColumn("hi", F.greatest(hi_a, hi_b))


def noise_band(df: DataFrame, *, by: str, arm: str, leader: str, baseline: str, value: str) -> DataFrame:
    """2 sigma of same-config runs, ordinal gate min(leader) > max(baseline), and both margins."""
    pick = lambda f, name: f(F.when(F.col(arm) == name, F.col(value)))
    g = df.groupBy(by).agg(
        (2 * pick(F.stddev_samp, baseline)).alias("band"),
        (pick(F.min, leader) - pick(F.max, baseline)).alias("ordinal_margin"),
        (pick(F.avg, leader) - pick(F.avg, baseline)).alias("delta_mean"),
    )
    return g.withColumn("ordinal_gate", F.col("ordinal_margin") > 0).withColumn(
        "outside_noise", F.abs("delta_mean") > F.col("band")
    )


def required_n(sigma: Column, delta: Column, *, family_size: int, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Pairs needed to see ``delta`` with the given power at the corrected level."""
    z = NormalDist().inv_cdf(1 - alpha / family_size / 2) + NormalDist().inv_cdf(power)
    return F.ceil(F.pow(F.lit(z) * F.try_divide(sigma, delta), F.lit(2.0))).cast("bigint")


def power_class(p: Column, n: Column, n_required: Column, alpha_corrected: float) -> Column:
    """An underpowered null is never evidence of absence."""
    return (
        F.when(n < n_required, "UNDERPOWERED")
        .when(p <= alpha_corrected, "SIGNIFICANT")
        .otherwise("INCONCLUSIVE")
    )


def sign_aware_verdict(delta: Column, p: Column, ci_lo: Column, alpha: float = 0.05) -> Column:
    """SUPPORTED needs significance, a CI above zero and a positive effect."""
    return (
        F.when((p < alpha) & (delta < 0), "FALSIFIED")
        .when((p < alpha) & (ci_lo > 0) & (delta > 0), "SUPPORTED")
        .otherwise("INCONCLUSIVE")
    )


# Clearance verdict texts.
CLEARED = "CLEARED_CONFOUND_BAR"
UNIT_ONLY = "NOT CLEARED (recording-level only; speaker-level CI includes 0)"
NOT_CLEARED = "NOT CLEARED"
UNDERPOWERED_SUFFIX = " | UNDERPOWERED (R6)"


def clearance(unit_lo: Column, group_lo: Column, feasible: Column) -> Column:
    """Does a head clear the confound bar at both grains?"""
    v = F.when((unit_lo > 0) & (group_lo > 0), CLEARED).when(unit_lo > 0, UNIT_ONLY).otherwise(NOT_CLEARED)
    return F.concat(v, F.when(feasible, "").otherwise(UNDERPOWERED_SUFFIX))


def honest_margin(auc: Column, bar: Column) -> Column:
    """Discrimination above the strongest bar, which never counts below chance."""
    return auc - F.greatest(F.lit(0.5), bar)


def best_by(df: DataFrame, *, by: Sequence[str], kind: str, name: str, value: str) -> DataFrame:
    """Winner per (by, kind) on the test metric itself; ties go to the first name."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, kind).agg(
        F.min_by(name, F.struct(-F.col(value), F.col(name))).alias("best"), F.max(value).alias("value"), F.lit("selected on test").alias("note")
    )


def scope_falsifier(cells: DataFrame, *, width: float = 0.01) -> DataFrame:
    """Are all run cells' intervals inside +-width, all scores below the floor, all cells run?"""
    run = F.col("status") == "RUN"
    inside = (F.col("lo") > -width) & (F.col("hi") < width)
    return cells.agg(
        F.count_if(run).alias("cells_run"),
        F.count("*").alias("cells_planned"),
        (F.coalesce(F.bool_and(F.when(run, inside)), F.lit(False))).alias("all_within"),
        (F.count_if(run) == F.count("*")).alias("fully_evaluable"),
    )


def shortcut_falsifier(cells: DataFrame, *, floor: float = 0.60) -> DataFrame:
    run = F.col("status") == "RUN"
    below = F.greatest(F.col("auc"), 1 - F.col("auc")) < floor
    return cells.agg(
        F.count_if(run).alias("cells_run"),
        F.count("*").alias("cells_planned"),
        F.coalesce(F.bool_and(F.when(run, below)), F.lit(False)).alias("all_below_floor"),
        (F.count_if(run) == F.count("*")).alias("fully_evaluable"),
    )


def identity_share(rows: DataFrame, *, auc_full: Column) -> DataFrame:
    """Identity's share of the above-chance headroom over ranks whose CI excludes zero."""
    share = F.when(F.col("excludes_zero"), ratio(F.col("d"), auc_full - 0.5))
    lo = F.min(share)
    return rows.agg(
        F.when(lo.isNotNull(), lo).otherwise(F.raise_error(F.lit("no rank excludes zero"))).alias("share_lo"),
        F.max(share).alias("share_hi"),
        F.count(share).alias("n_ranks"),
    )


def paired_wins(df: DataFrame, *, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Wins of a over b, pairs, and the three means."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(a) > F.col(b)).alias("n_wins"),
        F.count("*").alias("n_pairs"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.avg(F.col(a) - F.col(b)).alias("mean_delta"),
    )


def pooled_repeats(predictions: DataFrame, *, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Mean prediction over the repeats that predicted; missing predictions are not zeros."""
    usable = F.when(F.col(p).isNotNull() & ~F.isnan(p), F.col(p))
    return predictions.groupBy(*keys).agg(F.avg(usable).alias("p"), F.count(usable).alias("n_repeats"))


def rank_average(predictions: DataFrame, members: DataFrame, *, fold: Sequence[str], head: str, unit: str, p: str = "p") -> DataFrame:
    """Mean of rank / n over the chosen heads of each fold.

    Ranks only order units inside one fold, so no calibration metric applies to them.  The average
    rank of a score is (rows below) + (rows tied + 1) / 2, from counts of distinct scores.
    """
    from groupaudit.operators.ranks import bucket_of, quantile_bounds

    bounds = quantile_bounds(predictions, p)
    d = predictions.join(members.select(*fold, head), [*fold, head], "left_semi").where(F.col(p).isNotNull())
    keys = [*fold, head]
    pts = d.groupBy(*keys, p).agg(F.count("*").alias("_n")).withColumn("_b", bucket_of(F.col(p), bounds))
    tot = pts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offs = tot.select(
        *keys, "_b", F.coalesce(F.sum("_bn").over(upto), F.lit(0)).alias("_off"), F.sum("_bn").over(whole).alias("_all")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranks = (
        pts.withColumn("_below", below)
        .join(offs, [*keys, "_b"])
        .select(*keys, p, ((F.col("_off") + F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_all")).alias("_r"))
    )
    return d.join(ranks, [*keys, p]).groupBy(*fold, unit).agg(F.avg("_r").alias("rank_score"), F.count("*").alias("n_members"))


def top_members(inner_auc: DataFrame, *, fold: Sequence[str], head: str, auc: str, n: int = 3) -> DataFrame:
    """The n heads with the best inner (training-only) AUC per fold; heads are a short list."""
    w = Window.partitionBy(*fold).orderBy(F.desc(auc), F.asc(head))
    return inner_auc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


CHANCE = ("auc", "accuracy", "uar", "f1_macro", "r2", "ranking")


def chance_baseline(labels: DataFrame, *, label: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_classes, chance) of a metric from the labels it is evaluated on, whatever their number of classes."""
    if metric not in CHANCE:
        raise ValueError(f"no rule for the chance level of {metric!r}")
    n = labels.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("_n"))
    g = n.groupBy(*by).agg(F.count("*").alias("n_classes"), ratio(F.max("_n"), F.sum("_n")).alias("_top"))
    even = F.lit(1.0) / F.col("n_classes")
    level = {"auc": F.lit(0.5), "accuracy": F.col("_top"), "uar": even, "f1_macro": even, "r2": F.lit(0.0), "ranking": F.lit(0.0)}[metric]
    return g.select(*by, "n_classes", level.alias("chance"))


def shuffle_verdict(scores: DataFrame, *, by: Sequence[str], chance: float | Column = 0.5, tolerance: float = 0.05, real: str = "real", shuffled: str = "shuffled") -> DataFrame:
    """PASS within tolerance of chance, WEAK within five tolerances, FAIL beyond.

    ``chance`` is a number or a column of ``scores`` (``chance_baseline``), the same within a group.
    """
    level = chance if isinstance(chance, Column) else F.lit(float(chance))
    g = scores.groupBy(*by).agg(
        F.max(real).alias("real_score"),
        F.avg(shuffled).alias("shuffled_mean"),
        F.stddev_pop(shuffled).alias("shuffled_std"),
        F.count(shuffled).alias("n_repeats"),
        F.max(level).alias("chance_baseline"),
    )
    gap = F.abs(F.col("shuffled_mean") - F.col("chance_baseline"))
    return g.withColumn("distance", gap).withColumn(
        "verdict", F.when(gap <= tolerance, "PASS").when(gap <= 5 * tolerance, "WEAK").otherwise("FAIL")
    )
