"""Ledger rules: composite score, frontier, promotion, traces, scope and budgets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.operators.ranks import running_before, value_rank
from groupaudit.session import materialise

# Pinned weights and thresholds of the composite.
LAMBDAS = {"disc": 1.0, "cal": 0.5, "sub": 0.75, "xc": 0.6, "leak": 1.0, "ctrl": 3.0}
AUC_FLOOR, ECE_REF, DELTA_SUB, MIN_SUBGROUP_N = 0.60, 0.05, 0.05, 30
STANDARD_RUNG, FULL_RUNG = 3, 4


def composite(df: DataFrame) -> DataFrame:
    """Honest margin minus six one-sided penalties; NULL when the rung's terms are incomplete.

    Needs auc_honest, auc_conf_max, ece, auc_subgroup_min, auc_crosscorpus, auc_leaky,
    auc_negctrl, sigma_null and rung.  Rung 3 leaves the cross-corpus term out by rule and is
    never compared with rung 4.
    """
    c = F.col
    # greatest() skips NULL, so every penalty is nulled explicitly when its input is missing
    pen = lambda lam, x, *needs: F.when(_present(*needs), F.lit(LAMBDAS[lam]) * F.greatest(F.lit(0.0), x))
    d = df.select(
        "*",
        F.when(_present("auc_honest", "auc_conf_max"), c("auc_honest") - F.greatest(F.lit(0.5), "auc_conf_max")).alias("margin"),
        pen("disc", AUC_FLOOR - c("auc_honest"), "auc_honest").alias("t_disc"),
        pen("cal", c("ece") - ECE_REF, "ece").alias("t_cal"),
        pen("sub", c("auc_honest") - c("auc_subgroup_min") - DELTA_SUB, "auc_honest", "auc_subgroup_min").alias("t_sub"),
        pen("xc", c("auc_honest") - c("auc_crosscorpus"), "auc_honest", "auc_crosscorpus").alias("t_xc"),
        pen("leak", c("auc_leaky") - c("auc_honest"), "auc_honest", "auc_leaky").alias("t_leak"),
        pen("ctrl", c("auc_negctrl") - 0.5 - 2 * c("sigma_null"), "auc_negctrl", "sigma_null").alias("t_ctrl"),
    )
    base = c("margin") - c("t_disc") - c("t_cal") - c("t_sub") - c("t_leak") - c("t_ctrl")
    value = F.when(c("rung") == STANDARD_RUNG, base).when(c("rung") >= FULL_RUNG, base - c("t_xc"))
    return d.withColumn("composite", value)


def _present(*cols: str) -> Column:
    out = F.lit(True)
    for x in cols:
        out = out & F.col(x).isNotNull()
    return out


# --- Pareto frontier -------------------------------------------------------------


BLOCK_ROWS, FAN, STRONG_ROWS = 8192, 8, 512  # rows compared at once, blocks merged at once, rows every task knows


def _dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of x some row of ``by`` reaches on every axis and passes on one."""
    out = np.zeros(len(x), bool)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        reaches, passes = np.ones((len(part), len(by)), bool), np.zeros((len(part), len(by)), bool)
        for a in range(x.shape[1]):
            reaches &= by[None, :, a] >= part[:, None, a]
            passes |= by[None, :, a] > part[:, None, a]
        out[lo : lo + 256] = (reaches & passes).any(axis=1)
    return out


def _skyline(x: np.ndarray) -> np.ndarray:
    """Positions of the rows of x that no other row of x dominates."""
    order = np.lexsort(x.T[::-1])[::-1]  # whoever dominates a row stands before it
    kept = order[:0]
    for lo in range(0, len(order), 256):
        part = order[lo : lo + 256]
        part = part[~_dominated(x[part], x[kept])]
        kept = np.concatenate([kept, part[~_dominated(x[part], x[part])]])
    return kept


def _beaten_in_blocks(rows: DataFrame, axes: list[str], blocks: int, fan: int, salt: int) -> DataFrame:
    """Rows beaten inside groups of ``fan`` blocks; blocks of a group meet pairwise, two in a task."""
    own = F.pmod(F.xxhash64(F.lit(salt), *axes), F.lit(blocks)).cast("int")
    first = F.col("own") - F.col("own") % fan
    meet = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(first, F.least(first + (fan - 1), F.lit(blocks - 1)))))
        .select(*axes, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, left = pdf[axes].to_numpy(float), (pdf["own"] == pdf["i"]).to_numpy()
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            beaten = np.setdiff1d(np.arange(len(x)), _skyline(x))
        else:
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            beaten = np.concatenate([a[_dominated(x[a], x[b])], b[_dominated(x[b], x[a])]])
        return pd.DataFrame(x[beaten], columns=axes)

    return meet.groupBy("i", "j").applyInPandas(compare, rows.schema).distinct()


def pareto_frontier(df: DataFrame, *, key: str, axes: Sequence[str], block: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """Rows no other row dominates (all axes larger-is-better); rows with a NULL axis are excluded.

    1. every Arrow batch drops what its own rows and a fixed number of strong rows dominate;
    2. equal rows become one, however many there are;
    3. survivors are merged in a tree: blocks of a group meet pairwise and shrink, until a round takes
       away less than half;
    4. in a last round all blocks that are left meet pairwise, which makes the result exact.

    No task holds more than two blocks.  NaN counts as infinity.
    """
    number = lambda a: F.when(F.isnan(a), F.lit(float("inf"))).otherwise(F.col(a)) + F.lit(0.0)
    complete = df.where(_present(*axes)).select(key, *[F.col(a).cast("double").alias(a) for a in axes])
    xs = [f"x{i}" for i in range(len(axes))]
    points = complete.select(*[number(a).alias(x) for a, x in zip(axes, xs)])
    ends = points.agg(*[f(x).alias(f"{n}_{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max))]).first()
    share = [(F.col(x) - ends[f"lo_{x}"]) / (ends[f"hi_{x}"] - ends[f"lo_{x}"]) for x in xs if ends[f"lo_{x}"] != ends[f"hi_{x}"]]
    best = points.orderBy(sum(share, F.lit(0.0)).desc()).limit(STRONG_ROWS)
    strong = np.array(best.collect(), float).reshape(-1, len(xs))

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf.to_numpy(float)
            x = x[~_dominated(x, strong)]
            yield pd.DataFrame(x[_skyline(x)], columns=xs)

    left = materialise(points.mapInPandas(prune, points.schema).distinct())
    n, salt, shrinking = left.count(), 0, True
    while n:
        blocks = -(-n // block)
        last = blocks <= fan or not shrinking
        beaten = _beaten_in_blocks(left, xs, blocks, blocks if last else fan, salt)
        left = materialise(left.join(beaten, xs, "left_anti"))
        if last:
            break
        before, n, salt = n, left.count(), salt + 1
        shrinking = n < before / 2
    return complete.join(left, [number(a) == F.col(x) for a, x in zip(axes, xs)], "left_semi")


# --- gates and verdicts ------------------------------------------------------------


def promotion_gate(rows: DataFrame, baseline: DataFrame, *, method: str, side_axes: Sequence[str], tolerance: float) -> DataFrame:
    """PROMOTE / DEMOTE / HOLD of every (method, rung) against the rung's baseline row.

    ``baseline`` has rung, primary_base and <axis>_base.  A tie is no promotion; side axes may
    lose at most ``tolerance``; audits must be green, the shuffle test from rung 3 on.  An audit that
    was not made is not green; a row that lacks an axis or its baseline waits (HOLD).
    """
    j = rows.join(baseline, "rung", "left")
    reason = F.when(F.col("primary") <= F.col("primary_base"), "primary axis not strictly above baseline")
    for a in side_axes:
        reason = reason.when(F.col(a) < F.col(f"{a}_base") - tolerance, f"{a} outside tolerance")
    reason = reason.when(~F.coalesce("split_audit_ok", F.lit(False)), "split audit not green").when(
        (F.col("rung") >= STANDARD_RUNG) & ~F.coalesce("shuffle_ok", F.lit(False)), "shuffle test not green"
    )
    axes = ["primary", *side_axes]
    waiting = F.exists(F.array(*[F.col(c).isNull() for a in axes for c in (a, f"{a}_base")]), lambda x: x)
    verdict = (
        F.when(waiting, "HOLD").when(F.col("failure_reason").isNotNull(), "DEMOTE").when(F.col("rung") >= FULL_RUNG, "HOLD").otherwise("PROMOTE")
    )
    return (
        j.withColumn("failure_reason", F.when(~waiting, reason))
        .withColumn("verdict", verdict)
        .select(method, "rung", "primary", *side_axes, "verdict", "failure_reason")
    )


GATES = (
    "manipulation_ok", "orthogonal_ok", "class_direction_collapses", "shuffle_in_band", "variance_matched",
    "effect_excludes_zero", "removed_excludes_chance", "effect_in_noise",
)


def missing_gates() -> Column:
    """Names of the gates that have no result, the reason of an inconclusive verdict; empty if none."""
    return F.concat_ws(",", *[F.when(F.col(g).isNull(), g) for g in GATES])


def claim_verdict() -> Column:
    """Pre-registered outcome over boolean gate columns; the first matching row of the table wins.

    A gate without a result leaves the claim inconclusive.
    """
    c = F.col
    broken = ~(c("manipulation_ok") & c("orthogonal_ok") & c("class_direction_collapses") & c("shuffle_in_band"))
    return (
        F.when(missing_gates() != "", "INCONCLUSIVE")
        .when(broken, "BROKEN")
        .when(~c("variance_matched"), "INCONCLUSIVE")
        .when(c("effect_excludes_zero") & ~c("removed_excludes_chance"), "BREAKS")
        .when(c("effect_excludes_zero"), "ATTENUATED")
        .when(c("effect_in_noise") & c("removed_excludes_chance"), "HOLDS")
        .otherwise("INCONCLUSIVE")
    )


def two_control_gate(df: DataFrame, *, by: str, arm: str, value: str) -> DataFrame:
    """Effect minus a random push of equal size, and minus the inverted signal: both must be positive."""
    pick = lambda n: F.avg(F.when(F.col(arm) == n, F.col(value)))
    g = df.groupBy(by).agg(
        (pick("effect") - pick("random")).alias("delta_vs_random"), (pick("effect") - pick("inverted")).alias("delta_vs_inverted")
    )
    ok = (F.col("delta_vs_random") > 0) & (F.col("delta_vs_inverted") > 0)
    return g.withColumn("verdict", F.when(ok, "EFFECT").when(ok.isNull(), "MISSING CONTROL").otherwise("DISCARD"))


# --- windows over logs ---------------------------------------------------------------


def scope_tag(runs: DataFrame, *, corpus: str, n_groups: str) -> DataFrame:
    """Runs that cover under half of the widest run on their corpus are pilot slices."""
    top = runs.groupBy(corpus).agg(F.max(n_groups).alias("_top"))
    n = F.col(n_groups)
    pilot = (F.col("_top") > 0) & (n > 0) & (n < 0.5 * F.col("_top"))
    return runs.join(top, corpus, "left").withColumn("scope", F.when(pilot, "pilot slice").otherwise("")).drop("_top")


def ladder_marginals(df: DataFrame, *, claim: str, row: str, metric: str) -> DataFrame:
    """Cost of every step: metric minus the metric one row above."""
    d = running_before(df, part=[claim], order=row, tie=row, last={"_prev": metric})
    return d.withColumn("marginal", F.col(metric) - F.col("_prev")).drop("_prev")


def ladder_pattern(marginals: DataFrame, *, claim: str, row: str, single_lift: str | None = None, eps: float = 1e-9) -> DataFrame:
    """reversal / super-additive / sub-additive / additive per claim."""
    m = running_before(marginals.where("marginal IS NOT NULL"), part=[claim], order=row, tie=row, last={"_pm": "marginal"})
    singles = F.sum(single_lift) if single_lift else F.lit(None).cast("double")
    g = m.groupBy(claim).agg(
        F.count("*").alias("n_steps"),
        F.sum("marginal").alias("total_lift"),
        F.min("marginal").alias("_min"),
        F.bool_and(F.coalesce(F.col("marginal") < F.col("_pm") - eps, F.lit(True))).alias("_falling"),
        singles.alias("_singles"),
    )
    pattern = (
        F.when(F.col("_min") < 0, "reversal")
        .when(F.col("total_lift") > F.col("_singles") + eps, "super-additive")
        .when(F.col("_falling") & (F.col("n_steps") > 1), "sub-additive")
        .otherwise("additive")
    )
    return g.select(claim, "n_steps", "total_lift", pattern.alias("pattern"))


def champion_trace(df: DataFrame, *, claim: str, order: str, tie: str, metric: str, seeds: str) -> DataFrame:
    """Rows strictly better than the champion are nominees (>= 3 seeds) or champions (>= 7).

    Only a champion raises the bar: ``best_before`` is the best earlier row with seven seeds.
    """
    confirmed = F.when(F.col(seeds) >= 7, F.col(metric))
    d = running_before(df.withColumn("_m", confirmed), part=[claim], order=order, tie=tie, maxs={"best_before": "_m"})
    better = F.col(metric).isNotNull() & (F.col("best_before").isNull() | (F.col(metric) > F.col("best_before")))
    status = (
        F.when(F.col(seeds) < 3, "EXPLORATION")
        .when(~better, "KEEP OLD")
        .when(F.col(seeds) >= 7, "CHAMPION")
        .otherwise("NOMINEE")
    )
    return d.withColumn("status", status).drop("_m")


def latest_rows(log: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key of an append-only log, with the number of rows it replaces."""
    rest = [c for c in log.columns if c not in key]
    g = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), (F.count("*") - 1).alias("n_replaced"))
    return g.select(*key, "_r.*", "n_replaced").select(*log.columns, "n_replaced")


def halving(df: DataFrame, *, stage: str, candidate: str, metric: str) -> DataFrame:
    """Rank inside a stage; the better half (rounded up) goes on."""
    ranked = value_rank(df, part=[stage], value=metric, tie=candidate, out="rank", ascending=False)
    n = df.groupBy(stage).agg(F.count("*").alias("_n"))
    return ranked.join(n, stage).withColumn("kept", F.col("rank") <= F.ceil(F.col("_n") / 2)).drop("_n")


def slow_rows(df: DataFrame, *, rung: str, elapsed: str, factor: float = 1.5) -> DataFrame:
    """Rows slower than ``factor`` times the median of their rung."""
    from groupaudit.operators.ranks import exact_percentiles

    med = exact_percentiles(df, by=[rung], value=elapsed, qs={"median": 0.5}).drop("n")
    return df.join(med, rung).where(F.col(elapsed) > factor * F.col("median"))


# --- sorts, limits, budgets --------------------------------------------------------------


def smallest(df: DataFrame, *, size: str, key: str, exclude: DataFrame, n: int) -> DataFrame:
    """The n smallest items that are not excluded (a top-n report)."""
    return df.join(exclude.select(key), key, "left_anti").orderBy(size, key).limit(n)


def missing_keys(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Requested keys that do not exist: the caller must refuse a non-empty result."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def sizes_by_date_prefix(files: DataFrame, *, path: str, size: str) -> DataFrame:
    """Totals per leading 8-digit date folder."""
    day = F.regexp_extract(path, r"^(\d{8})/", 1)
    return (
        files.select(day.alias("day"), size).where("day <> ''").groupBy("day").agg(F.sum(size).alias("n_bytes"), F.count("*").alias("n_files"))
    )


def budget_prefix(groups: DataFrame, *, order: str, size: str, budget: float) -> DataFrame:
    """Ordered groups are processed while the total *before* them is under the budget."""
    return running_before(groups, order=order, tie=order, sums={"before": size}).withColumn("processed", F.col("before") < budget)


def newest_first(runs: DataFrame, *, by: str, time: str, tie: str) -> DataFrame:
    """Position of every run inside its hypothesis, newest first."""
    return value_rank(runs, part=[by], value=time, tie=tie, out="position", ascending=False)


def experiment_grid(census: DataFrame, *, corpus: str, features: Sequence[str], available: DataFrame, n_folds: int) -> DataFrame:
    """Every planned (corpus, feature set) cell as RUN or NOT RUN with the reason.

    ``census`` has the planned corpora with n_groups and n_classes (NULL without data);
    ``available`` lists the (corpus, features) pairs that have a table.
    """
    plan = census.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("features"))
    j = plan.join(available.select(corpus, "features").distinct().withColumn("_has", F.lit(True)), [corpus, "features"], "left")
    status = (
        F.when(F.col("_has").isNull() | F.col("n_groups").isNull(), "NOT RUN -- no data")
        .when(F.col("n_groups") < 2 * n_folds, F.concat(F.lit("NOT RUN -- "), F.col("n_groups"), F.lit(" groups")))
        .when(F.col("n_classes") < 2, "NOT RUN -- one class")
        .otherwise("RUN")
    )
    return j.withColumn("status", status).drop("_has")


def grid_summary(grid: DataFrame) -> DataFrame:
    return grid.agg(
        F.count_if(F.col("status") == "RUN").alias("cells_run"),
        F.count("*").alias("cells_planned"),
        (F.count_if(F.col("status") == "RUN") == F.count("*")).alias("falsifier_fully_evaluable"),
    )
