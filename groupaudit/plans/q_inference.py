"""Queries over resampling, tests and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.functions.hashing import (
    LAST_COUNT,
    MODULUS,
    mix_key_sql,
    mixed_sql,
    poisson_count_sql,
    poisson_sql,
    poisson_steps,
    uniform,
    uniform_sql,
)
from groupaudit.operators import inference as inf
from groupaudit.operators import metrics as m
from groupaudit.operators import resampling as rs
from groupaudit.plans import fixtures as fx
from groupaudit.plans.q_metrics import auc_sql, r
from groupaudit.plans.registry import query


def multinomial_sql(source: str, group: str, n_boot: int, seed: int) -> str:
    pick = f"{mixed_sql(str(seed), 'b', 'slot')} * (SELECT count(*) FROM num) // {MODULUS} + 1"
    return f"""num AS (SELECT {group}, row_number() OVER (ORDER BY md5(concat_ws('|', {seed}, {group}))) AS r FROM (SELECT DISTINCT {group} FROM {source})),
  slots AS (SELECT {mix_key_sql(str(seed), 'r')} AS slot FROM num),
  draws AS (SELECT b, CAST({pick} AS BIGINT) AS pick FROM slots, (SELECT unnest(range({n_boot}))::INTEGER AS b)),
  w AS (SELECT b, {group}, CAST(count(*) AS INTEGER) AS w FROM draws JOIN num ON pick = num.r GROUP BY ALL)"""


def poisson_weights_sql(source: str, group: str, n_boot: int, seed: int) -> str:
    return f"""num AS (SELECT {group}, {mix_key_sql(str(seed), group)} AS h FROM (SELECT DISTINCT {group} FROM {source})),
  w AS (SELECT b, {group}, CAST({poisson_count_sql('x')} AS INTEGER) AS w
        FROM (SELECT b, {group}, {mixed_sql(str(seed), 'b', 'h')} AS x FROM num, (SELECT unnest(range({n_boot}))::INTEGER AS b)) WHERE x >= {poisson_steps()[0]})"""


def weighted_auc_sql(points: str, keys: str) -> str:
    """``points`` has keys, s, p_w, n_w (weighted positives and negatives per distinct score)."""
    return f"""SELECT {keys}, sum(p_w * (below + n_w / 2)) / nullif(sum(p_w) * sum(n_w), 0) AS metric FROM (
      SELECT *, coalesce(sum(n_w) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {points}) GROUP BY {keys}"""


def groups(spark, d):
    return fx.scores(spark, d).select("group_id").distinct()


@query(
    "b01_multinomial_weights",
    f"""WITH {fx.SCORES}, num AS (SELECT group_id, row_number() OVER (ORDER BY md5(concat_ws('|', 1, group_id))) AS r FROM (SELECT DISTINCT group_id FROM scores)),
  draws AS (SELECT b, CAST(floor({uniform_sql('1', 'b', 'r')} * (SELECT count(*) FROM num)) + 1 AS BIGINT) AS pick FROM num, (SELECT unnest(range(50))::INTEGER AS b)),
  w AS (SELECT b, group_id, CAST(count(*) AS INTEGER) AS w FROM draws JOIN num ON pick = num.r GROUP BY ALL) SELECT * FROM w""",
)
def b01(spark, d):
    return rs.independent_multinomial_weights(groups(spark, d), group="group_id", n_boot=50, seed=1)


@query(
    "b01_poisson_weights",
    f"""WITH {fx.SESSIONS}, g AS (SELECT DISTINCT speaker_id FROM sessions), u AS (SELECT b, speaker_id, {uniform_sql('1', 'b', 'speaker_id')} AS u
        FROM g, (SELECT unnest(range(40))::INTEGER AS b)), w AS (SELECT b, speaker_id, CAST({poisson_sql('u', LAST_COUNT)} AS INTEGER) AS w FROM u)
    SELECT * FROM w WHERE w > 0""",
)
def b01_poisson(spark, d):
    g = fx.sessions(spark, d).select("speaker_id").distinct()
    return rs.independent_poisson_weights(g, group="speaker_id", n_boot=40, seed=1).select("b", "speaker_id", "w")


N_BOOT = 2000  # the protocol's number of replicates


def boot_sql(weights: str, score: str) -> str:
    """Replicates of the AUC: equal scores of a group collapse before its weights meet them."""
    return f"""{weights},
  cells AS (SELECT group_id, {score} AS s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM scores GROUP BY ALL),
  pts AS (SELECT b, s, sum(w * p) AS p_w, sum(w * n) AS n_w FROM cells JOIN w USING (group_id) GROUP BY ALL),
  reps AS ({weighted_auc_sql('pts', 'b')})"""


def ci_sql(score: str, weights: str) -> str:
    return f"""WITH {fx.SCORES}, {boot_sql(weights, score)}
    SELECT round(quantile_cont(metric, 0.025), 9) AS lo, round(quantile_cont(metric, 0.975), 9) AS hi, count(metric) AS n_boot FROM reps"""


def auc_interval(spark, d, score, n_boot, scheme="poisson"):
    draw = rs.cluster_weights(groups(spark, d), group="group_id", n_boot=n_boot, seed=1, scheme=scheme)
    reps = rs.replicates(fx.scores(spark, d), draw, group="group_id", score=score, label="y")
    return rs.percentile_ci(reps).select(r("lo", 9), r("hi", 9), "n_boot")


@query("b02_cluster_bootstrap_auc", ci_sql("p", poisson_weights_sql("scores", "group_id", N_BOOT, 1)))
def b02(spark, d):
    return auc_interval(spark, d, "p", N_BOOT)


@query("b02_continuous_score", ci_sql("raw", poisson_weights_sql("scores", "group_id", N_BOOT, 1)))
def b02_continuous(spark, d):
    """A score with hardly any ties: nothing collapses."""
    return auc_interval(spark, d, "raw", N_BOOT)


@query("b02_multinomial_bootstrap_auc", ci_sql("p", multinomial_sql("scores", "group_id", N_BOOT, 1)))
def b02_multinomial(spark, d):
    return auc_interval(spark, d, "p", N_BOOT, "multinomial")


@query(
    "b02_bootstrap_uar_ece_brier",
    f"""WITH {fx.SCORES}, {poisson_weights_sql('scores', 'group_id', N_BOOT, 1)},
      cells AS (SELECT group_id, y, p, count(*)::DOUBLE AS c FROM scores GROUP BY ALL),
      j AS (SELECT b, y, p, sum(w * c) AS w FROM cells JOIN w USING (group_id) GROUP BY ALL),
      u AS (SELECT b, 'uar' AS metric_name, (sum(w) FILTER (y = 1 AND p >= 0.5) / sum(w) FILTER (y = 1) + sum(w) FILTER (y = 0 AND p < 0.5) / sum(w) FILTER (y = 0)) / 2 AS v FROM j GROUP BY b),
      e0 AS (SELECT b, least(floor(p * 15), 14) AS bin, sum(w) AS n, sum(w * y) AS a, sum(w * p) AS c FROM j GROUP BY ALL),
      e AS (SELECT b, 'ece' AS metric_name, sum(abs(a - c)) / sum(n) AS v FROM e0 GROUP BY b),
      br AS (SELECT b, 'brier' AS metric_name, sum(w * (p - y) ** 2) / sum(w) AS v FROM j GROUP BY b),
      reps AS (SELECT * FROM u UNION ALL SELECT * FROM e UNION ALL SELECT * FROM br)
    SELECT metric_name, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(v) AS n_boot FROM reps GROUP BY 1""",
)
def b02_other(spark, d):
    draw = rs.cluster_weights(groups(spark, d), group="group_id", n_boot=N_BOOT, seed=1)
    out = None
    for name in ("uar", "ece", "brier"):
        reps = rs.replicates(fx.scores(spark, d), draw, group="group_id", score="p", label="y", metric=name)
        row = rs.percentile_ci(reps).select(F.lit(name).alias("metric_name"), r("lo"), r("hi"), "n_boot")
        out = row if out is None else out.unionByName(row)
    return out


_REPEATS = f"""{fx.SESSIONS}, vals AS (SELECT archive AS study, year(recorded) AS yr, avg(duration) / 1000 - 250 AS v FROM sessions GROUP BY ALL)"""


def repeat_values(spark, d):
    """One value per (study, repeat): segments as studies, order years as repeats."""
    s = fx.sessions(spark, d)
    return s.groupBy(F.col("archive").alias("study"), F.year("recorded").alias("yr")).agg((F.avg("duration") / 1000 - 250).alias("v"))


@query(
    "b03_bootstrap_mean",
    f"""WITH {_REPEATS}, a AS (SELECT study, list(v ORDER BY yr) AS vs, count(*) AS n FROM vals GROUP BY 1),
      dr AS (SELECT study, b, avg(vs[CAST(floor({uniform_sql('2', 'b', 'i')} * n) AS INTEGER) + 1]) AS metric
             FROM a, (SELECT unnest(range(10000)) AS b), (SELECT unnest(range(50)) AS i) WHERE i < n GROUP BY ALL),
      ci AS (SELECT study, quantile_cont(metric, 0.025) AS lo, quantile_cont(metric, 0.975) AS hi, count(*) AS n_boot FROM dr GROUP BY 1)
    SELECT study, round(avg(v), 6) AS mean, count(*) AS n_repeats, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, any_value(n_boot) AS n_boot,
           any_value(lo > 0 OR hi < 0) AS excludes_zero FROM vals JOIN ci USING (study) GROUP BY study""",
)
def b03(spark, d):
    out = rs.bootstrap_mean(repeat_values(spark, d), study="study", order="yr", value="v", seed=2)
    return out.select("study", r("mean"), "n_repeats", r("lo"), r("hi"), "n_boot", "excludes_zero")


_PAIRED = f"""{fx.SCORES}, {poisson_weights_sql('scores', 'group_id', N_BOOT, 3)},
  long AS (SELECT group_id, y, 'a' AS side, p AS s FROM scores UNION ALL SELECT group_id, y, 'b', p2 FROM scores),
  cells AS (SELECT group_id, side, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM long GROUP BY ALL),
  pts AS (SELECT b, side, s, sum(w * p) AS p_w, sum(w * n) AS n_w FROM cells JOIN w USING (group_id) GROUP BY ALL),
  reps AS ({weighted_auc_sql('pts', 'b, side')}),
  dl AS (SELECT b, max(metric) FILTER (side = 'a') - max(metric) FILTER (side = 'b') AS metric FROM reps GROUP BY b),
  pt AS ({auc_sql('long', 's', 'y', 'side')})"""


@query(
    "b04_paired_bootstrap_delta",
    f"""WITH {_PAIRED} SELECT round(quantile_cont(metric, 0.025), 9) AS lo, round(quantile_cont(metric, 0.975), 9) AS hi,
      round(count(*) FILTER (metric > 0) / count(metric), 9) AS p_gt_zero, count(metric) AS n_boot,
      round((SELECT max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b') FROM pt), 9) AS delta FROM dl""",
)
def b04(spark, d):
    w = rs.cluster_weights(groups(spark, d), group="group_id", n_boot=N_BOOT, seed=3)
    out = rs.paired_bootstrap(fx.scores(spark, d), w, group="group_id", label="y", a="p", b="p2")
    return out.select(r("lo", 9), r("hi", 9), r("p_gt_zero", 9), "n_boot", r("delta", 9))


_WIL = f"""{_REPEATS}, prs AS (SELECT study, yr, v AS a, (SELECT avg(v) FROM vals) + (yr - 1998) * 0.25 AS b FROM vals),
  df AS (SELECT study, round(a - b, 6) AS d FROM prs), nz AS (SELECT study, d, rank() OVER (PARTITION BY study ORDER BY abs(d)) + (count(*) OVER (PARTITION BY study, abs(d)) - 1) / 2 AS rk FROM df WHERE d <> 0),
  st AS (SELECT study, list(rk) AS rks, count(*) AS n, least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0)) AS w0, sum(rk) AS tot,
         coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm FROM nz GROUP BY 1),
  masks AS (SELECT study, mask, coalesce(sum(rks[i]) FILTER ((mask >> (i - 1)) & 1 = 1), 0) AS wsum FROM st, (SELECT unnest(range(65536)) AS mask), (SELECT unnest(range(1, 17)) AS i)
            WHERE mask < (1 << CAST(n AS INTEGER)) AND i <= n GROUP BY ALL)"""


@query(
    "b05_wilcoxon_exact",
    f"""WITH {_WIL} SELECT study, any_value(n) AS n_nonzero, any_value(least(wp, wm)) AS statistic,
      round(least(1, 2.0::DOUBLE * count(*) FILTER (wsum <= least(wp, wm)) / count(*)), 9) AS p_value FROM st JOIN masks USING (study) GROUP BY study""",
)
def b05(spark, d):
    v = repeat_values(spark, d)
    ref = v.agg(F.avg("v")).scalar() + (F.col("yr") - 1998) * 0.25
    pairs = v.select("study", F.round(F.col("v") - ref, 6).alias("a"), F.lit(0.0).alias("b"))
    return rs.wilcoxon_exact(pairs, family="study", a="a", b="b").withColumn("p_value", r("p_value", 9))


@query(
    "b06_power_check",
    """WITH g AS (SELECT c_nationkey, CAST(count(*) % 14 AS INTEGER) AS n, CAST(count(DISTINCT c_mktsegment) * (c_nationkey % 4 + 1) AS INTEGER) AS m FROM customer GROUP BY 1)
    SELECT c_nationkey, n, m, CASE WHEN n > 0 THEN 2 / 2.0::DOUBLE ** n ELSE 1.0::DOUBLE END AS min_attainable_p, round(0.05::DOUBLE / m, 9) AS holm_tightest,
      CASE WHEN n > 0 THEN 2 / 2.0::DOUBLE ** n ELSE 1.0 END <= 0.05::DOUBLE / m AS feasible,
      CAST((SELECT min(k) FROM (SELECT unnest(range(1, 65)) AS k) WHERE 2 / 2.0::DOUBLE ** k <= 0.05::DOUBLE / m) AS INTEGER) AS min_n FROM g""",
)
def b06(spark, d):
    c = fx.table(spark, d, "customer")
    g = c.groupBy("c_nationkey").agg(
        (F.count("*") % 14).cast("int").alias("n"),
        (F.count_distinct("c_mktsegment") * (F.first("c_nationkey") % 4 + 1)).cast("int").alias("m"),
    )
    return g.select("c_nationkey", "n", "m", *inf.power_columns(F.col("n"), F.col("m"))).withColumn("holm_tightest", r("holm_tightest", 9))


_P = f"pv AS (SELECT c_custkey, c_nationkey, round({uniform_sql('5', 'c_custkey')} ** 3, 9) AS p FROM customer)"


def p_values(spark, d):
    u = uniform(5, "c_custkey")
    return fx.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.round(F.pow(u, F.lit(3.0)), 9).alias("p"))


@query(
    "b07_holm",
    f"""WITH {_P}, s AS (SELECT *, p * (count(*) OVER (PARTITION BY c_nationkey) - row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) + 1) AS st FROM pv),
      h AS (SELECT c_custkey, c_nationkey, p, least(1.0::DOUBLE, max(st) OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey ROWS UNBOUNDED PRECEDING)) AS p_holm FROM s)
    SELECT c_custkey, c_nationkey, p, round(p_holm, 9) AS p_holm, p_holm <= 0.05 AS reject FROM h""",
)
def b07(spark, d):
    return inf.holm(p_values(spark, d), family="c_nationkey", p="p", tie="c_custkey").withColumn("p_holm", r("p_holm", 9))


@query("b08_bca_interval", f"SELECT TRUE AS brackets, TRUE AS near_percentiles, CAST({N_BOOT} AS BIGINT) AS n_boot")
def b08(spark, d):
    s = fx.scores(spark, d)
    w = rs.cluster_weights(groups(spark, d), group="group_id", n_boot=N_BOOT, seed=1)
    bca = rs.bca_interval(s, w, group="group_id", score="p", label="y")
    plain = rs.percentile_ci(rs.replicates(s, w, group="group_id", score="p", label="y")).first()
    wide = plain["hi"] - plain["lo"]
    near = (F.abs(F.col("lo") - plain["lo"]) < wide / 2) & (F.abs(F.col("hi") - plain["hi"]) < wide / 2)
    return bca.select(F.col("theta").between(F.col("lo"), F.col("hi")).alias("brackets"), near.alias("near_percentiles"), "n_boot")


def _loo_sql() -> str:
    return f"""WITH {fx.SCORES}, g AS (SELECT DISTINCT group_id FROM scores),
      pts AS (SELECT g.group_id AS gid, p AS s, sum(y)::DOUBLE AS p_w, sum(1 - y)::DOUBLE AS n_w FROM g JOIN scores ON scores.group_id <> g.group_id GROUP BY ALL)
    SELECT gid AS group_id, round(metric, 9) AS auc_without FROM ({weighted_auc_sql('pts', 'gid')})"""


@query("b08_jackknife_auc", _loo_sql())
def b08_jack(spark, d):
    out = rs.jackknife_auc(fx.scores(spark, d), group="group_id", score="p", label="y")
    return out.select("group_id", r("auc_without", 9))


@query(
    "b09_corrected_resampled_t",
    f"""WITH {_REPEATS}, g AS (SELECT study, count(*) AS n, avg(v) AS mean, sqrt((1 / count(*) + 0.25) * var_samp(v)) AS se FROM vals GROUP BY 1),
      q AS (SELECT *, {list(inf.T_975)}[n - 1]::DOUBLE AS q FROM g)
    SELECT study, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 6) AS t, round(mean - q * se, 6) AS lo, round(mean + q * se, 6) AS hi FROM q""",
)
def b09(spark, d):
    out = inf.corrected_resampled_t(repeat_values(spark, d), by="study", delta="v", test_train_ratio=0.25)
    return out.select("study", "n", r("mean"), r("se"), r("t"), r("lo"), r("hi"))


_ARMS = f"{fx.SESSIONS}, arms AS (SELECT archive AS claim, CASE WHEN y = 1 THEN 'leader' ELSE 'baseline' END AS arm, year(recorded) AS yr, avg(age) AS v FROM sessions GROUP BY ALL)"


def arms(spark, d):
    arm = F.when(F.col("y") == 1, "leader").otherwise("baseline").alias("arm")
    return fx.sessions(spark, d).groupBy(F.col("archive").alias("claim"), arm, F.year("recorded").alias("yr")).agg(F.avg("age").alias("v"))


@query(
    "b10_noise_band",
    f"""WITH {_ARMS} SELECT claim, round(2 * stddev_samp(v) FILTER (arm = 'baseline'), 6) AS band,
      round(min(v) FILTER (arm = 'leader') - max(v) FILTER (arm = 'baseline'), 6) AS ordinal_margin,
      round(avg(v) FILTER (arm = 'leader') - avg(v) FILTER (arm = 'baseline'), 6) AS delta_mean,
      min(v) FILTER (arm = 'leader') > max(v) FILTER (arm = 'baseline') AS ordinal_gate,
      abs(avg(v) FILTER (arm = 'leader') - avg(v) FILTER (arm = 'baseline')) > 2 * stddev_samp(v) FILTER (arm = 'baseline') AS outside_noise FROM arms GROUP BY 1""",
)
def b10(spark, d):
    out = inf.noise_band(arms(spark, d), by="claim", arm="arm", leader="leader", baseline="baseline", value="v")
    return out.select("claim", r("band"), r("ordinal_margin"), r("delta_mean"), "ordinal_gate", "outside_noise")


_EFFECTS = """ef AS (SELECT c.c_custkey, c_nationkey, count(*) AS n, avg(o_totalprice) / 250000 - 1 AS delta, stddev_samp(o_totalprice) / 250000 AS sigma
   FROM orders o JOIN customer c ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) > 1)"""
_Z = inf.NormalDist().inv_cdf(1 - 0.05 / 25 / 2) + inf.NormalDist().inv_cdf(0.8)


def effects(spark, d):
    o = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_custkey", "c_nationkey").agg(
        F.count("*").alias("n"),
        (F.avg("o_totalprice") / 250000 - 1).alias("delta"),
        (F.stddev_samp("o_totalprice") / 250000).alias("sigma"),
    ).where("n > 1")


@query(
    "b11_power_class",
    f"""WITH {_EFFECTS}, {_P}, x AS (SELECT ef.*, p, CAST(ceil(({_Z!r}::DOUBLE * sigma / 0.5) ** 2) AS BIGINT) AS n_required FROM ef JOIN pv USING (c_custkey))
    SELECT c_custkey, n_required, CASE WHEN n < n_required THEN 'UNDERPOWERED' WHEN p <= 0.05::DOUBLE / 25 THEN 'SIGNIFICANT' ELSE 'INCONCLUSIVE' END AS power_class FROM x""",
)
def b11(spark, d):
    x = effects(spark, d).join(p_values(spark, d).select("c_custkey", "p"), "c_custkey")
    x = x.withColumn("n_required", inf.required_n(F.col("sigma"), F.lit(0.5), family_size=25))
    cls = inf.power_class(F.col("p"), F.col("n"), F.col("n_required"), 0.05 / 25)
    return x.select("c_custkey", "n_required", cls.alias("power_class"))


@query(
    "b12_sign_aware_verdict",
    f"""WITH {_EFFECTS}, {_P}, x AS (SELECT c_custkey, delta, p, delta - 1.96 * sigma / sqrt(n) AS lo FROM ef JOIN pv USING (c_custkey))
    SELECT c_custkey, CASE WHEN p < 0.05 AND delta < 0 THEN 'FALSIFIED' WHEN p < 0.05 AND lo > 0 AND delta > 0 THEN 'SUPPORTED' ELSE 'INCONCLUSIVE' END AS verdict FROM x""",
)
def b12(spark, d):
    x = effects(spark, d).join(p_values(spark, d).select("c_custkey", "p"), "c_custkey")
    lo = F.col("delta") - 1.96 * F.col("sigma") / F.sqrt("n")
    return x.select("c_custkey", inf.sign_aware_verdict(F.col("delta"), F.col("p"), lo).alias("verdict"))


_CELLS = f"""{fx.SESSIONS}, cells AS (SELECT archive, task, CASE WHEN count(*) < 500 THEN 'NOT RUN' ELSE 'RUN' END AS status,
   (avg(age) - 50) / 1000 - 0.004 AS lo, (avg(age) - 50) / 1000 + 0.004 AS hi, 0.5 + (avg(age) - 50) / 20 AS auc FROM sessions GROUP BY ALL)"""


def falsifier_cells(spark, d):
    c = fx.sessions(spark, d).groupBy("archive", "task").agg(F.count("*").alias("n"), F.avg("age").alias("m"))
    shift = (F.col("m") - 50) / 1000
    return c.select(
        "archive", "task", F.when(F.col("n") < 500, "NOT RUN").otherwise("RUN").alias("status"),
        (shift - 0.004).alias("lo"), (shift + 0.004).alias("hi"), (0.5 + (F.col("m") - 50) / 20).alias("auc"),
    )


@query(
    "b14_scope_falsifier",
    f"""WITH {_CELLS} SELECT count(*) FILTER (status = 'RUN') AS cells_run, count(*) AS cells_planned,
      coalesce(bool_and(lo > -0.01 AND hi < 0.01) FILTER (status = 'RUN'), false) AS all_within, count(*) FILTER (status = 'RUN') = count(*) AS fully_evaluable FROM cells""",
)
def b14_scope(spark, d):
    return inf.scope_falsifier(falsifier_cells(spark, d))


@query(
    "b14_shortcut_falsifier",
    f"""WITH {_CELLS} SELECT count(*) FILTER (status = 'RUN') AS cells_run, count(*) AS cells_planned,
      coalesce(bool_and(greatest(auc, 1 - auc) < 0.60) FILTER (status = 'RUN'), false) AS all_below_floor, count(*) FILTER (status = 'RUN') = count(*) AS fully_evaluable FROM cells""",
)
def b14_shortcut(spark, d):
    return inf.shortcut_falsifier(falsifier_cells(spark, d))


# --- heads and confounds as one long prediction table ---------------------------

_HEADS = (("audio", "quantity", "l_quantity / 50"), ("audio", "line", "l_linenumber / 7"), ("audio", "discount", "l_discount * 10"), ("confound", "tax", "l_tax * 12"), ("confound", "month", "month(l_shipdate) / 12"))
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{h}' AS head, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_id, l_suppkey AS group_id, "
    f"CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {e} AS s FROM lineitem"
    for k, h, e in _HEADS
) + ")"


def long_predictions(spark, d):
    li = fx.table(spark, d, "lineitem")
    heads = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(h).alias("head"), F.expr(e).alias("s")) for k, h, e in _HEADS])
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"),
        F.col("l_suppkey").alias("group_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.explode(heads).alias("_h"),
    ).select("_h.kind", "_h.head", "unit_id", "group_id", "y", "_h.s")


@query(
    "l04_best_head_and_bar",
    f"""WITH {_LONG}, a AS ({auc_sql('long', 's', 'y', 'kind, head')})
    SELECT kind, head AS best, round(auc, 9) AS value, 'selected on test' AS note FROM a QUALIFY row_number() OVER (PARTITION BY kind ORDER BY auc DESC, head) = 1""",
)
def l04(spark, d):
    auc = m.roc_auc(long_predictions(spark, d), score="s", label="y", by=["kind", "head"])
    return inf.best_by(auc, by=[], kind="kind", name="head", value="auc").withColumn("value", r("value", 9))


def _margin_sql(grain: str) -> str:
    """Paired deltas of every audio head against the best confound at one grain."""
    src = "long" if grain == "unit" else "glong"
    pre = f"{grain}_"
    return f"""
  {pre}pairs AS (SELECT a.head, a.group_id, a.y, a.s AS sa, c.s AS sb FROM {src} a JOIN {src} c USING (unit_id) WHERE a.kind = 'audio' AND c.head = (SELECT bar FROM best)),
  {pre}sides AS (SELECT head, group_id, y, 'a' AS side, sa AS s FROM {pre}pairs UNION ALL SELECT head, group_id, y, 'b', sb FROM {pre}pairs),
  {pre}cells AS (SELECT head, side, group_id, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM {pre}sides GROUP BY ALL),
  {pre}pts AS (SELECT head, b, side, s, sum(w * p) AS p_w, sum(w * n) AS n_w FROM {pre}cells JOIN w USING (group_id) GROUP BY ALL),
  {pre}reps AS ({weighted_auc_sql(pre + 'pts', 'head, b, side')}),
  {pre}d AS (SELECT head, b, max(metric) FILTER (side = 'a') - max(metric) FILTER (side = 'b') AS m FROM {pre}reps GROUP BY ALL),
  {pre}pt AS ({auc_sql(pre + 'sides', 's', 'y', 'head, side')}),
  {pre}ci AS (SELECT head, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM {pre}d GROUP BY 1),
  {pre}delta AS (SELECT head, max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b') AS delta FROM {pre}pt GROUP BY 1)"""


@query(
    "b13_margin_and_clearance",
    f"""WITH {_LONG}, {poisson_weights_sql('long', 'group_id', N_BOOT, 6)}, au AS ({auc_sql('long', 's', 'y', 'kind, head')}),
      best AS (SELECT head AS bar FROM au WHERE kind = 'confound' ORDER BY auc DESC, head LIMIT 1),
      glong AS (SELECT kind, head, group_id AS unit_id, group_id, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS y, round(avg(s), 9) AS s FROM long GROUP BY ALL),
      {_margin_sql('unit')}, {_margin_sql('group')}
    SELECT u.head, (SELECT bar FROM best) AS bar, round(ud.delta, 9) AS unit_delta, round(u.lo, 9) AS unit_lo, round(u.hi, 9) AS unit_hi,
      round(gd.delta, 9) AS group_delta, round(g.lo, 9) AS group_lo, round(g.hi, 9) AS group_hi,
      CASE WHEN u.lo > 0 AND g.lo > 0 THEN '{inf.CLEARED}' WHEN u.lo > 0 THEN '{inf.UNIT_ONLY}' ELSE '{inf.NOT_CLEARED}' END || '{inf.UNDERPOWERED_SUFFIX}' AS verdict
    FROM unit_ci u JOIN unit_delta ud USING (head) JOIN group_ci g USING (head) JOIN group_delta gd USING (head)""",
)
def b13(spark, d):
    from groupaudit.plans.studies import margins

    long = long_predictions(spark, d)
    w = rs.cluster_weights(groups(spark, d), group="group_id", n_boot=N_BOOT, seed=6)
    out = margins(long, w, n_repeats=3)
    return out.select("head", "bar", *[r(f"{g}_{c}", 9) for g in ("unit", "group") for c in ("delta", "lo", "hi")], "verdict")


@query(
    "w07_rank_average",
    f"""WITH {_LONG}, t AS (SELECT *, (rank() OVER (PARTITION BY head ORDER BY s) + (count(*) OVER (PARTITION BY head, s) - 1) / 2) / count(*) OVER (PARTITION BY head) AS rk
        FROM long WHERE kind = 'audio')
    SELECT 0 AS fold, unit_id, round(avg(rk), 9) AS rank_score, count(*) AS n_members FROM t GROUP BY unit_id""",
)
def w07(spark, d):
    long = long_predictions(spark, d).where("kind = 'audio'").withColumn("fold", F.lit(0))
    auc = m.roc_auc(long, score="s", label="y", by=["fold", "head"])
    members = inf.top_members(auc, fold=["fold"], head="head", auc="auc")
    out = inf.rank_average(long, members, fold=["fold"], head="head", unit="unit_id", p="s")
    return out.withColumn("rank_score", r("rank_score", 9))


@query(
    "a25_wins_and_means",
    f"""WITH {_ARMS}, p AS (SELECT claim, yr, max(v) FILTER (arm = 'leader') AS a, max(v) FILTER (arm = 'baseline') AS b FROM arms GROUP BY ALL)
    SELECT claim, count(*) FILTER (a > b) AS n_wins, count(*) AS n_pairs, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS mean_delta FROM p GROUP BY 1""",
)
def a25(spark, d):
    v = arms(spark, d)
    p = v.groupBy("claim", "yr").agg(*[F.max(F.when(F.col("arm") == n, F.col("v"))).alias(c) for n, c in (("leader", "a"), ("baseline", "b"))])
    return inf.paired_wins(p, by=["claim"], a="a", b="b").select("claim", "n_wins", "n_pairs", r("mean_a"), r("mean_b"), r("mean_delta"))


@query(
    "a24_identity_share",
    f"""WITH {_REPEATS}, k AS (SELECT yr AS k, avg(v) / 100 AS d, yr % 3 <> 0 AS ex FROM vals GROUP BY yr)
    SELECT round(min(d / 0.2382) FILTER (ex), 6) AS share_lo, round(max(d / 0.2382) FILTER (ex), 6) AS share_hi, count(*) FILTER (ex) AS n_ranks FROM k""",
)
def a24(spark, d):
    rows = repeat_values(spark, d).groupBy("yr").agg((F.avg("v") / 100).alias("d")).withColumn("excludes_zero", F.col("yr") % 3 != 0)
    return inf.identity_share(rows, auc_full=F.lit(0.7382)).select(r("share_lo"), r("share_hi"), "n_ranks")


@query(
    "m07_pooled_repeats",
    """SELECT concat_ws('-', l_orderkey, l_suppkey) AS unit_id, round(avg(CASE WHEN l_tax > 0 THEN l_discount * 10 END), 9) AS p,
      count(*) FILTER (l_tax > 0) AS n_repeats FROM lineitem GROUP BY 1""",
)
def m07(spark, d):
    li = fx.table(spark, d, "lineitem")
    p = F.when(F.col("l_tax") > 0, F.col("l_discount") * 10).otherwise(float("nan"))
    preds = li.select(F.concat_ws("-", "l_orderkey", "l_suppkey").alias("unit_id"), p.alias("p"))
    return inf.pooled_repeats(preds, keys=["unit_id"]).withColumn("p", r("p", 9))


@query(
    "m07_per_repeat_auc",
    f"""WITH {fx.SCORES}, a AS ({auc_sql('scores', 'p2', 'y', 'task')})
    SELECT round(avg(auc), 9) AS auc_mean, round(stddev_pop(auc), 9) AS auc_std, count(auc) AS n_repeats FROM a""",
)
def m07_auc(spark, d):
    auc = m.roc_auc(fx.scores(spark, d), score="p2", label="y", by=["task"])
    return auc.agg(F.round(F.avg("auc"), 9).alias("auc_mean"), F.round(F.stddev_pop("auc"), 9).alias("auc_std"), F.count("auc").alias("n_repeats"))


@query(
    "m25_shuffle_verdict",
    f"""WITH {_ARMS} SELECT claim, round(max(v) / 60, 6) AS real_score, round(avg(v / 100), 6) AS shuffled_mean, round(stddev_pop(v / 100), 6) AS shuffled_std, count(*) AS n_repeats,
      round(abs(avg(v / 100) - 0.5), 6) AS distance,
      CASE WHEN abs(avg(v / 100) - 0.5) <= 0.0004 THEN 'PASS' WHEN abs(avg(v / 100) - 0.5) <= 0.002 THEN 'WEAK' ELSE 'FAIL' END AS verdict FROM arms GROUP BY 1""",
)
def m25_verdict(spark, d):
    s = arms(spark, d).select("claim", (F.col("v") / 60).alias("real"), (F.col("v") / 100).alias("shuffled"))
    out = inf.shuffle_verdict(s, by=["claim"], tolerance=0.0004)
    return out.select("claim", r("real_score"), r("shuffled_mean"), r("shuffled_std"), "n_repeats", r("distance"), "verdict")
