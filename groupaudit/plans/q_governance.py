"""Queries over ledger rules, logs, sorts and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.operators import governance as gov
from groupaudit.plans import fixtures as fx
from groupaudit.plans.q_metrics import r
from groupaudit.plans.registry import query

_RUNS = """runs AS (SELECT l_suppkey, CAST(l_suppkey % 5 AS INTEGER) AS rung, avg(l_quantity) / 50 + 0.15::DOUBLE AS auc_honest, avg(l_discount) * 11 AS auc_conf_max, avg(l_tax) * 2 AS ece,
    min(l_quantity) / 50 + 0.5::DOUBLE AS auc_subgroup_min, CASE WHEN l_suppkey % 7 <> 0 THEN avg(l_linenumber) / 7 END AS auc_crosscorpus,
    max(l_discount) + 0.6::DOUBLE AS auc_leaky, 0.5::DOUBLE + avg(l_tax) AS auc_negctrl, stddev_pop(l_tax) / 2 AS sigma_null FROM lineitem GROUP BY 1)"""


def runs(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(
        (F.first("l_suppkey") % 5).cast("int").alias("rung"),
        (F.avg("l_quantity") / 50 + 0.15).alias("auc_honest"),
        (F.avg("l_discount") * 11).alias("auc_conf_max"),
        (F.avg("l_tax") * 2).alias("ece"),
        (F.min("l_quantity") / 50 + 0.5).alias("auc_subgroup_min"),
        F.when(F.first("l_suppkey") % 7 != 0, F.avg("l_linenumber") / 7).alias("auc_crosscorpus"),
        (F.max("l_discount") + 0.6).alias("auc_leaky"),
        (0.5 + F.avg("l_tax")).alias("auc_negctrl"),
        (F.stddev_pop("l_tax") / 2).alias("sigma_null"),
    )


@query(
    "b15_composite",
    f"""WITH {_RUNS}, t AS (SELECT l_suppkey, rung, auc_honest - greatest(0.5::DOUBLE, auc_conf_max) AS margin, greatest(0, 0.6::DOUBLE - auc_honest) AS t_disc,
        0.5::DOUBLE * greatest(0, ece - 0.05::DOUBLE) AS t_cal, 0.75::DOUBLE * greatest(0, auc_honest - auc_subgroup_min - 0.05::DOUBLE) AS t_sub,
        CASE WHEN auc_crosscorpus IS NOT NULL THEN 0.6::DOUBLE * greatest(0, auc_honest - auc_crosscorpus) END AS t_xc,
        greatest(0, auc_leaky - auc_honest) AS t_leak, 3::DOUBLE * greatest(0, auc_negctrl - 0.5::DOUBLE - 2 * sigma_null) AS t_ctrl FROM runs)
    SELECT l_suppkey, rung, round(margin, 6) AS margin, round(t_leak, 6) AS t_leak, round(t_ctrl, 6) AS t_ctrl,
      round(CASE WHEN rung = 3 THEN margin - t_disc - t_cal - t_sub - t_leak - t_ctrl WHEN rung >= 4 THEN margin - t_disc - t_cal - t_sub - t_xc - t_leak - t_ctrl END, 6) AS composite FROM t""",
)
def b15(spark, d):
    return gov.composite(runs(spark, d)).select("l_suppkey", "rung", r("margin"), r("t_leak"), r("t_ctrl"), r("composite"))


_AXES = """ax AS (SELECT o_custkey, round(avg(o_totalprice) / 1000, 10) AS a1, CAST(count(*) AS DOUBLE) AS a2, CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE round(-min(o_totalprice) / 1000, 4) END AS a3 FROM orders GROUP BY 1)"""


@query(
    "b17_pareto_frontier",
    f"""WITH {_AXES}, c AS (SELECT * FROM ax WHERE a3 IS NOT NULL)
    SELECT o_custkey, a1, a2, a3 FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.a1 >= x.a1 AND y.a2 >= x.a2 AND y.a3 >= x.a3 AND (y.a1 > x.a1 OR y.a2 > x.a2 OR y.a3 > x.a3))""",
)
def b17(spark, d):
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.round(F.avg("o_totalprice") / 1000, 10).alias("a1"),
        F.count("*").cast("double").alias("a2"),
        F.when(F.first("o_custkey") % 29 != 0, F.round(-F.min("o_totalprice") / 1000, 4)).alias("a3"),
    )
    return gov.pareto_frontier(o, key="o_custkey", axes=["a1", "a2", "a3"])


@query(
    "b18_promotion_gate",
    """WITH g AS (SELECT o_custkey AS method, CAST(o_custkey % 5 AS INTEGER) AS rung, CASE WHEN o_custkey % 31 <> 0 THEN avg(o_totalprice) END AS prim, CASE WHEN o_custkey % 17 <> 0 THEN max(o_totalprice) END AS side FROM orders GROUP BY 1),
      b AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS rung, avg(o_totalprice) AS pb, max(o_totalprice) * 0.9::DOUBLE AS sb FROM orders GROUP BY 1),
      j AS (SELECT *, CASE WHEN prim <= pb THEN 'primary axis not strictly above baseline' WHEN side < sb - 20000 THEN 'side outside tolerance' WHEN method % 11 = 0 OR method % 13 = 0 THEN 'split audit not green'
            WHEN rung >= 3 AND method % 3 = 0 THEN 'shuffle test not green' END AS reason FROM g JOIN b USING (rung))
    SELECT method, rung, round(prim, 9) AS "primary", side, CASE WHEN prim IS NULL OR side IS NULL THEN 'HOLD' WHEN reason IS NOT NULL THEN 'DEMOTE' WHEN rung >= 4 THEN 'HOLD' ELSE 'PROMOTE' END AS verdict,
      CASE WHEN prim IS NOT NULL AND side IS NOT NULL THEN reason END AS failure_reason FROM j""",
)
def b18(spark, d):
    o = fx.table(spark, d, "orders").withColumn("rung", (F.col("o_custkey") % 5).cast("int"))
    m = F.col("o_custkey")
    rows = o.groupBy(m.alias("method"), "rung").agg(F.avg("o_totalprice").alias("primary"), F.max("o_totalprice").alias("side"))
    rows = rows.select(
        "method", "rung", F.when(F.col("method") % 31 != 0, F.col("primary")).alias("primary"),
        F.when(F.col("method") % 17 != 0, F.col("side")).alias("side"),
        F.when(F.col("method") % 13 != 0, F.col("method") % 11 != 0).alias("split_audit_ok"), (F.col("method") % 3 != 0).alias("shuffle_ok"),
    )
    base = o.groupBy("rung").agg(F.avg("o_totalprice").alias("primary_base"), (F.max("o_totalprice") * 0.9).alias("side_base"))
    out = gov.promotion_gate(rows, base, method="method", side_axes=["side"], tolerance=20000.0)
    return out.withColumn("primary", F.round("primary", 9))


_GATES = gov.GATES
_PRIMES = (11, 13, 17, 19, 7, 2, 3, 5)


@query(
    "b19_claim_verdict",
    f"""WITH g AS (SELECT c_custkey, {', '.join(f"CASE WHEN (c_custkey + {i}) % 29 <> 0 THEN c_custkey % {p} {'<>' if p > 5 else '='} 0 END AS {n}" for i, (n, p) in enumerate(zip(_GATES, _PRIMES)))} FROM customer)
    SELECT c_custkey, concat_ws(',', {', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in _GATES)}) AS missing_gates,
      CASE WHEN {' OR '.join(f'{n} IS NULL' for n in _GATES)} THEN 'INCONCLUSIVE' WHEN NOT (manipulation_ok AND orthogonal_ok AND class_direction_collapses AND shuffle_in_band) THEN 'BROKEN' WHEN NOT variance_matched THEN 'INCONCLUSIVE'
      WHEN effect_excludes_zero AND NOT removed_excludes_chance THEN 'BREAKS' WHEN effect_excludes_zero THEN 'ATTENUATED' WHEN effect_in_noise AND removed_excludes_chance THEN 'HOLDS'
      ELSE 'INCONCLUSIVE' END AS verdict FROM g""",
)
def b19(spark, d):
    k = F.col("c_custkey")
    gates = [
        F.when((k + i) % 29 != 0, (k % p != 0) if p > 5 else (k % p == 0)).alias(n)
        for i, (n, p) in enumerate(zip(_GATES, _PRIMES))
    ]
    return fx.table(spark, d, "customer").select("c_custkey", *gates).select(
        "c_custkey", gov.missing_gates().alias("missing_gates"), gov.claim_verdict().alias("verdict")
    )


@query(
    "b20_two_control_gate",
    """WITH a AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'effect' WHEN 'O' THEN 'random' ELSE 'inverted' END AS arm, o_totalprice / 1000 AS v FROM orders),
      g AS (SELECT o_custkey, avg(v) FILTER (arm = 'effect') - avg(v) FILTER (arm = 'random') AS dr, avg(v) FILTER (arm = 'effect') - avg(v) FILTER (arm = 'inverted') AS di FROM a GROUP BY 1)
    SELECT o_custkey, round(dr, 10) AS delta_vs_random, round(di, 10) AS delta_vs_inverted,
      CASE WHEN dr > 0 AND di > 0 THEN 'EFFECT' WHEN (dr > 0 AND di > 0) IS NULL THEN 'MISSING CONTROL' ELSE 'DISCARD' END AS verdict FROM g""",
)
def b20(spark, d):
    arm = F.when(F.col("o_orderstatus") == "F", "effect").when(F.col("o_orderstatus") == "O", "random").otherwise("inverted")
    o = fx.table(spark, d, "orders").select("o_custkey", arm.alias("arm"), (F.col("o_totalprice") / 1000).alias("v"))
    out = gov.two_control_gate(o, by="o_custkey", arm="arm", value="v")
    return out.select("o_custkey", r("delta_vs_random", 10), r("delta_vs_inverted", 10), "verdict")


@query(
    "w12_scope_tag",
    """WITH n AS (SELECT l_suppkey, l_returnflag || l_linestatus AS corpus, count(DISTINCT CASE WHEN l_discount > l_suppkey % 10 / 100.0 THEN l_orderkey END) AS n_groups FROM lineitem GROUP BY ALL)
    SELECT *, CASE WHEN n_groups > 0 AND n_groups < 0.5 * max(n_groups) OVER (PARTITION BY corpus) THEN 'pilot slice' ELSE '' END AS scope FROM n""",
)
def w12(spark, d):
    li = fx.table(spark, d, "lineitem")
    some = F.when(F.col("l_discount") > F.col("l_suppkey") % 10 / 100, F.col("l_orderkey"))
    n = li.groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("corpus")).agg(F.count_distinct(some).alias("n_groups"))
    return gov.scope_tag(n, corpus="corpus", n_groups="n_groups")


_LADDER = """lad AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, round(avg(o_totalprice) / 1000, 10) AS metric, round(max(o_totalprice) / 20000, 10) AS lift FROM orders GROUP BY ALL),
  mg AS (SELECT *, metric - lag(metric) OVER (PARTITION BY o_custkey ORDER BY yr) AS marginal FROM lad)"""


def ladder(spark, d):
    return fx.table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(
        F.round(F.avg("o_totalprice") / 1000, 10).alias("metric"), F.round(F.max("o_totalprice") / 20000, 10).alias("lift")
    )


@query("w13_ladder_marginals", f"WITH {_LADDER} SELECT o_custkey, yr, metric, lift, round(marginal, 9) AS marginal FROM mg")
def w13(spark, d):
    out = gov.ladder_marginals(ladder(spark, d), claim="o_custkey", row="yr", metric="metric")
    return out.withColumn("marginal", F.round("marginal", 9))


@query(
    "w13_ladder_pattern",
    f"""WITH {_LADDER}, p AS (SELECT *, lag(marginal) OVER (PARTITION BY o_custkey ORDER BY yr) AS pm FROM mg WHERE marginal IS NOT NULL),
      g AS (SELECT o_custkey, count(*) AS n_steps, sum(marginal) AS total, min(marginal) AS lo, bool_and(coalesce(marginal < pm - 1e-9, true)) AS falling, sum(lift) AS singles FROM p GROUP BY 1)
    SELECT o_custkey, n_steps, round(total, 8) AS total_lift, CASE WHEN lo < 0 THEN 'reversal' WHEN total > singles + 1e-9 THEN 'super-additive' WHEN falling AND n_steps > 1 THEN 'sub-additive' ELSE 'additive' END AS pattern FROM g""",
)
def w13_pattern(spark, d):
    m = gov.ladder_marginals(ladder(spark, d), claim="o_custkey", row="yr", metric="metric")
    out = gov.ladder_pattern(m, claim="o_custkey", row="yr", single_lift="lift")
    return out.withColumn("total_lift", F.round("total_lift", 8))


@query(
    "w14_champion_trace",
    """WITH t AS (SELECT event_type, event_id, value, 1 + event_id % 9 AS seeds, CASE WHEN 1 + event_id % 9 >= 7 THEN value END AS m FROM events),
      b AS (SELECT *, max(m) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM t)
    SELECT event_type, event_id, value, seeds, best_before, CASE WHEN seeds < 3 THEN 'EXPLORATION' WHEN NOT coalesce(value > coalesce(best_before, '-infinity'::DOUBLE), false) THEN 'KEEP OLD' WHEN seeds >= 7 THEN 'CHAMPION' ELSE 'NOMINEE' END AS status FROM b""",
)
def w14(spark, d):
    e = fx.table(spark, d, "events").select("event_type", "event_id", "value", (F.col("event_id") % 9 + 1).alias("seeds"))
    return gov.champion_trace(e, claim="event_type", order="event_id", tie="event_id", metric="value", seeds="seeds")


@query(
    "w15_latest_rows",
    """SELECT user_id, event_type, event_id, value, count(*) OVER (PARTITION BY user_id, event_type) - 1 AS n_replaced FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def w15(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return gov.latest_rows(e, key=["user_id", "event_type"], order=["ts", "event_id"]).drop("ts")


@query(
    "w16_successive_halving",
    """WITH k AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, md5(CAST(event_id AS VARCHAR))) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, event_id, value, rank, rank <= ceil(n / 2) AS kept FROM k""",
)
def w16(spark, d):
    e = fx.table(spark, d, "events").select("event_type", "event_id", "value")
    return gov.halving(e, stage="event_type", candidate="event_id", metric="value")


@query(
    "w17_slow_rows",
    """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1)
    SELECT event_id, event_type, value, round(median, 6) AS median FROM events JOIN m USING (event_type) WHERE value > 1.5 * median""",
)
def w17(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "event_type", "value")
    return gov.slow_rows(e, rung="event_type", elapsed="value").withColumn("median", r("median"))


@query(
    "l01_smallest_with_exclusions",
    """SELECT p_partkey, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) ORDER BY p_retailprice, p_partkey LIMIT 25""",
)
def l01(spark, d):
    bulk = fx.table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    parts = fx.table(spark, d, "part").select("p_partkey", "p_retailprice")
    return gov.smallest(parts, size="p_retailprice", key="p_partkey", exclude=bulk, n=25)


@query("l01_missing_keys", "SELECT DISTINCT l_partkey + 900 AS p_partkey FROM lineitem WHERE l_partkey + 900 NOT IN (SELECT p_partkey FROM part)")
def l01_missing(spark, d):
    wanted = fx.table(spark, d, "lineitem").select((F.col("l_partkey") + 900).alias("p_partkey"))
    return gov.missing_keys(wanted, fx.table(spark, d, "part"), "p_partkey")


_DAYS = """days AS (SELECT strftime(o_orderdate, '%Y%m%d') AS day, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS n_bytes, count(*) AS n_files FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1)"""


def day_sizes(spark, d):
    o = fx.table(spark, d, "orders")
    path = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("misc/"), "o_orderkey")).otherwise(
        F.concat_ws("/", F.date_format("o_orderdate", "yyyyMMdd"), "o_orderkey")
    )
    files = o.select(path.alias("path"), F.round("o_totalprice").cast("bigint").alias("size"))
    return gov.sizes_by_date_prefix(files, path="path", size="size")


@query("l02_sizes_by_date", f"WITH {_DAYS} SELECT * FROM days")
def l02(spark, d):
    return day_sizes(spark, d)


@query(
    "l03_budget_prefix",
    f"""WITH {_DAYS}, c AS (SELECT *, CAST(coalesce(sum(n_bytes) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM days)
    SELECT CAST(day AS BIGINT) AS day, n_bytes, n_files, before, before < 1000000000 AS processed FROM c""",
)
def l03(spark, d):
    days = day_sizes(spark, d).withColumn("day", F.col("day").cast("bigint"))
    return gov.budget_prefix(days, order="day", size="n_bytes", budget=1_000_000_000)


@query(
    "l05_newest_first",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, md5(CAST(o_orderkey AS VARCHAR))) AS position FROM orders""",
)
def l05(spark, d):
    t = F.unix_date(F.col("o_orderdate").cast("date")).cast("double")
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", t.alias("t"))
    return gov.newest_first(o, by="o_custkey", time="t", tie="o_orderkey").select("o_custkey", "o_orderkey", "position")


_GRID = f"""{fx.SESSIONS}, c AS (SELECT task AS corpus, count(DISTINCT speaker_id) AS n_groups, count(DISTINCT y) AS n_classes FROM sessions WHERE task <> '3-MEDIUM' GROUP BY 1),
  plan AS (SELECT p.corpus, f.features FROM (SELECT DISTINCT task AS corpus FROM sessions) p, (SELECT unnest(['BUILDING', 'MACHINERY', 'GADGETS']) AS features) f),
  has AS (SELECT DISTINCT task AS corpus, archive AS features, true AS h FROM sessions),
  grid AS (SELECT corpus, features, n_groups, n_classes, CASE WHEN h IS NULL OR n_groups IS NULL THEN 'NOT RUN -- no data' WHEN n_groups < 1040 THEN 'NOT RUN -- ' || n_groups || ' groups'
     WHEN n_classes < 2 THEN 'NOT RUN -- one class' ELSE 'RUN' END AS status FROM plan LEFT JOIN c USING (corpus) LEFT JOIN has USING (corpus, features))"""


def grid(spark, d):
    s = fx.sessions(spark, d)
    c = s.where("task <> '3-MEDIUM'").groupBy(F.col("task").alias("corpus")).agg(
        F.count_distinct("speaker_id").alias("n_groups"), F.count_distinct("y").alias("n_classes")
    )
    census = s.select(F.col("task").alias("corpus")).distinct().join(c, "corpus", "left")
    have = s.select(F.col("task").alias("corpus"), F.col("archive").alias("features")).distinct()
    return gov.experiment_grid(census, corpus="corpus", features=["BUILDING", "MACHINERY", "GADGETS"], available=have, n_folds=520)


@query("x02_experiment_grid", f"WITH {_GRID} SELECT * FROM grid")
def x02(spark, d):
    return grid(spark, d)


@query(
    "x02_grid_summary",
    f"WITH {_GRID} SELECT count(*) FILTER (status = 'RUN') AS cells_run, count(*) AS cells_planned, count(*) FILTER (status = 'RUN') = count(*) AS falsifier_fully_evaluable FROM grid",
)
def x02_summary(spark, d):
    return gov.grid_summary(grid(spark, d))
