"""Queries over the profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.operators import profile as p
from groupaudit.plans import fixtures as fx
from groupaudit.plans.q_metrics import auc_sql, r
from groupaudit.plans.registry import query


@query(
    "a02_census",
    f"""WITH {fx.SESSIONS}, g AS (
      SELECT speaker_id, count(*) AS n, sum(y) AS pos, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS lab,
             min(y) <> max(y) AS mixed FROM sessions GROUP BY speaker_id)
    SELECT CAST(sum(n) AS BIGINT) AS n_units, count(*) AS n_groups, CAST(sum(pos) AS BIGINT) AS n_pos_units,
           CAST(sum(n) - sum(pos) AS BIGINT) AS n_neg_units, CAST(sum(lab) AS BIGINT) AS n_pos_groups,
           CAST(count(*) - sum(lab) AS BIGINT) AS n_neg_groups, round(sum(n) / count(*), 9) AS units_per_group,
           count(*) FILTER (mixed) AS n_mixed_groups FROM g""",
)
def a02(spark, d):
    c = p.census(fx.sessions(spark, d), group="speaker_id", label="y")
    return c.withColumn("units_per_group", r("units_per_group", 9))


@query(
    "a03_key_integrity",
    f"""WITH {fx.SESSIONS}, k AS (SELECT speaker_id, count(*) AS n, count(DISTINCT recorded) AS dates FROM sessions GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, max(n) = 1 AS unique_per_row, max(n) AS max_rows_per_key,
           count(*) FILTER (n > 1) AS n_keys_multi_row, count(*) FILTER (dates > 1) AS n_keys_multi_date FROM k""",
)
def a03(spark, d):
    return p.key_integrity(fx.sessions(spark, d), key="speaker_id", date="recorded")


@query(
    "a04_leakage_exposure",
    f"""WITH {fx.SESSIONS}, g AS (SELECT speaker_id, count(*) AS n, count(DISTINCT task) AS a FROM sessions GROUP BY 1)
    SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_groups_multi_session,
           CAST(sum(n) FILTER (n > 1) AS BIGINT) AS n_sessions_at_risk, max(n) AS max_sessions_per_group,
           round(100.0 * sum(n) FILTER (n > 1) / sum(n), 2) AS pct_rows_at_risk,
           count(*) FILTER (a > 1) AS n_groups_multi_archive FROM g""",
)
def a04(spark, d):
    return p.leakage_exposure(fx.sessions(spark, d), group="speaker_id", archive="task")


@query(
    "a05_cross_label_examples",
    f"""WITH {fx.SESSIONS} SELECT speaker_id FROM sessions GROUP BY 1 HAVING min(y) <> max(y) ORDER BY 1 LIMIT 10""",
)
def a05(spark, d):
    return p.cross_label_examples(fx.sessions(spark, d), group="speaker_id", label="y")


@query(
    "a06_crosstab_top",
    f"""WITH {fx.SESSIONS}, long AS (
      SELECT status AS cls, 'archive' AS field, coalesce(nullif(trim(archive), ''), 'MISSING') AS value FROM sessions
      UNION ALL SELECT status, 'task', coalesce(nullif(trim(task), ''), 'MISSING') FROM sessions
      UNION ALL SELECT status, 'site', CAST(site AS VARCHAR) FROM sessions
      UNION ALL SELECT status, 'age', CAST(age AS VARCHAR) FROM sessions),
    c AS (SELECT cls, field, value, count(*) AS n FROM long GROUP BY ALL)
    SELECT cls, field, value, n, CAST(row_number() OVER (PARTITION BY cls, field ORDER BY n DESC, value) AS INTEGER) AS rank
    FROM c QUALIFY rank <= 5""",
)
def a06(spark, d):
    return p.crosstab(fx.sessions(spark, d), cls="status", fields=["archive", "task", "site", "age"], top=5)


@query(
    "a07_numeric_profile",
    f"""WITH {fx.SESSIONS}, k AS (SELECT status, duration AS v, row_number() OVER (PARTITION BY status ORDER BY duration) AS rn,
      count(*) OVER (PARTITION BY status) AS n FROM sessions)
    SELECT status, any_value(n) AS n, round(avg(v), 2) AS mean, min(v) AS min, max(v) AS max,
           max(v) FILTER (rn = n // 2 + 1) AS upper_median FROM k GROUP BY status""",
)
def a07(spark, d):
    return p.numeric_profile(fx.sessions(spark, d), cls="status", value="duration")


_SUBMISSIONS = """submissions AS (
      SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS status,
             CASE WHEN k % 4 = 0 THEN 'NaN' WHEN k % 9 = 0 THEN 'bad' ELSE CAST(k AS VARCHAR) END AS age,
             CASE WHEN k % 2 = 0 THEN event_type END AS rater_1, CASE WHEN k % 3 = 0 THEN event_type ELSE '' END AS rater_2,
             CASE WHEN k % 5 = 0 THEN 'other' ELSE ' ' END AS rater_3, value
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def submissions(spark, d):
    """Events as crowd submissions: blanks, unreadable numbers and three partly filled raters."""
    e = fx.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("status"),
        F.when(F.col("k") % 4 == 0, "NaN").when(F.col("k") % 9 == 0, "bad").otherwise(F.col("k").cast("string")).alias("age"),
        F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("rater_1"),
        F.when(F.col("k") % 3 == 0, F.col("event_type")).otherwise("").alias("rater_2"),
        F.when(F.col("k") % 5 == 0, "other").otherwise(" ").alias("rater_3"),
        "value",
    )


@query(
    "a08_coverage",
    f"""WITH {_SUBMISSIONS} {' UNION ALL '.join(
        f"SELECT '{c}' AS column, count(*) FILTER (trim({c}) <> '') AS n_filled, count(*) AS n_rows FROM submissions"
        for c in ('status', 'age', 'rater_1', 'rater_2', 'rater_3'))}""",
)
def a08(spark, d):
    return p.coverage(submissions(spark, d), ["status", "age", "rater_1", "rater_2", "rater_3"])


@query(
    "a09_rater_labels",
    f"""WITH {_SUBMISSIONS}, f AS (SELECT coalesce(trim(rater_1) <> '', false) AS a, coalesce(trim(rater_2) <> '', false) AS b,
        coalesce(trim(rater_3) <> '', false) AS c FROM submissions),
      t AS (SELECT count(*) FILTER (a OR b OR c) AS n_any, count(*) FILTER (a AND b AND c) AS n_all FROM f),
      l AS (SELECT trim(rater_1) AS label FROM submissions UNION ALL SELECT trim(rater_2) FROM submissions
            UNION ALL SELECT trim(rater_3) FROM submissions)
    SELECT label, count(*) AS n, any_value(n_any) AS n_any, any_value(n_all) AS n_all FROM l, t WHERE label <> '' GROUP BY label""",
)
def a09(spark, d):
    return p.rater_profile(submissions(spark, d), ["rater_1", "rater_2", "rater_3"])


@query(
    "a10_threshold_profile",
    f"""WITH {_SUBMISSIONS}, v AS (SELECT coalesce(nullif(trim(status), ''), 'MISSING') AS label,
        CASE WHEN isnan(TRY_CAST(age AS DOUBLE)) THEN NULL ELSE TRY_CAST(age AS DOUBLE) END AS v FROM submissions)
    SELECT label, count(*) AS n_all, count(v) AS n_with_value, round(avg(v), 4) AS mean,
           count(*) FILTER (coalesce(v, 0) >= 50) AS n_at_threshold FROM v GROUP BY label""",
)
def a10(spark, d):
    return p.threshold_profile(submissions(spark, d), value="age", label="status", threshold=50.0)


@query(
    "a11_repeated_pairs",
    """WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, l_partkey, n, (SELECT count(*) FROM c) AS n_distinct_pairs FROM c
    ORDER BY n DESC, l_suppkey, l_partkey LIMIT 10""",
)
def a11(spark, d):
    return p.repeated_pairs(fx.table(spark, d, "lineitem"), a="l_suppkey", b="l_partkey")


@query(
    "a12_class_bar",
    f"""WITH {fx.SESSIONS}, g AS (SELECT DISTINCT speaker_id, y FROM sessions)
    SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
           least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) >= 500 AS meets_bar FROM g""",
)
def a12(spark, d):
    return p.class_bar(fx.sessions(spark, d), label="y", group="speaker_id")


_SIZES = "s AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)"


@query(
    "a13_long_tail",
    f"""WITH {_SIZES}, t AS (SELECT unnest([100, 50, 30, 5, 1]) AS threshold)
    SELECT CAST(threshold AS INTEGER) AS threshold, count(*) FILTER (n >= threshold) AS n_conditions,
           CAST(coalesce(sum(n) FILTER (n >= threshold), 0) AS BIGINT) AS n_groups, count(*) AS n_all_conditions,
           count(*) FILTER (n = 1) AS n_singletons FROM s, t GROUP BY threshold""",
)
def a13(spark, d):
    return p.long_tail(p.condition_sizes(fx.table(spark, d, "lineitem"), condition="l_partkey", group="l_suppkey"))


@query("a13_top_conditions", f"WITH {_SIZES} SELECT l_partkey, n AS n_groups FROM s ORDER BY n DESC, l_partkey LIMIT 4")
def a13_top(spark, d):
    s = p.condition_sizes(fx.table(spark, d, "lineitem"), condition="l_partkey", group="l_suppkey")
    return s.orderBy(F.desc("n_groups"), "l_partkey").limit(4)


@query(
    "a20_histogram",
    f"""WITH {fx.SESSIONS} SELECT y, CAST(floor(age / 4) * 4 AS BIGINT) AS bin, count(*) AS n FROM sessions
    WHERE age >= 0 AND age < 100 GROUP BY ALL""",
)
def a20(spark, d):
    return p.histogram(fx.sessions(spark, d), cls="y", value="age")


_CONFOUNDS = f"""{fx.SESSIONS}, u AS (SELECT speaker_id, y, age::DOUBLE AS age, duration, (sex = 'M')::INT::DOUBLE AS male FROM sessions),
  g AS (SELECT avg(age) AS age, avg(duration) AS duration, avg(male) AS male,
        CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS y FROM u GROUP BY speaker_id),
  long AS ({' UNION ALL '.join(f"SELECT '{gr}' AS grain, '{c}' AS confound, y, {c} AS v FROM {t}"
           for gr, t in (('unit', 'u'), ('group', 'g')) for c in ('age', 'duration', 'male'))}),
  a AS ({auc_sql('long', 'v', 'y', 'grain, confound')})"""


@query("a22_confound_profile", f"WITH {_CONFOUNDS} SELECT grain, confound, n_pos, n_neg, round(auc, 9) AS auc FROM a")
def a22(spark, d):
    s = fx.sessions(spark, d).withColumn("male", (F.col("sex") == "M").cast("int"))
    out = p.confound_profile(s, group="speaker_id", label="y", confounds=["age", "duration", "male"])
    return out.withColumn("auc", r("auc", 9))
