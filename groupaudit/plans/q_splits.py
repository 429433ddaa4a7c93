"""Queries over partitions, label permutation and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.functions.hashing import uniform_sql
from groupaudit.operators import designs as g
from groupaudit.operators import splits as sp
from groupaudit.plans import fixtures as fx
from groupaudit.plans.q_metrics import r
from groupaudit.plans.registry import query
from groupaudit.session import materialise

GROUPS = f"""{fx.SESSIONS}, grp AS (SELECT speaker_id, count(*) AS n_units, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS y,
    any_value(age) AS age, any_value(sex) AS sex FROM sessions GROUP BY 1)"""

FOLDS = f"""{GROUPS}, folds AS (SELECT repeat, speaker_id, y, n_units, CAST((row_number() OVER (PARTITION BY repeat, y
    ORDER BY md5(concat_ws('|', repeat + 7, speaker_id))) - 1) % 5 AS INTEGER) AS fold FROM grp, (SELECT unnest(range(3))::INTEGER AS repeat))"""


def folds(spark, d):
    return sp.stratified_folds(fx.sessions(spark, d), group="speaker_id", label="y", repeats=3, seed=7)


def group_table(spark, d):
    return fx.sessions(spark, d).groupBy("speaker_id").agg(
        F.count("*").alias("n_units"),
        F.bround(F.avg("y"), 0).cast("int").alias("y"),
        F.first("age").alias("age"),
        F.first("sex").alias("sex"),
    )


@query("w01_stratified_group_folds", f"WITH {FOLDS} SELECT * FROM folds")
def w01(spark, d):
    return folds(spark, d)


@query(
    "w01_fold_report",
    f"""WITH {FOLDS}, a AS (SELECT repeat, fold, count(*) AS n, sum(s.y) AS p FROM sessions s JOIN folds USING (speaker_id) GROUP BY ALL),
      t AS (SELECT repeat, sum(n) AS tn, sum(p) AS tp FROM a GROUP BY 1)
    SELECT repeat, fold, n AS n_test, CAST(tn - n AS BIGINT) AS n_train, CAST(tp - p AS BIGINT) AS n_train_pos, tp - p > 0 AND tp - p < tn - n AS usable
    FROM a JOIN t USING (repeat)""",
)
def w01_report(spark, d):
    s = fx.sessions(spark, d).select("speaker_id", F.col("y").alias("unit_y"))
    return sp.fold_report(s.join(folds(spark, d), "speaker_id"), label="unit_y")


BALANCED = f"""{GROUPS}, rk AS (SELECT repeat, speaker_id, n_units, row_number() OVER (PARTITION BY repeat
    ORDER BY n_units DESC, md5(concat_ws('|', repeat + 3, speaker_id))) - 1 AS pos FROM grp, (SELECT unnest(range(2))::INTEGER AS repeat)),
  bal AS (SELECT repeat, speaker_id, n_units, CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM rk)"""


def balanced(spark, d):
    return sp.balanced_folds(fx.sessions(spark, d), group="speaker_id", repeats=2, seed=3)


@query("w02_balanced_group_folds", f"WITH {BALANCED} SELECT * FROM bal")
def w02(spark, d):
    return balanced(spark, d)


@query(
    "w02_fold_balance",
    f"""WITH {BALANCED}, f AS (SELECT repeat, fold, sum(n_units) AS n, max(n_units) AS big FROM bal GROUP BY ALL)
    SELECT repeat, count(*) AS n_folds, CAST(max(n) - min(n) AS BIGINT) AS spread, max(big) AS largest_group, max(n) - min(n) <= max(big) AS within_bound FROM f GROUP BY 1""",
)
def w02_balance(spark, d):
    return sp.fold_balance(balanced(spark, d))


@query(
    "w03_inner_folds",
    f"""WITH {BALANCED}, tr AS (SELECT repeat, o AS outer_fold, speaker_id, n_units FROM bal, (SELECT unnest(range(5))::INTEGER AS o) WHERE o <> fold),
      rk2 AS (SELECT *, row_number() OVER (PARTITION BY repeat, outer_fold ORDER BY n_units DESC, md5(concat_ws('|', repeat + 5, outer_fold, speaker_id))) - 1 AS pos,
              greatest(2, least(3, count(*) OVER (PARTITION BY repeat, outer_fold))) AS k FROM tr)
    SELECT repeat, outer_fold, speaker_id, n_units, CAST(CASE WHEN (pos // k) % 2 = 0 THEN pos % k ELSE k - 1 - pos % k END AS INTEGER) AS inner_fold FROM rk2""",
)
def w03(spark, d):
    return sp.inner_folds(balanced(spark, d), group="speaker_id", outer=5, seed=5)


@query(
    "w04_disjointness_evidence",
    f"""WITH {FOLDS}, a AS (SELECT repeat, CASE WHEN speaker_id % 50 = 0 THEN CAST(session_id % 5 AS INTEGER) ELSE fold END AS fold, speaker_id, session_id
        FROM sessions JOIN folds USING (speaker_id)),
      c AS (SELECT repeat, fold, speaker_id, count(*) AS n FROM a GROUP BY ALL), g AS (SELECT repeat, speaker_id, count(*) AS k FROM c GROUP BY ALL),
      t AS (SELECT repeat, fold, count(*) AS n_test_groups, sum(n) AS n_test_rows, count(*) FILTER (k > 1) AS n_overlap,
            coalesce(array_to_string(list_sort(list(speaker_id::VARCHAR) FILTER (k > 1))[1:5], ','), '') AS examples FROM c JOIN g USING (repeat, speaker_id) GROUP BY ALL)
    SELECT repeat, fold, n_test_groups, (SELECT count(*) FROM g WHERE g.repeat = t.repeat) - n_test_groups + n_overlap AS n_train_groups, CAST(n_test_rows AS BIGINT) AS n_test_rows,
      CAST((SELECT count(*) FROM a WHERE a.repeat = t.repeat) - n_test_rows AS BIGINT) AS n_train_rows, n_overlap, examples,
      CASE WHEN n_overlap > 0 THEN 'LEAK' WHEN n_test_groups < 8 THEN 'TOO FEW TEST GROUPS' ELSE 'PASS' END AS status FROM t""",
)
def w04(spark, d):
    """Folds with some groups deliberately scattered, which the gate must report."""
    s = fx.sessions(spark, d).select("speaker_id", "session_id").join(folds(spark, d), "speaker_id")
    leaky = F.when(F.col("speaker_id") % 50 == 0, (F.col("session_id") % 5).cast("int")).otherwise(F.col("fold"))
    return sp.disjointness_evidence(s.withColumn("fold", leaky), group="speaker_id")


@query(
    "w05_group_holdout",
    f"""WITH {GROUPS}, r AS (SELECT speaker_id, {uniform_sql('11', 'speaker_id')} AS u, row_number() OVER (ORDER BY md5(concat_ws('|', 11, speaker_id))) AS rn,
      count(*) OVER () AS n FROM grp) SELECT speaker_id, u < 0.8 AS is_train, rn <= floor(0.8::DOUBLE * n) AS is_train_exact FROM r""",
)
def w05(spark, d):
    gr = fx.sessions(spark, d).select("speaker_id").distinct()
    exact = sp.holdout(gr, group="speaker_id", seed=11, exact=True).withColumnRenamed("is_train", "is_train_exact")
    return sp.holdout(exact, group="speaker_id", seed=11).select("speaker_id", "is_train", "is_train_exact")


@query(
    "w06_within_group_half",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 12 ORDER BY md5(concat_ws('|', 5, user_id)), user_id LIMIT 60)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', 5, event_id))) <= greatest(2, n // 2) AS is_train
    FROM events JOIN c USING (user_id)""",
)
def w06(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id")
    return sp.half_split(e, group="user_id", unit="event_id", min_units=12, n_groups=60, seed=5)


@query(
    "a23_random_split_leak",
    f"""WITH {fx.SESSIONS}, t AS (SELECT trial, speaker_id, CAST('0x' || substr(md5(concat_ws('|', trial + 2, session_id)), 1, 13) AS BIGINT) % 5 AS fold
        FROM sessions, (SELECT unnest(range(10)) AS trial)),
      g AS (SELECT trial, speaker_id, count(DISTINCT fold) AS k, count(*) AS n FROM t GROUP BY ALL),
      p AS (SELECT trial, 100.0::DOUBLE * count(*) FILTER (k > 1) / count(*) AS a, 100.0::DOUBLE * sum(n) FILTER (k > 1) / sum(n) AS b FROM g GROUP BY 1)
    SELECT count(*) AS n_trials, round(avg(a), 6) AS pct_groups_split, round(avg(b), 6) AS pct_rows_leaked FROM p""",
)
def a23(spark, d):
    out = sp.random_split_leak(fx.sessions(spark, d), group="speaker_id", unit="session_id", trials=10, seed=2)
    return out.select("n_trials", r("pct_groups_split"), r("pct_rows_leaked"))


@query(
    "m15_nested_samples",
    f"""WITH {GROUPS}, k AS (SELECT repeat, speaker_id, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws('|', repeat + 13, speaker_id))) AS rn
      FROM grp, (SELECT unnest(range(2))::INTEGER AS repeat))
    SELECT repeat, CAST(n AS INTEGER) AS n_train, speaker_id FROM k, (SELECT unnest([25, 50, 100, 200, 400, 800]) AS n) WHERE rn <= n""",
)
def m15(spark, d):
    gr = fx.sessions(spark, d).select("speaker_id").distinct()
    return sp.nested_samples(gr, group="speaker_id", sizes=[25, 50, 100, 200, 400, 800], repeats=2, seed=13).select(
        "repeat", "n_train", "speaker_id"
    )


@query(
    "m16_controlled_overlap",
    f"""WITH {GROUPS}, g AS (SELECT speaker_id, n_units AS n, {uniform_sql('4', 'speaker_id')} < 0.2 AS test FROM grp),
      g2 AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY md5(concat_ws('|', 5, speaker_id))) AS gr, count(*) FILTER (test) OVER () AS nt FROM g),
      u AS (SELECT speaker_id, session_id, test, gr, n, nt, row_number() OVER (PARTITION BY test, CASE WHEN test THEN speaker_id ELSE -1 END ORDER BY md5(concat_ws('|', 6, session_id))) AS ur
            FROM sessions JOIN g2 USING (speaker_id)),
      rho AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS rho),
      mv AS (SELECT rho, sum(CASE WHEN test AND gr <= floor(rho * nt) THEN n // 2 ELSE 0 END) AS moved, sum(CASE WHEN NOT test THEN n ELSE 0 END) AS ntr FROM g2, rho GROUP BY rho),
      s AS (SELECT rho, speaker_id, CASE WHEN test THEN CASE WHEN gr <= floor(rho * nt) AND ur <= n // 2 THEN 'train' ELSE 'test' END WHEN ur <= ntr - moved THEN 'train' ELSE 'dropped' END AS side FROM u, mv)
    SELECT rho, side, count(*) AS n_rows, count(DISTINCT speaker_id) AS n_groups FROM s GROUP BY ALL""",
)
def m16(spark, d):
    s = sp.controlled_overlap(fx.sessions(spark, d), group="speaker_id", unit="session_id", seed=4)
    return s.groupBy("rho", "side").agg(F.count("*").alias("n_rows"), F.count_distinct("speaker_id").alias("n_groups"))


@query(
    "m24_group_label_shuffle",
    f"""WITH {GROUPS}, a AS (SELECT speaker_id, row_number() OVER (ORDER BY md5(concat_ws('|', 21, speaker_id))) AS rn FROM grp),
      b AS (SELECT y AS y_shuffled, row_number() OVER (ORDER BY md5(concat_ws('|', 22, speaker_id))) AS rn FROM grp)
    SELECT speaker_id, y_shuffled FROM a JOIN b USING (rn)""",
)
def m24(spark, d):
    return sp.shuffle_group_labels(group_table(spark, d), group="speaker_id", label="y", seed=21)


@query(
    "m25_within_stratum_shuffle",
    f"""WITH {GROUPS}, a AS (SELECT sex, speaker_id, row_number() OVER (PARTITION BY sex ORDER BY md5(concat_ws('|', 21, speaker_id))) AS rn FROM grp),
      b AS (SELECT sex, y AS y_shuffled, row_number() OVER (PARTITION BY sex ORDER BY md5(concat_ws('|', 22, speaker_id))) AS rn FROM grp)
    SELECT sex, speaker_id, y_shuffled FROM a JOIN b USING (sex, rn)""",
)
def m25(spark, d):
    return sp.shuffle_group_labels(group_table(spark, d), group="speaker_id", label="y", seed=21, within=["sex"])


def _moved_sql(mode: str, part: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    keys = f"({part}, rn)" if part else "(rn)"
    return f"""SELECT '{mode}' AS mode, {part or 0} AS stratum, speaker_id, y, y_shuffled FROM
      (SELECT *, row_number() OVER ({over}ORDER BY md5(concat_ws('|', 21, speaker_id))) AS rn FROM gb) JOIN
      (SELECT {part + ', ' if part else ''}y AS y_shuffled, row_number() OVER ({over}ORDER BY md5(concat_ws('|', 22, speaker_id))) AS rn FROM gb) USING {keys}"""


@query(
    "m25_three_modes",
    f"""WITH {GROUPS}, first AS (SELECT speaker_id, min(recorded) AS t FROM sessions GROUP BY 1),
      gb AS (SELECT *, CASE WHEN sex = 'F' THEN 1 ELSE 0 END AS half, CAST(floor((row_number() OVER (ORDER BY t, md5(CAST(speaker_id AS VARCHAR)), speaker_id) - 1) * 4 / (SELECT count(*) FROM grp)) AS INTEGER) AS block
             FROM grp JOIN first USING (speaker_id)),
      m AS ({_moved_sql('hard', '')} UNION ALL {_moved_sql('within_group', 'half')} UNION ALL {_moved_sql('block', 'block')})
    SELECT mode, CAST(stratum AS INTEGER) AS stratum, count(*) AS n_groups, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(y_shuffled) AS BIGINT) AS n_pos_shuffled, count(*) FILTER (y <> y_shuffled) AS n_moved FROM m GROUP BY ALL""",
)
def m25_modes(spark, d):
    """Labels move, and their number stays, in the whole table, in each half and in each block of time."""
    g_ = group_table(spark, d).join(fx.sessions(spark, d).groupBy("speaker_id").agg(F.min("recorded").alias("t")), "speaker_id")
    g_ = materialise(g_.withColumn("half", F.when(F.col("sex") == "F", 1).otherwise(0)))
    out = None
    for mode, key in (("hard", None), ("within_group", "half"), ("block", "block")):
        moved = sp.shuffle_labels(g_, group="speaker_id", label="y", mode=mode, seed=21, within=["half"], time="t", n_blocks=4)
        moved = moved.select("speaker_id", (F.col(key) if key else F.lit(0)).cast("int").alias("stratum"), "y_shuffled").join(g_.select("speaker_id", "y"), "speaker_id")
        rows = moved.groupBy(F.lit(mode).alias("mode"), "stratum").agg(
            F.count("*").alias("n_groups"), F.sum("y").cast("bigint").alias("n_pos"), F.sum("y_shuffled").cast("bigint").alias("n_pos_shuffled"),
            F.count_if(F.col("y") != F.col("y_shuffled")).alias("n_moved"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "m25_chance_baseline",
    f"""WITH {fx.SESSIONS}, c AS (SELECT site, status, count(*) AS n FROM sessions GROUP BY ALL), g AS (SELECT site, count(*) AS n_classes, max(n) / sum(n) AS top FROM c GROUP BY 1)
    SELECT site, n_classes, metric, round(CASE metric WHEN 'auc' THEN 0.5 WHEN 'accuracy' THEN top WHEN 'uar' THEN 1.0::DOUBLE / n_classes ELSE 0 END, 9) AS chance
    FROM g, (SELECT unnest(['auc', 'accuracy', 'uar', 'r2']) AS metric)""",
)
def m25_chance(spark, d):
    """Three classes: the chance level of UAR is a third, that of accuracy the largest class."""
    from groupaudit.operators.inference import chance_baseline

    s, out = fx.sessions(spark, d), None
    for metric in ("auc", "accuracy", "uar", "r2"):
        rows = chance_baseline(s, label="status", metric=metric, by=["site"]).select("site", "n_classes", F.lit(metric).alias("metric"), r("chance", 9))
        out = rows if out is None else out.unionByName(rows)
    return out


def _match_sql(tol: int) -> str:
    """Rounds unrolled: number who is left inside each cell, join on the number, remove the matched."""
    ctes = [
        GROUPS,
        "c0 AS (SELECT speaker_id AS id, sex, age FROM grp WHERE y = 0 AND age IS NOT NULL)",
        "p0 AS (SELECT speaker_id AS id, sex, age FROM grp WHERE y = 1 AND age IS NOT NULL)",
    ]
    rank = "row_number() OVER (PARTITION BY sex, age ORDER BY md5(concat_ws('|', 9, id))) AS rn"
    for i, dist in enumerate(g.round_order(tol)):
        ctes.append(
            f"""m{i} AS (SELECT a.sex AS exact, a.id AS control, b.id AS "case", a.age AS age_control, b.age AS age_case, {dist} AS d
            FROM (SELECT *, {rank} FROM c{i}) a JOIN (SELECT *, {rank} FROM p{i}) b ON a.sex = b.sex AND b.age = a.age + {dist} AND a.rn = b.rn)"""
        )
        ctes.append(f"c{i + 1} AS (SELECT * FROM c{i} WHERE id NOT IN (SELECT control FROM m{i}))")
        ctes.append(f"""p{i + 1} AS (SELECT * FROM p{i} WHERE id NOT IN (SELECT "case" FROM m{i}))""")
    union = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(2 * tol + 1))
    return f"WITH {', '.join(ctes)}, pairs AS ({union})"


def pairs(spark, d):
    return g.caliper_match(group_table(spark, d), group="speaker_id", label="y", age="age", exact="sex", tol=3, seed=9)


@query("j07_caliper_matching", f'{_match_sql(3)} SELECT * REPLACE (CAST(d AS INTEGER) AS d) FROM pairs')
def j07(spark, d):
    return pairs(spark, d)


@query(
    "j07_match_report",
    f"""{_match_sql(3)} SELECT count(*) AS n_pairs, round(avg(age_control), 6) AS age_control, round(avg(age_case), 6) AS age_case,
      round(abs(avg(age_case) - avg(age_control)), 6) AS age_gap, round(avg(abs(age_case - age_control)), 6) AS mean_abs_diff FROM pairs""",
)
def j07_report(spark, d):
    return g.match_report(pairs(spark, d)).select(
        "n_pairs", r("age_control"), r("age_case"), r("age_gap"), r("mean_abs_diff")
    )
