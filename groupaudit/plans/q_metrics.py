"""Queries over the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.operators import metrics as m
from groupaudit.plans import fixtures as fx
from groupaudit.plans.registry import query


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def auc_sql(source: str, score: str, label: str, by: str = "", where: str = "TRUE") -> str:
    """Rank formula of the AUC as SQL: another route to the same number."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {keys}CAST(sum(_y) AS DOUBLE) AS n_pos, CAST(sum(1 - _y) AS DOUBLE) AS n_neg,
           (sum(CASE WHEN _y = 1 THEN _r END) - sum(_y) * (sum(_y) + 1) / 2)
             / nullif(CAST(sum(_y) AS DOUBLE) * sum(1 - _y), 0) AS auc
    FROM (SELECT {keys}{label} AS _y,
                 rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({part.rstrip()}{', ' if by else 'PARTITION BY '}{score}) - 1) / 2 AS _r
          FROM {source} WHERE {where}) {group}"""


@query(
    "a14_roc_auc_pooled",
    f"WITH {fx.SCORES} SELECT n_pos, n_neg, round(auc, 9) AS auc FROM ({auc_sql('scores', 'raw', 'y')})",
)
def a14_pooled(spark, d):
    return m.roc_auc(fx.scores(spark, d), score="raw", label="y").select("n_pos", "n_neg", r("auc", 9))


@query(
    "a14_roc_auc_by_group",
    f"WITH {fx.SCORES} SELECT group_id, n_pos, n_neg, round(auc, 9) AS auc FROM ({auc_sql('scores', 'p', 'y', 'group_id')})",
)
def a14_by_group(spark, d):
    return m.roc_auc(fx.scores(spark, d), score="p", label="y", by=["group_id"]).select(
        "group_id", "n_pos", "n_neg", r("auc", 9)
    )


@query(
    "a15_threshold_metrics",
    f"""WITH {fx.SCORES}, c AS (
      SELECT site, count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE AS fp,
             count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p < 0.5)::DOUBLE AS tn
      FROM scores GROUP BY site)
    SELECT site, tp + fp + fn + tn AS n, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS uar,
           round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
)
def a15(spark, d):
    return m.threshold_metrics(fx.scores(spark, d), score="p", label="y", by=["site"]).select(
        "site", "n", r("uar", 9), r("accuracy", 9), r("f1", 9)
    )


@query(
    "a16_ece_equal_width",
    f"""WITH {fx.SCORES}, b AS (
      SELECT site, least(floor(p * 15), 14) AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM scores GROUP BY ALL)
    SELECT site, CAST(sum(n) AS DOUBLE) AS n, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b GROUP BY site""",
)
def a16(spark, d):
    return m.ece_equal_width(fx.scores(spark, d), score="p", label="y", by=["site"]).select("site", "n", r("ece", 9))


_RELIABILITY = f"""{fx.SCORES}, t AS (
      SELECT y, p, ntile(15) OVER (ORDER BY p, md5(unit_id), unit_id) - 1 AS bin FROM scores)"""


@query(
    "a17_reliability_equal_mass",
    f"""WITH {_RELIABILITY} SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 9) AS conf, round(avg(y), 9) AS acc
    FROM t GROUP BY bin""",
)
def a17(spark, d):
    bins = m.equal_mass_bins(fx.scores(spark, d), score="p", label="y", unit="unit_id")
    return bins.select("bin", "n", r("conf", 9), r("acc", 9))


@query(
    "a17_ece_equal_mass",
    f"""WITH {_RELIABILITY}, b AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM t GROUP BY bin)
    SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b""",
)
def a17_ece(spark, d):
    bins = m.equal_mass_bins(fx.scores(spark, d), score="p", label="y", unit="unit_id")
    return m.ece_from_bins(bins).select("n", r("ece", 9))


@query(
    "a18_brier_decomposition",
    f"""WITH {fx.SCORES}, b AS (
      SELECT site, least(floor(p * 15), 14) AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf, sum((p - y) ** 2) AS se
      FROM scores GROUP BY ALL), g AS (SELECT site, avg(y) AS base FROM scores GROUP BY site)
    SELECT site, CAST(sum(n) AS BIGINT) AS n, round(sum(se) / sum(n), 9) AS brier,
           round(sum(n * (conf - acc) ** 2) / sum(n), 9) AS reliability,
           round(sum(n * (acc - base) ** 2) / sum(n), 9) AS resolution,
           round(any_value(base * (1 - base)), 9) AS uncertainty
    FROM b JOIN g USING (site) GROUP BY site""",
)
def a18(spark, d):
    return m.brier_decomposition(fx.scores(spark, d), score="p", label="y", by=["site"]).select(
        "site", "n", r("brier", 9), r("reliability", 9), r("resolution", 9), r("uncertainty", 9)
    )


@query(
    "a19_directionless_auc",
    f"""WITH {fx.SCORES}, a AS ({auc_sql('scores', 'p2', 'y', 'task')})
    SELECT task, round(auc, 9) AS auc, round(greatest(auc, 1 - auc), 9) AS auc_directionless,
           greatest(auc, 1 - auc) >= 0.6 AS clears_floor FROM a""",
)
def a19(spark, d):
    auc = m.roc_auc(fx.scores(spark, d), score="p2", label="y", by=["task"])
    return auc.select("task", "auc", *m.directionless()).select(
        "task", r("auc", 9), r("auc_directionless", 9), "clears_floor"
    )


@query(
    "a01_group_scores",
    f"""WITH {fx.SCORES} SELECT group_id, round(avg(p), 9) AS p,
      CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS y, count(*) AS n_units,
      CASE WHEN 2 * count(*) FILTER (p >= 0.5) > count(p) THEN 1 ELSE 0 END AS vote FROM scores GROUP BY group_id""",
)
def a01(spark, d):
    return m.to_group_scores(fx.scores(spark, d), group="group_id", score="p", label="y").select(
        "group_id", r("p", 9), "y", "n_units", "vote"
    )


@query(
    "a01_group_auc",
    f"""WITH {fx.SCORES}, g AS (SELECT session_id, avg(p) AS p, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS y
      FROM scores GROUP BY session_id)
    SELECT n_pos, n_neg, round(auc, 9) AS auc FROM ({auc_sql('g', 'p', 'y')})""",
)
def a01_auc(spark, d):
    g = m.to_group_scores(fx.scores(spark, d), group="session_id", score="p", label="y")
    return m.roc_auc(g, score="p", label="y").select("n_pos", "n_neg", r("auc", 9))


_CELLS = f"""{fx.SCORES}, long AS (
      SELECT 'site' AS partition, site AS cell, y, p FROM scores
      UNION ALL SELECT 'task', CAST(task AS VARCHAR), y, p FROM scores
      UNION ALL SELECT 'group_id', CAST(group_id AS VARCHAR), y, p FROM scores),
    a AS ({auc_sql('long', 'p', 'y', 'partition, cell')})"""


@query(
    "a21_subgroup_auc",
    f"""WITH {_CELLS} SELECT partition, cell, CAST(n_pos + n_neg AS BIGINT) AS n, round(auc, 9) AS auc,
      n_pos + n_neg >= 30 AS counts FROM a""",
)
def a21(spark, d):
    return m.subgroup_auc(
        fx.scores(spark, d), score="p", label="y", partitions=["site", "task", "group_id"]
    ).select("partition", "cell", "n", r("auc", 9), "counts")


@query(
    "a21_worst_cell",
    f"""WITH {_CELLS}, w AS (SELECT min(auc) AS auc_min, count(*) AS n_cells FROM a WHERE n_pos + n_neg >= 30),
      pooled AS ({auc_sql('scores', 'p', 'y')})
    SELECT round(auc_min, 9) AS auc_min, n_cells, round(auc, 9) AS auc_pooled, round(auc - auc_min, 9) AS gap FROM w, pooled""",
)
def a21_worst(spark, d):
    s = fx.scores(spark, d)
    cells = m.subgroup_auc(s, score="p", label="y", partitions=["site", "task", "group_id"])
    pooled = m.roc_auc(s, score="p", label="y")
    return m.worst_cell(cells, pooled).select(r("auc_min", 9), "n_cells", r("auc_pooled", 9), r("gap", 9))
