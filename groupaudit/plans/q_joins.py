"""Queries over the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.functions import scalars as s
from groupaudit.operators import joins as j
from groupaudit.plans import fixtures as fx
from groupaudit.plans.registry import query

_FILES = """files AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey ELSE o_orderkey || '-' || o_orderstatus END AS name FROM orders),
  meta AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'crm_' || c_custkey END AS speaker_id, c_mktsegment FROM customer WHERE c_nationkey <> 3)"""


@query(
    "j01_enrichment_reasons",
    f"""WITH {_FILES} SELECT o_orderkey, name, speaker_id, c_mktsegment AS archive,
      CASE WHEN NOT regexp_matches(name, '^(\\d+)-(.+)$') THEN '{s.NO_PREFIX}' WHEN c_custkey IS NULL THEN 'absent from metadata -> no speaker_id'
           WHEN speaker_id IS NULL THEN 'null speaker_id' END AS reason
    FROM files LEFT JOIN meta ON o_custkey = c_custkey""",
)
def j01(spark, d):
    o = fx.table(spark, d, "orders")
    key = F.col("o_orderkey")
    files = o.select(
        "o_orderkey",
        F.col("o_custkey").alias("key"),
        F.when(key % 7 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat_ws("-", key, "o_orderstatus")).alias("name"),
    )
    c = fx.table(spark, d, "customer").where("c_nationkey <> 3")
    meta = c.select(
        F.col("c_custkey").alias("key"),
        F.when(F.col("c_acctbal") >= 0, s.namespaced("crm", "c_custkey")).alias("speaker_id"),
        F.col("c_mktsegment").alias("archive"),
    )
    _, _, reason = s.session_and_task("name")
    out = j.enrich_with_reasons(files, meta, key="key", group="speaker_id", reason=reason)
    return out.select("o_orderkey", "name", "speaker_id", "archive", "reason")


@query(
    "j02_first_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def j02(spark, d):
    o = fx.table(spark, d, "orders")
    return j.first_per_key(o, key=["o_custkey"], order=["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@query(
    "j03_membership_filter",
    """SELECT event_id, user_id, event_type FROM events
    WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING avg(value) > 50)""",
)
def j03(spark, d):
    e = fx.table(spark, d, "events")
    ok = e.where("event_type = 'error'").groupBy("user_id").agg(F.avg("value").alias("m")).where("m > 50")
    return j.members(e, ok, "user_id").select("event_id", "user_id", "event_type")


@query(
    "j04_aligned_arms",
    """WITH b AS (SELECT count(*) AS n, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS k FROM documents)
    SELECT 'labels' AS arm, n AS n_base, k AS n_aligned,
           CASE WHEN k = n THEN 'RUN' ELSE 'SKIPPED: rows without a partner' END AS status FROM b
    UNION ALL SELECT 'texts', n, n, 'RUN' FROM b""",
)
def j04(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    arms = {"labels": fx.table(spark, d, "labels"), "texts": fx.table(spark, d, "documents")}
    return j.aligned_arms(docs, arms, key="doc_id")


@query(
    "j05_registry_reconcile",
    """WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey <> 7), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'declared but missing' ELSE 'present but undeclared' END AS problem
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
)
def j05(spark, d):
    declared = fx.table(spark, d, "customer").where("c_nationkey <> 7").select(F.col("c_custkey").alias("k"))
    present = fx.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return j.reconcile_registry(declared, present, key="k")


@query(
    "j06_claim_vs_recompute",
    """WITH r AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_sessions, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1),
      c AS (SELECT o_custkey, CASE WHEN o_custkey % 17 = 0 THEN n_sessions + 1 ELSE n_sessions END AS n_sessions,
                   CASE WHEN o_custkey % 19 = 0 THEN NULL WHEN o_custkey % 23 = 0 THEN mean_price + 0.01 ELSE mean_price END AS mean_price FROM r),
      l AS (SELECT r.o_custkey, 'n_sessions' AS metric, c.n_sessions AS recorded, r.n_sessions AS recomputed FROM r JOIN c USING (o_custkey)
            UNION ALL SELECT r.o_custkey, 'mean_price', c.mean_price, r.mean_price FROM r JOIN c USING (o_custkey))
    SELECT o_custkey, metric, round(recorded, 4) AS recorded, round(recomputed, 4) AS recomputed FROM l
    WHERE recorded IS NULL OR abs(recorded - recomputed) > 1e-6""",
)
def j06(spark, d):
    agg = [F.count("*").cast("double").alias("n_sessions"), F.avg("o_totalprice").alias("mean_price")]
    now = fx.table(spark, d, "orders").groupBy("o_custkey").agg(*agg)
    k, price = F.col("o_custkey"), F.col("mean_price")
    recorded = now.select(
        "o_custkey",
        F.when(k % 17 == 0, F.col("n_sessions") + 1).otherwise(F.col("n_sessions")).alias("n_sessions"),
        F.when(k % 19 == 0, None).when(k % 23 == 0, price + 0.01).otherwise(price).alias("mean_price"),
    )
    out = j.claim_disagreements(recorded, now, keys=["o_custkey"], values=["n_sessions", "mean_price"])
    return out.withColumn("recorded", F.round("recorded", 4)).withColumn("recomputed", F.round("recomputed", 4))


@query(
    "j08_duplicate_content",
    """SELECT sha256(text) AS sha256, count(*) AS n_copies, min(source) <> max(source) AS crosses_source, min(lang) <> max(lang) AS crosses_lang,
      min(doc_id % 5) <> max(doc_id % 5) AS crosses_fold FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def j08(spark, d):
    docs = fx.table(spark, d, "documents").select(
        F.sha2("text", 256).alias("sha256"), "source", "lang", (F.col("doc_id") % 5).alias("fold")
    )
    return j.duplicate_content(docs, digest="sha256", crossing=["source", "lang", "fold"])


@query(
    "j09_same_fold_pairing",
    f"""WITH {fx.SCORES}, a AS (SELECT unit_id, task, max(p) AS p_a FROM scores WHERE task % 3 <> 0 GROUP BY ALL),
      b AS (SELECT unit_id, task, max(p2) AS p_b FROM scores WHERE task % 2 = 0 GROUP BY ALL)
    SELECT unit_id, task, p_a, round(p_b, 6) AS p_b FROM a JOIN b USING (unit_id, task)""",
)
def j09(spark, d):
    s_ = fx.scores(spark, d)
    a = s_.where("task % 3 <> 0").select(F.lit("audio").alias("head"), "unit_id", "task", F.col("p").alias("score"))
    b = s_.where("task % 2 = 0").select(F.lit("age").alias("head"), "unit_id", "task", F.col("p2").alias("score"))
    out = j.pair_scores(a.unionByName(b), head="head", score="score", keys=["unit_id", "task"], a="audio", b="age")
    return out.withColumn("p_b", F.round("p_b", 6))


@query(
    "x01_key_sets",
    """SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'only_a', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'only_b', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def x01(spark, d):
    o = fx.table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == v).select("o_custkey") for v in ("F", "P"))
    return j.key_sets(a, b, key="o_custkey").groupBy("side").agg(F.count("*").alias("n"))
