"""Queries over scalar and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.functions import arrays as arr
from groupaudit.functions import hashing as h
from groupaudit.functions import scalars as s
from groupaudit.plans import fixtures as fx
from groupaudit.plans.q_metrics import r
from groupaudit.plans.q_profile import _SUBMISSIONS, submissions
from groupaudit.plans.registry import query


@query(
    "p01_path_functions",
    r"""WITH f AS (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS file FROM pages)
    SELECT page_id, file, regexp_replace(file, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(file, '.\.([^.]*)$', 1)) AS ext,
           '/data/' || url AS abs_path FROM f""",
)
def p01(spark, d):
    return fx.table(spark, d, "pages").select(
        "page_id",
        s.file_name("url").alias("file"),
        s.stem("url").alias("stem"),
        s.extension("url").alias("ext"),
        s.absolute("url", "/data").alias("abs_path"),
    )


_NAMES = """names AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN event_type || '-' || event_id
   ELSE event_id || '-' || event_type || '_h' END AS name FROM events)"""


def names(spark, d):
    e = fx.table(spark, d, "events")
    good = F.concat(F.col("event_id"), F.lit("-"), F.col("event_type"), F.lit("_h"))
    return e.select(
        "event_id", F.when(F.col("event_id") % 11 == 0, F.concat_ws("-", "event_type", "event_id")).otherwise(good).alias("name")
    )


@query(
    "p02_name_parsing",
    f"""WITH {_NAMES} SELECT event_id,
      CASE WHEN regexp_matches(name, '^(\\d+)-(.+)$') THEN CAST(regexp_extract(name, '^(\\d+)-(.+)$', 1) AS BIGINT) END AS session,
      CASE WHEN regexp_matches(name, '^(\\d+)-(.+)$') THEN regexp_extract(name, '^(\\d+)-(.+)$', 2) END AS task,
      CASE WHEN NOT regexp_matches(name, '^(\\d+)-(.+)$') THEN '{s.NO_PREFIX}' END AS reason,
      nullif(regexp_extract('x/' || name, '(?:^|/)(\\d+)[-_]', 1), '') AS member_group
    FROM names""",
)
def p02(spark, d):
    session, task, reason = s.session_and_task("name")
    return names(spark, d).select(
        "event_id",
        session.alias("session"),
        task.alias("task"),
        reason.alias("reason"),
        s.member_group(F.concat(F.lit("x/"), "name")).alias("member_group"),
    )


@query(
    "p03_code_maps",
    """SELECT c_custkey, 'crm_' || c_custkey AS speaker_id,
      CASE c_nationkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'F' WHEN 3 THEN 'M' ELSE '' END AS sex,
      CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'healthy' ELSE 'pathological' END AS label,
      CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE c_mktsegment END AS pathology FROM customer""",
)
def p03(spark, d):
    c = fx.table(spark, d, "customer")
    codes = F.element_at(F.array(*[F.lit(v) for v in ("w ", "m", " female", "male", "?")]), F.col("c_nationkey") % 5 + 1)
    healthy = F.col("c_mktsegment") == "HOUSEHOLD"
    return c.select(
        "c_custkey",
        s.namespaced("crm", "c_custkey").alias("speaker_id"),
        s.recode(codes, s.SEX_CODES).alias("sex"),
        F.when(healthy, "healthy").otherwise("pathological").alias("label"),
        s.blank_when("c_mktsegment", healthy).alias("pathology"),
    )


_BORN = "CAST(DATE '1930-01-01' + CAST((o_custkey * 37) % 20000 AS INTEGER) AS DATE)"


@query(
    "p04_age_at_event",
    f"""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_BORN} END AS born, CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT o_orderkey, CAST(floor(date_diff('day', born, day) / 365.25) AS INTEGER) AS age_floor,
           round(date_diff('day', born, day) / 365.25, 6) AS age_years FROM b""",
)
def p04(spark, d):
    o = fx.table(spark, d, "orders")
    text = F.date_format(F.date_add(F.lit("1930-01-01").cast("date"), ((F.col("o_custkey") * 37) % 20000).cast("int")), "yyyy-MM-dd")
    born = F.when(F.col("o_orderkey") % 13 == 0, "not a date").otherwise(text)
    return o.select("o_orderkey", s.as_date(born).alias("born"), F.to_date("o_orderdate").alias("day")).select(
        "o_orderkey", s.age_floor("born", "day").alias("age_floor"), F.round(s.age_years("born", "day"), 6).alias("age_years")
    )


@query(
    "p05_quality_predicate",
    f"""WITH {_SUBMISSIONS} SELECT event_id, status, value FROM submissions WHERE value >= 20 AND status IS NOT NULL""",
)
def p05(spark, d):
    return submissions(spark, d).where(s.passes_quality("value", "status", 20.0)).select("event_id", "status", "value")


_SIGNALS = """signals AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(x, lambda v: 0.0::DOUBLE)
      WHEN vec_id % 10 = 1 THEN list_transform(x, lambda v: 0.25::DOUBLE) WHEN vec_id % 10 = 2 THEN x[1:3] ELSE x END AS x
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"""


def signals(spark, d):
    """Embeddings as short signals, with silent, constant and truncated ones."""
    k = F.col("vec_id") % 10
    e = fx.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return e.withColumn(
        "x",
        F.when(k == 0, F.transform("x", lambda v: F.lit(0.0)))
        .when(k == 1, F.transform("x", lambda v: F.lit(0.25)))
        .when(k == 2, F.slice("x", 1, 3))
        .otherwise(F.col("x")),
    )


@query(
    "p06_signal_quality",
    f"""WITH {_SIGNALS} SELECT vec_id, CASE WHEN len(x) < 16 THEN 'too short (' || printf('%.3f', len(x) / 160.0) || 's)'
      WHEN list_max(list_transform(x, lambda v: abs(v))) = 0 THEN 'digital silence'
      WHEN list_stddev_pop(x) < 1e-6 THEN 'constant signal (no variation)' END AS reason FROM signals""",
)
def p06(spark, d):
    return signals(spark, d).select("vec_id", arr.quality_flag("x", rate=160).alias("reason"))


@query(
    "p07_label_binarisation",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_is, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS y_is_not,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'positive' WHEN o_orderpriority = '5-LOW' THEN 'negative' ELSE 'other' END AS y_sets,
      (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS healthy FROM orders""",
)
def p07(spark, d):
    o = fx.table(spark, d, "orders")
    o = o.withColumn("f1", F.when(F.col("o_orderkey") % 3 != 0, "x")).withColumn("f2", F.when(F.col("o_orderkey") % 2 != 0, "x"))
    return o.select(
        "o_orderkey",
        s.label_is("o_orderstatus", "F").alias("y_is"),
        s.label_is_not("o_orderstatus", "O").alias("y_is_not"),
        s.label_in_sets("o_orderpriority", ["1-URGENT", "2-HIGH"], ["5-LOW"]).alias("y_sets"),
        s.healthy_when_blank("f1", "f2").alias("healthy"),
    )


@query(
    "p08_missing_and_safe_cast",
    f"""WITH {_SUBMISSIONS} SELECT event_id, coalesce(nullif(trim(status), ''), 'MISSING') AS status,
      CASE WHEN isnan(TRY_CAST(age AS DOUBLE)) THEN NULL ELSE TRY_CAST(age AS DOUBLE) END AS age FROM submissions""",
)
def p08(spark, d):
    return submissions(spark, d).select("event_id", s.or_missing("status").alias("status"), s.number_or_null("age").alias("age"))


@query(
    "p09_source_fingerprint",
    f"""WITH t AS (SELECT lang, sha256(text) AS digest FROM documents) {h.order_free_digest_sql('t', 'digest', ['lang'])}""",
)
def p09_source(spark, d):
    docs = fx.table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("digest"))
    return h.order_free_digest(docs, "digest", ["lang"])


@query(
    "p09_label_fingerprint",
    f"""WITH {fx.SESSIONS}, t AS (SELECT session_id // 1000 AS block, session_id,
        concat_ws('|', speaker_id, session_id, y, sex, age, task) AS line FROM sessions),
      b AS (SELECT block, sha256(string_agg(line, chr(10) ORDER BY session_id)) AS digest FROM t GROUP BY block)
    SELECT sha256(string_agg(digest, chr(10) ORDER BY block)) AS fingerprint, count(*) AS n_blocks FROM b""",
)
def p09_labels(spark, d):
    rows = fx.sessions(spark, d).select(
        "session_id", F.concat_ws("|", "speaker_id", "session_id", "y", "sex", "age", "task").alias("line")
    )
    return h.ordered_digest(rows, order="session_id", line="line", block=1000)


@query(
    "p09_config_hash",
    """SELECT n_nationkey, substr(sha256('{"folds":5,"name":"' || n_name || '","region":' || n_regionkey || ',"seed":0}'), 1, 16) AS config_hash FROM nation""",
)
def p09_config(spark, d):
    n = fx.table(spark, d, "nation")
    text = h.canonical_json(
        [("seed", F.lit(0)), ("name", F.col("n_name")), ("region", F.col("n_regionkey")), ("folds", F.lit(5))]
    )
    return n.select("n_nationkey", h.short_sha256(text).alias("config_hash"))


@query(
    "p12_non_finite_policy",
    """WITH v AS (SELECT o_custkey, o_orderstatus, CASE o_orderkey % 9 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
        WHEN 2 THEN NULL ELSE o_totalprice END AS x FROM orders)
    SELECT o_orderstatus, count(*) AS n, count(*) FILTER (x IS NULL OR NOT isfinite(x)) AS n_imputed,
           round(sum(CASE WHEN isfinite(x) THEN x ELSE 0 END), 2) AS total,
           round(avg(CASE WHEN isfinite(x) THEN x END), 4) AS mean_finite FROM v GROUP BY 1""",
)
def p12(spark, d):
    k = F.col("o_orderkey") % 9
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k != 2, F.col("o_totalprice"))
    v = fx.table(spark, d, "orders").withColumn("x", x)
    finite = s.is_finite(F.col("x"))
    return v.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"),
        F.count_if(~finite).alias("n_imputed"),
        F.round(F.sum(s.finite_or_zero("x")), 2).alias("total"),
        F.round(F.avg(F.when(finite, F.col("x"))), 4).alias("mean_finite"),
    )


@query(
    "p13_acquisition_features",
    f"""WITH {_SIGNALS} SELECT vec_id, round(len(x) / 160.0, 6) AS duration_s, round(ln(1 + len(x) / 160.0), 6) AS log_duration,
      round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms FROM signals""",
)
def p13(spark, d):
    dur = F.size("x") / F.lit(160.0)
    return signals(spark, d).select(
        "vec_id", F.round(dur, 6).alias("duration_s"), F.round(F.log1p(dur), 6).alias("log_duration"), F.round(arr.rms("x"), 6).alias("rms")
    )


@query(
    "p14_crop_pad",
    f"""WITH {_SIGNALS} SELECT vec_id, CAST(least(len(x), 40) AS INTEGER) AS n_kept, CAST(greatest(least(len(x), 40), 8) AS INTEGER) AS n_out,
      round(list_sum(x[1:40]), 6) AS total FROM signals""",
)
def p14(spark, d):
    out, kept = arr.crop_or_pad("x", 8, 40)
    return signals(spark, d).select("vec_id", kept.alias("n_kept"), out.alias("o")).select(
        "vec_id", "n_kept", F.size("o").alias("n_out"), F.round(F.aggregate("o", F.lit(0.0), lambda a, v: a + v), 6).alias("total")
    )


@query(
    "p15_leak_scan",
    r"""WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
      p AS (SELECT 'bold' AS pattern, '\*\*[^*\n]+\*\*' AS re UNION ALL SELECT 'table_rule', '\|\s*-{3,}' UNION ALL SELECT 'heading', '(?m)^#{2,}\s'),
      m AS (SELECT kind, id, pattern, CASE pattern WHEN 'bold' THEN regexp_extract(text, '\*\*[^*\n]+\*\*') WHEN 'table_rule' THEN regexp_extract(text, '\|\s*-{3,}')
              ELSE regexp_extract(text, '(?m)^#{2,}\s') END AS snippet FROM t, p)
    SELECT * FROM m WHERE snippet <> ''""",
)
def p15(spark, d):
    pages = fx.table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = fx.table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs).select("kind", "id", F.inline(s.leaks("text")))


@query(
    "p16_identifier_extraction",
    r"""WITH i AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?:href|src)="/?([A-Za-z0-9_.-]+)', 1)) AS identifier FROM pages)
    SELECT identifier, count(*) AS n_pages FROM i GROUP BY 1""",
)
def p16(spark, d):
    pages = fx.table(spark, d, "pages")
    ids = pages.select("page_id", F.explode(s.identifiers("html", r'(?:href|src)="/?([A-Za-z0-9_.-]+)')).alias("identifier"))
    return ids.distinct().groupBy("identifier").agg(F.count("*").alias("n_pages"))


@query(
    "p17_lookup_violations",
    r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS found FROM pages
    WHERE nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') IS NULL UNION ALL
    SELECT NULL, CAST(count(*) AS VARCHAR) FROM pages WHERE nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') IS NOT NULL""",
)
def p17(spark, d):
    t = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    pages = fx.table(spark, d, "pages").select("page_id", F.when(t != "", t).alias("found"))
    ok = pages.where("found IS NOT NULL").select(s.found_or_raise(F.col("found"), "title").alias("found"))
    total = ok.agg(F.count("found").cast("string").alias("found")).select(F.lit(None).cast("bigint").alias("page_id"), "found")
    return pages.where("found IS NULL").unionByName(total)


@query(
    "p18_tier_and_status",
    """WITH r AS (SELECT o_custkey, count(*) AS repeats, max(o_orderpriority) AS txt FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN o_custkey % 10 = 0 THEN 'CONTROL' WHEN repeats >= 8 THEN 'EVALUATION' ELSE 'SCREENING' END AS tier,
      CASE o_custkey % 5 WHEN 0 THEN 'UNTESTED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FALSIFIED' WHEN 3 THEN 'CLAIM SUPPORTED' ELSE txt END AS status FROM r""",
)
def p18(spark, d):
    runs = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("repeats"), F.max("o_orderpriority").alias("txt"))
    words = F.array(F.lit("untested so far"), F.lit("Partial: 2 of 3"), F.lit("claim falsified"), F.lit("supported"), F.col("txt"))
    runs = runs.withColumn("status", F.element_at(words, (F.col("o_custkey") % 5 + 1).cast("int")))
    return runs.select(
        "o_custkey",
        s.evidence_tier(F.col("repeats"), F.col("o_custkey") % 10 == 0).alias("tier"),
        s.status_class("status").alias("status"),
    )
