"""Queries over the split audits and data contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.functions.hashing import order_free_digest_sql
from groupaudit.operators import audits as a
from groupaudit.operators import splits as sp
from groupaudit.plans import fixtures as fx
from groupaudit.plans.registry import query
from groupaudit.session import materialise

_NAME = "CASE {k} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"
SPLITS = f"""{fx.SESSIONS}, sp AS (
   SELECT *, {_NAME.format(k="CASE WHEN speaker_id % 50 = 0 THEN session_id % 5 ELSE speaker_id % 5 END")} AS split FROM sessions
   UNION ALL SELECT *, 'test' FROM sessions WHERE session_id % 300 = 0)"""


def _split_name(k):
    return F.when(k == 0, "test").when(k == 1, "val").otherwise("train")


def split_table(spark, d):
    """Sessions split by customer, with scattered customers and some sessions listed twice."""
    s = fx.sessions(spark, d)
    k = F.when(F.col("speaker_id") % 50 == 0, F.col("session_id") % 5).otherwise(F.col("speaker_id") % 5)
    extra = s.where("session_id % 300 = 0").withColumn("split", F.lit("test"))
    return s.withColumn("split", _split_name(k)).unionByName(extra)


def verdict_sql(violations: str, check: str, example: str, fail: str = "FAIL") -> str:
    """Audit row of a violations query; written as a subquery so it composes."""
    return f"""SELECT '{check}' AS "check", status, n_violations, example,
      substr(sha256(concat_ws('|', '{check}', status, n_violations, coalesce(example, ''))), 1, 16) AS fingerprint
    FROM (SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE '{fail}' END AS status, count(*) AS n_violations, min(CAST({example} AS VARCHAR)) AS example FROM ({violations}))"""


@query(
    "d01_index_disjoint",
    f"WITH {SPLITS} " + verdict_sql("SELECT session_id FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1", "index_disjoint", "session_id"),
)
def d01(spark, d):
    return a.index_disjoint(split_table(spark, d), unit="session_id", split="split")


_SIZE_OFF = """SELECT 'size:' || split AS e FROM (SELECT split, count(*) AS n FROM sp GROUP BY 1) JOIN
   (SELECT split, CASE split WHEN 'train' THEN 0.6 ELSE 0.2 END * (SELECT count(*) FROM sessions) AS x FROM (SELECT unnest(['train', 'val', 'test']) AS split)) USING (split)
   WHERE abs(n - x) > 0.005 * x"""
_GROUP_OFF = f"""SELECT DISTINCT 'group:' || speaker_id AS e FROM (SELECT DISTINCT speaker_id, split FROM sp) WHERE split <> {_NAME.format(k='speaker_id % 5')}"""


@query("d02_protocol_match", f"WITH {SPLITS} " + verdict_sql(f"{_SIZE_OFF} UNION ALL SELECT 'group:' || speaker_id FROM (SELECT DISTINCT speaker_id, split FROM sp) WHERE split <> {_NAME.format(k='speaker_id % 5')}", "protocol_match", "e"))
def d02(spark, d):
    s = split_table(spark, d)
    n = fx.sessions(spark, d).agg(F.count("*")).scalar()
    splits = F.explode(F.array(F.lit("train"), F.lit("val"), F.lit("test"))).alias("split")
    share = F.when(F.col("split") == "train", 0.6).otherwise(0.2)
    expected = spark.range(1).select(splits).select("split", (share * n).alias("n_expected"))
    prescribed = fx.sessions(spark, d).select("speaker_id").distinct().select("speaker_id", _split_name(F.col("speaker_id") % 5).alias("split"))
    return a.protocol_match(s, expected, split="split", group="speaker_id", prescribed=prescribed)


@query(
    "d03_size_floors",
    f"WITH {SPLITS}, f AS (SELECT unnest(['train', 'val', 'test', 'ood']) AS split, unnest([100, 4000, 100, 10]) AS floor) "
    + verdict_sql("SELECT f.split || ':' || coalesce(n, 0) AS e FROM f LEFT JOIN (SELECT split, count(*) AS n FROM sp GROUP BY 1) USING (split) WHERE coalesce(n, 0) < floor", "size_floors", "e"),
)
def d03(spark, d):
    rows = [("train", 100), ("val", 4000), ("test", 100), ("ood", 10)]
    return a.size_floors(split_table(spark, d), spark.createDataFrame(rows, "split string, floor long"), split="split")


@query(
    "d04_class_balance",
    f"WITH {SPLITS} " + verdict_sql("SELECT split || '/' || status AS s FROM sp GROUP BY ALL HAVING avg(y) <= 0 OR avg(y) >= 1 OR avg(y) < 0.4 OR avg(y) > 0.5", "class_balance", "s"),
)
def d04(spark, d):
    s = split_table(spark, d).withColumn("cell", F.concat_ws("/", "split", "status"))
    return a.class_balance(s, split="cell", label="y", lo=0.4, hi=0.5)


@query(
    "d05_split_keys_not_features",
    f"""WITH {SPLITS} """ + verdict_sql("""SELECT 'alias=speaker_id' AS e WHERE (SELECT count(DISTINCT speaker_id * 3 + 1) = count(DISTINCT speaker_id) FROM sp)
      UNION ALL SELECT 'site' AS e""", "split_keys_not_features", "e"),
)
def d05(spark, d):
    s = split_table(spark, d).withColumn("alias", F.col("speaker_id") * 3 + 1)
    return a.split_keys_not_features(s, keys=["speaker_id", "site"], features=["age", "site", "duration", "alias"])


_FEATS = """f AS (SELECT split, CASE WHEN session_id % 700 = 0 THEN 'NaN'::DOUBLE ELSE duration END AS duration, age::DOUBLE AS age FROM sp),
  st AS (SELECT avg(age) AS m, stddev_pop(age) AS s FROM f), tr AS (SELECT avg(age) AS m, stddev_pop(age) AS s FROM f WHERE split = 'train')"""


@query(
    "d06_feature_consistency",
    f"WITH {SPLITS}, {_FEATS} " + verdict_sql("""SELECT 'nonfinite:duration' AS e FROM (SELECT count(*) AS n FROM f WHERE isnan(duration)) WHERE n > 0
       UNION ALL SELECT 'scaler:age' FROM st, tr WHERE abs(st.m - tr.m) > 1e-6 * greatest(1, abs(tr.m)) OR abs(st.s - tr.s) > 1e-6 * greatest(1, tr.s)""", "feature_consistency", "e"),
)
def d06(spark, d):
    """The scaler was fitted on all splits: the audit must notice."""
    s = split_table(spark, d).withColumn("age", F.col("age").cast("double"))
    s = s.withColumn("duration", F.when(F.col("session_id") % 700 == 0, float("nan")).otherwise(F.col("duration")))
    leak = s.agg(F.avg("age").alias("mean"), F.stddev_pop("age").alias("std")).select(F.lit("age").alias("feature"), "mean", "std")
    return a.feature_consistency(s, split="split", train="train", features=["duration", "age"], scaler=leak)


@query(
    "d06_split_schemas",
    f"WITH {SPLITS} " + verdict_sql("""SELECT unnest(['extra:test:note', 'missing:val:duration', 'type:test:age:string<>bigint']) AS e
       UNION ALL SELECT 'nonfinite:site' FROM (SELECT count(*) AS n FROM sp WHERE split = 'val' AND session_id % 50 = 0) WHERE n > 0""", "split_schemas", "e"),
)
def d06_schemas(spark, d):
    """Three tables: one lacks a feature, one has a type and a column of its own, one a hole."""
    s = split_table(spark, d).select("session_id", "split", "age", "duration", "site")
    own = {n: s.where(F.col("split") == n).drop("split") for n in ("train", "val", "test")}
    own["val"] = own["val"].drop("duration").withColumn("site", F.when(F.col("session_id") % 50 != 0, F.col("site")))
    own["test"] = own["test"].withColumn("age", F.col("age").cast("string")).withColumn("note", F.lit("x"))
    return a.split_schemas(own, train="train", features=["age", "duration", "site"])


@query(
    "d07_group_disjoint",
    f"WITH {SPLITS} " + verdict_sql("""SELECT CAST(speaker_id AS VARCHAR) AS e FROM sp GROUP BY speaker_id HAVING count(DISTINCT split) > 1
      UNION ALL SELECT DISTINCT 'proxy:' || speaker_id FROM sp WHERE site = 4 AND speaker_id % 100 = 1""", "group_disjoint", "e", "REFUSED"),
)
def d07(spark, d):
    proxy = (F.col("site") == 4) & (F.col("speaker_id") % 100 == 1)
    s = split_table(spark, d).withColumn("prov", F.when(proxy, "recording_proxy").otherwise("participant"))
    return a.group_disjoint(s, group="speaker_id", split="split", provenance="prov")


@query(
    "d08_temporal_order",
    """WITH s AS (SELECT CASE WHEN o_orderdate < '1998-01-01' THEN 'train' WHEN o_orderdate < '2000-01-01' THEN 'val' ELSE 'test' END AS split, o_orderdate AS ts FROM orders),
      b AS (SELECT split, min(ts) AS lo, max(ts) AS hi, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS pos FROM s GROUP BY 1),
      n AS (SELECT *, lead(lo) OVER (ORDER BY pos) AS nxt FROM b) """
    + verdict_sql("SELECT split FROM n WHERE hi + INTERVAL 7 DAY >= nxt", "temporal_order", "split"),
)
def d08(spark, d):
    day = F.col("o_orderdate").cast("date")
    o = fx.table(spark, d, "orders").withColumn(
        "split", F.when(day < F.lit("1998-01-01").cast("date"), "train").when(day < F.lit("2000-01-01").cast("date"), "val").otherwise("test")
    )
    return a.temporal_order(o, split="split", ts="o_orderdate", order=["train", "val", "test"], gap_seconds=7 * 86_400)


_LAG = """lag AS (SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS expected, value FROM events)"""


@query(
    "d09_no_lookahead",
    f"WITH {_LAG} " + verdict_sql("SELECT event_id FROM lag WHERE event_id % 97 = 0 AND (expected IS NULL OR abs((expected + value) / 2 - expected) > 1e-9)", "no_lookahead", "event_id"),
)
def d09(spark, d):
    """A stored lag feature into which every 97th row mixed its own value."""
    e = fx.table(spark, d, "events")
    args = dict(key="user_id", ts="ts", value="value", unit="event_id", seconds=86_400)
    true = a.lookback_mean(e, **args).select("event_id", "expected")
    bad = F.when(F.col("event_id") % 97 == 0, F.coalesce((F.col("expected") + F.col("value")) / 2, "value")).otherwise(F.col("expected"))
    # kept, as every scan of the audit would derive the feature again
    stored = materialise(e.join(true, "event_id").withColumn("stored", bad).select("event_id", "user_id", "ts", "value", "stored"))
    return a.no_lookahead(stored, stored="stored", **args)


@query(
    "d09_lookback_mean",
    f"WITH {_LAG} SELECT event_id, user_id, round(expected, 6) AS expected FROM lag",
)
def d09_feature(spark, d):
    out = a.lookback_mean(fx.table(spark, d, "events"), key="user_id", ts="ts", value="value", unit="event_id", seconds=86_400)
    return out.withColumn("expected", F.round("expected", 6))


_EDGES = """e AS (SELECT l_partkey AS src, 1000000 + l_suppkey AS dst, CASE l_linenumber WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM lineitem)"""


@query(
    "d10_edge_node_disjoint",
    f"WITH {_EDGES} "
    + verdict_sql("SELECT least(src, dst) || '-' || greatest(src, dst) AS x FROM e GROUP BY 1 HAVING count(DISTINCT split) > 1", "edges_disjoint_transductive", "x")
    + " UNION ALL "
    + verdict_sql("SELECT x FROM (SELECT src AS x, split FROM e UNION ALL SELECT dst, split FROM e) GROUP BY 1 HAVING count(DISTINCT split) > 1", "edges_disjoint_inductive", "x"),
)
def d10(spark, d):
    li = fx.table(spark, d, "lineitem")
    e = li.select(
        F.col("l_partkey").alias("src"),
        (F.col("l_suppkey") + 1_000_000).alias("dst"),
        F.when(F.col("l_linenumber") == 1, "test").when(F.col("l_linenumber") == 2, "val").otherwise("train").alias("split"),
    )
    kinds = [a.edges_disjoint(e, src="src", dst="dst", split="split", mode=m) for m in ("transductive", "inductive")]
    return kinds[0].unionByName(kinds[1])


@query(
    "d11_reproducibility",
    f"""WITH {SPLITS}, t AS (SELECT split, sha256(split || '|' || session_id) AS digest FROM sp), f AS ({order_free_digest_sql('t', 'digest', ['split'])})
    SELECT 'reproducibility' AS "check", 'PASS' AS status, 0::BIGINT AS n_violations, CAST(sum(n_rows) AS BIGINT) || ' ids' AS example,
      substr(sha256(string_agg(split || ':' || n_rows || ':' || fingerprint, chr(10) ORDER BY split) || chr(10) || 'age,duration'), 1, 16) AS fingerprint FROM f""",
)
def d11(spark, d):
    return a.reproducibility(split_table(spark, d), unit="session_id", split="split", features=["duration", "age"], age_hours=2.0)


_SIDES = """tr AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS unit, CASE l_returnflag WHEN 'A' THEN 'R' ELSE l_returnflag END AS tgt, l_quantity AS q, l_extendedprice AS x FROM lineitem WHERE l_linenumber > 2),
  ev AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS unit, l_returnflag AS tgt, l_quantity AS q, l_extendedprice AS x FROM lineitem WHERE l_linenumber <= 2),
  tg AS (SELECT unit, CASE WHEN md5(unit) < '8' THEN tgt ELSE 'swapped' END AS tgt FROM ev WHERE q < 50)"""


def _range_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM ev), (SELECT list_sort(list({c})) AS v, count(*) AS n FROM tr)
      WHERE lo < v[CAST(floor(n * 0.01::DOUBLE) AS BIGINT) + 1] - 500 OR hi > v[CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1] + 500"""


@query(
    "d12_loader_contract",
    f"WITH {_SIDES} "
    + " UNION ALL ".join(
        [
            verdict_sql("SELECT 1 AS e WHERE FALSE", "schema_equal", "e"),
            verdict_sql("SELECT DISTINCT tgt FROM ev WHERE tgt NOT IN (SELECT tgt FROM tr)", "target_subset", "tgt"),
            verdict_sql(f"{_range_sql('q')} UNION ALL {_range_sql('x')}", "value_range", "feature"),
            verdict_sql("SELECT unit FROM (SELECT unit, count(*) AS n FROM ev GROUP BY 1) a FULL JOIN (SELECT unit, count(*) AS n FROM tg GROUP BY 1) b USING (unit) WHERE a.n IS DISTINCT FROM b.n", "pair_count", "unit"),
            verdict_sql("SELECT unit FROM (SELECT unit, tgt FROM ev ORDER BY md5(concat_ws('|', 0, unit)), unit LIMIT 8) a JOIN tg b USING (unit) WHERE a.tgt <> b.tgt", "index_pair", "unit"),
        ]
    ),
)
def d12(spark, d):
    li = fx.table(spark, d, "lineitem")
    cols = [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit"),
        F.col("l_returnflag").alias("tgt"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("x"),
    ]
    # every row is on a side; the training side lacks one target, the target table some units and labels
    train = li.where("l_linenumber > 2").select(*cols).replace("A", "R", "tgt")
    ev = li.where("l_linenumber <= 2").select(*cols)
    kept = F.when(F.md5(F.col("unit").cast("binary")) < "8", F.col("tgt")).otherwise("swapped")
    targets = ev.where("q < 50").select("unit", kept.alias("tgt"))
    return a.loader_contract(train, ev, unit="unit", target="tgt", features=["q", "x"], delta=500.0, targets=targets)
