"""Grouped repeated-measures views over the driver tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """One order = one session of a customer."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("session_id"),
            F.col("c_custkey").alias("speaker_id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("y"),
            F.floor((F.col("c_acctbal") + 1000) / 110).cast("bigint").alias("age"),
            F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("sex"),
            F.col("n_regionkey").alias("site"),
            F.col("o_orderdate").alias("recorded"),
            F.col("o_totalprice").alias("duration"),
            F.col("o_orderpriority").alias("task"),
            F.col("c_mktsegment").alias("archive"),
            F.col("o_orderstatus").alias("status"),
        )
    )


SESSIONS = """sessions AS (
  SELECT o_orderkey AS session_id, c_custkey AS speaker_id,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         CAST(floor((c_acctbal + 1000) / 110) AS BIGINT) AS age,
         CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
         n_regionkey AS site, o_orderdate AS recorded, o_totalprice AS duration,
         o_orderpriority AS task, c_mktsegment AS archive, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """One event = one recording of a user; the label belongs to the user."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("recording_id"),
        F.col("user_id").alias("speaker_id"),
        (F.col("user_id") % 3 == 0).cast("int").alias("y"),
        F.col("event_type").alias("task"),
        F.col("value").alias("duration"),
        "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


RECORDINGS = """recordings AS (
  SELECT event_id AS recording_id, user_id AS speaker_id,
         CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y,
         event_type AS task, value AS duration, ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """One line item = one scored unit of a supplier; a tied and a nearly tie-free score."""
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"),
        F.col("l_suppkey").alias("group_id"),
        F.col("l_orderkey").alias("session_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") / 50).alias("p"),
        (F.col("l_discount") * 10).alias("p2"),
        F.col("l_extendedprice").alias("raw"),
        F.col("l_linestatus").alias("site"),
        F.col("l_linenumber").alias("task"),
    )


SCORES = """scores AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_id,
         l_suppkey AS group_id, l_orderkey AS session_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         l_quantity / 50 AS p, l_discount * 10 AS p2, l_extendedprice AS raw,
         l_linestatus AS site, l_linenumber AS task
  FROM lineitem)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """One embedding = one recording; groups are label-pure."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("recording_id"),
        F.concat_ws("-", "label", F.col("vec_id") % 6).alias("speaker_id"),
        (F.col("label") < 5).cast("int").alias("y"),
        F.col("label").alias("cls"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"),
    )


FEATURES = """features AS (
  SELECT vec_id AS recording_id, concat_ws('-', label, vec_id % 6) AS speaker_id,
         CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, label AS cls,
         CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings)"""


def mixed_features(spark: SparkSession, d: str) -> DataFrame:
    """The same embeddings under groups that carry both labels."""
    return features(spark, d).withColumn("speaker_id", (F.col("recording_id") % 50).cast("string"))


def labelled_docs(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", F.sha2("text", 256).alias("sha256")
    )


LABELLED_DOCS = """labelled_docs AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic, sha256(text) AS sha256
  FROM documents JOIN labels USING (doc_id))"""
