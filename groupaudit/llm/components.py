"""Connected components by alternating large and small stars, every round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with an edge; root is the smallest node reachable.

    ``edges`` has longs (u, v) in any order, loops and repeats allowed; null ends are ignored.  A
    round moves edges, never more than there are, so a node with very many edges costs one row each.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, mark = stored(e, "edges"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(low, F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = smallest(large).select(F.col("u").alias("u2"), "m")
        joined = large.join(low, F.col("u") == F.col("u2"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("u2").alias("u"), F.col("m").alias("v")))
        e = stored(small.distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
        mark = tuple(now)
