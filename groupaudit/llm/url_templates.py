"""URL filter by path templates: a tree per host whose nodes carry labelled purity.

1. Explicit rules (host suffix, path prefix, verdict) judge what they fit; the longest one wins.  What
   they judge are also the labels that the method learns from.
2. A path's segments are generalised: digits, long hexadecimal runs and letter-digit mixes become
   wildcards with the extension kept.  A segment under a node that has many different children, most
   of them seen once, becomes a wildcard as well.
3. Siblings whose labelled rates cannot be told apart (the interval of the smoothed rate lies on the
   same side of the threshold, or on neither) and that have the same depth below are merged into one
   branch.
4. A node's purity is its block rate smoothed towards its parent's, from the table's rate down to the
   template.  A URL without a rule takes the purity of its deepest node; at the threshold or above it
   is blocked.

All of it is counting per node, with partial sums before every shuffle, level by level down to
``levels``; deeper segments together are one last segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import stored

BLOCK, ALLOW = "block", "allow"
Z = 1.96  # of a 95 % interval


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def generalised(segment: Column) -> Column:
    """A segment's shape: variable parts as wildcards, the extension kept."""
    name = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1)
    extension = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    shape = (
        F.when(name.rlike(r"^\d+$"), "{n}")
        .when(name.rlike(r"^[0-9a-fA-F-]{8,}$"), "{hex}")
        .when(name.rlike(r"\d") & name.rlike(r"[A-Za-z]"), "{id}")
        .otherwise(name)
    )
    return F.concat(shape, extension)


def _segments(path: Column, levels: int) -> Column:
    raw = F.filter(F.split(path, "/"), lambda s: s != "")
    head = F.transform(F.slice(raw, 1, levels), generalised)
    tail = F.array_join(F.transform(F.slice(raw, levels + 1, 1 << 20), generalised), "/")
    return F.when(F.size(raw) > levels, F.concat(head, F.array(tail))).otherwise(head)


def _purity(blocked: Column, labelled: Column, parent: Column, weight: float) -> Column:
    return (blocked + weight * parent) / (labelled + weight)


def template_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    page_id: str = "page_id",
    url: str = "url",
    levels: int = 8,
    fan_out: int = 16,
    once: float = 0.5,
    weight: float = 2.0,
    threshold: float = 0.5,
) -> DataFrame:
    """One row (page_id, host, path, rule, verdict, template, purity) per page.

    Null urls and urls without ``://`` have empty host and path and are judged like any other.  Null
    ids, repeated rows and repeated urls each give a row; counts are over rows.  Without a labelled
    row the purity is 0 everywhere.  Other columns are ignored; an empty table gives no row.
    """
    u = F.col("_u")
    parsed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_u")).select(
        "page_id", host_of(u).alias("host"), path_of(u).alias("path")
    )
    ruled = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    # rows of one host and shape collapse first: everything below is on distinct shapes
    shapes = (
        ruled.select("host", _segments(F.col("path"), levels).alias("segs"), F.col("r.verdict").alias("v"))
        .groupBy("host", "segs")
        .agg(F.count("*").alias("n"), F.count("v").alias("labelled"), F.count(F.when(F.col("v") == BLOCK, 1)).alias("blocked"))
    )
    total = shapes.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("p")).first()["p"]
    sums = (F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    hosts = shapes.groupBy("host").agg(*sums).select("host", _purity(F.col("blocked"), F.col("labelled"), F.lit(float(total)), weight).alias("purity"))
    tree = shapes.join(hosts, "host").withColumn("node", F.lit(""))
    depth = shapes.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0]
    for level in range(depth):
        here = F.get("segs", F.lit(level))
        children = tree.where(here.isNotNull()).groupBy("host", "node", here.alias("seg")).agg(*sums, F.max(F.size("segs")).alias("below"), F.first("purity").alias("up"))
        fans = children.groupBy("host", "node").agg(F.count("*").alias("fan"), F.avg((F.col("n") == 1).cast("double")).alias("single"))
        variable = (F.col("fan") >= fan_out) & (F.col("single") >= once)
        rate = _purity(F.col("blocked"), F.col("labelled"), F.col("up"), weight)
        half = F.lit(Z) * F.sqrt(rate * (1 - rate) / (F.col("labelled") + weight))
        side = F.when(rate - half >= threshold, "+").when(rate + half < threshold, "-").otherwise("?")
        # a merged branch is named by what its members share; a branch of its own by its segment
        branch = F.when(variable, F.concat(F.lit("*"), side, F.col("below").cast("string"))).otherwise(F.col("seg"))
        named = children.join(fans, ["host", "node"]).withColumn("branch", branch)
        merged = named.groupBy("host", "node", "branch").agg(*sums, F.first("up").alias("up"))
        merged = merged.select("host", "node", "branch", _purity(F.col("blocked"), F.col("labelled"), F.col("up"), weight).alias("p"))
        step = named.select("host", "node", "seg", "branch").join(merged, ["host", "node", "branch"])
        step = step.select(F.col("host").alias("_h"), F.col("node").alias("_n"), F.col("seg").alias("_s"), "branch", "p")
        grown = tree.join(step, (F.col("host") == F.col("_h")) & (F.col("node") == F.col("_n")) & (here == F.col("_s")), "left").select(
            "host", "segs", "n", "labelled", "blocked", F.coalesce("p", "purity").alias("purity"),
            F.when(F.col("branch").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "branch")).alias("node"),
        )
        tree = stored(grown, "templates")  # the next level reads it several times
    judged = tree.select(F.col("host").alias("_h"), F.col("segs").alias("_segs"), F.col("node").alias("template"), "purity")
    found = ruled.withColumn("segs", _segments(F.col("path"), levels)).join(judged, (F.col("host") == F.col("_h")) & (F.col("segs") == F.col("_segs")), "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") >= threshold, BLOCK).otherwise(ALLOW))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
