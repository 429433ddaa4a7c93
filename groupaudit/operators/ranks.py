"""Ranks and prefix sums that never put a whole group into one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TREE_LEAVES = 256  # a comparison tree up to this size stays one small generated method


def _parallelism(df: DataFrame) -> int:
    """The cluster's shuffle width: how many buckets it takes to keep every task busy."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def quantile_bounds(df: DataFrame, column: str, n_buckets: int | None = None) -> list[float]:
    """Inner bucket edges from a mergeable quantile sketch: one pass, at most n_buckets floats.

    The edges steer load balance only; results are exact for any edges.  The default number
    follows the shuffle width.
    """
    n = n_buckets or min(max(64, _parallelism(df)), 4096)
    probs = [i / n for i in range(1, n)]
    sketch = F.percentile_approx(F.col(column).cast("double"), probs, 8 * n)
    edges = df.agg(sketch.alias("q")).first()["q"]
    return sorted({e for e in edges or [] if not math.isnan(e)})


def bucket_of(score: Column, bounds: Sequence[float]) -> Column:
    """Index of the bucket holding ``score``: a balanced tree of comparisons.

    With many edges the tree picks a run of edges and the position inside it is counted.
    """

    def tree(edges: Sequence[float], lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(score < F.lit(float(edges[mid])), tree(edges, lo, mid)).otherwise(tree(edges, mid + 1, hi))

    if len(bounds) < TREE_LEAVES:
        return tree(bounds, 0, len(bounds))
    run = -(-len(bounds) // 64)
    block = tree(bounds[run - 1 :: run], 0, len(bounds[run - 1 :: run]))
    edges = F.slice(F.array(*[F.lit(float(b)) for b in bounds]), block * run + 1, F.lit(run))
    return (block * run + F.size(F.filter(edges, lambda e: e <= score))).cast("int")


def rank_by_bucket(
    df: DataFrame, *, part: Sequence[str], bucket: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """Exact row_number over (part, order) given a bucket that is monotone in ``order``.

    Windows run inside (part, bucket); a table of per-bucket counts supplies offsets.
    """
    part = list(part)
    d = df.withColumn("_bucket", bucket)
    sizes = d.groupBy(*part, "_bucket").agg(F.count("*").alias("_n"))
    over_buckets = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *part, "_bucket", F.coalesce(F.sum("_n").over(over_buckets), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(*part, "_bucket").orderBy(*order)
    ranked = d.withColumn("_rn", F.row_number().over(local))
    keys = [ranked[c].eqNullSafe(offsets[c]) for c in part + ["_bucket"]]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    return ranked.join(offsets, cond).select(
        *[ranked[c] for c in df.columns], (F.col("_rn") + F.col("_offset")).alias(out)
    )


def hash_rank(
    df: DataFrame, *, part: Sequence[str] = (), key: str, out: str = "rn", digits: int | None = None
) -> DataFrame:
    """Exact row_number in the order of a hex digest column.

    A digest is uniform, so its leading hex digits cut every group into 16**digits
    even buckets, however large the group is.  The default follows the shuffle width.
    """
    part = list(part)
    digits = digits or max(2, math.ceil(math.log(4 * _parallelism(df), 16)))
    base = df if part else df.withColumn("_all", F.lit(0))
    ranked = rank_by_bucket(
        base,
        part=part or ["_all"],
        bucket=F.substring(key, 1, digits),
        order=[F.col(key)],
        out=out,
    )
    return ranked.select(*df.columns, out)


def value_rank(
    df: DataFrame,
    *,
    part: Sequence[str] = (),
    value: str,
    tie: str,
    out: str = "rn",
    bounds: Sequence[float] | None = None,
    ascending: bool = True,
) -> DataFrame:
    """Exact row_number by a numeric value with a unique tie-break, bucketed on quantiles."""
    part = list(part)
    bounds = quantile_bounds(df, value) if bounds is None else bounds
    base = df if part else df.withColumn("_all", F.lit(0))
    base = base.withColumn("_h", F.md5(F.col(tie).cast("string").cast("binary")))
    # One value may hold a large share of the rows.  Such a value is a quantile edge, hence the
    # smallest of its bucket; its rows are spread over sub-buckets of the tie-break's hash.
    sign, edge_tag, rest_tag = (1, "0", "1") if ascending else (-1, "2", "1")
    value_col = F.col(value)
    on_edge = value_col.isin([float(b) for b in bounds]) if bounds else F.lit(False)
    sub = F.when(on_edge, F.concat(F.lit(edge_tag), F.substring("_h", 1, 2))).otherwise(F.lit(rest_tag))
    ranked = rank_by_bucket(
        base,
        part=part or ["_all"],
        bucket=F.struct((bucket_of(value_col, bounds) * sign).alias("b"), sub.alias("s")),
        order=[value_col * sign, F.col("_h"), F.col(tie)],
        out=out,
    )
    return ranked.select(*df.columns, out)


def running_before(
    df: DataFrame,
    *,
    part: Sequence[str] = (),
    order: str,
    tie: str,
    last: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    maxs: dict[str, str] | None = None,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Adds prefix values over the rows strictly before each row of its partition.

    ``last`` is the previous row's value (a lag), ``sums`` running sums, ``maxs`` running maxima;
    each maps an output name to a column.  Windows run inside (part, order bucket) and a small
    table of bucket totals carries values across buckets, so one long history is spread out.
    """
    last, sums, maxs = last or {}, sums or {}, maxs or {}
    bounds = quantile_bounds(df, order) if bounds is None else bounds
    part = list(part)
    keys = part or ["_all"]
    d = df if part else df.withColumn("_all", F.lit(0))
    d = d.withColumn("_b", bucket_of(F.col(order), bounds))
    pos = F.struct(F.col(order), F.col(tie))
    totals = d.groupBy(*keys, "_b").agg(
        *[F.max_by(F.struct(c), pos).alias(f"_t_{o}") for o, c in last.items()],
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()],
        *[F.max(c).alias(f"_t_{o}") for o, c in maxs.items()],
    )
    buckets = Window.partitionBy(*keys).orderBy("_b")
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, "_b"]],
        *[F.lag(f"_t_{o}").over(buckets)[c].alias(f"_o_{o}") for o, c in last.items()],
        *[F.sum(f"_t_{o}").over(earlier).alias(f"_o_{o}") for o in sums],
        *[F.max(f"_t_{o}").over(earlier).alias(f"_o_{o}") for o in maxs],
    )
    rows = Window.partitionBy(*keys, "_b").orderBy(order, tie)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    inside = d.select(
        "*",
        (F.row_number().over(rows) == 1).alias("_first"),
        *[F.lag(c).over(rows).alias(f"_i_{o}") for o, c in last.items()],
        *[F.sum(c).over(before).alias(f"_i_{o}") for o, c in sums.items()],
        *[F.max(c).over(before).alias(f"_i_{o}") for o, c in maxs.items()],
    )
    cond = F.lit(True)
    for k in [*keys, "_b"]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    zero = F.lit(0)
    return inside.join(offsets, cond).select(
        *df.columns,
        *[F.when(F.col("_first"), F.col(f"_o_{o}")).otherwise(F.col(f"_i_{o}")).alias(o) for o in last],
        *[(F.coalesce(F.col(f"_o_{o}"), zero) + F.coalesce(F.col(f"_i_{o}"), zero)).alias(o) for o in sums],
        *[F.greatest(f"_o_{o}", f"_i_{o}").alias(o) for o in maxs],
    )


def values_at_ranks(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """``sorted(values)[rank(n)]`` per group for several ranks, plus ``n``.

    Equal values collapse to counts; only the buckets that hold a wanted rank are sorted.
    """
    by = list(by)
    keys = by or ["_all"]
    bounds = quantile_bounds(df, value) if bounds is None else bounds
    d = df.where(F.col(value).isNotNull())
    d = d if by else d.withColumn("_all", F.lit(0))
    counts = d.groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_b", bucket_of(F.col(value), bounds))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bn"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        "_b",
        "_bn",
        F.coalesce(F.sum("_bn").over(upto), F.lit(0)).alias("_before"),
        F.sum("_bn").over(whole).alias("n"),
    )
    targets = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), fn(F.col("n")).cast("bigint").alias("k")) for o, fn in ranks.items()]))
    hit = (
        totals.select(*keys, "_b", "_bn", "_before", "n", targets.alias("_t"))
        .where((F.col("_before") <= F.col("_t.k")) & (F.col("_t.k") < F.col("_before") + F.col("_bn")))
        .groupBy(*keys, "_b", "_before", "n")
        .agg(F.collect_list("_t").alias("_ts"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value)
    found = counts.join(hit, [*keys, "_b"]).withColumn("_cum", F.col("_before") + F.sum("_c").over(inside))
    mine = F.explode(F.filter("_ts", lambda t: (t["k"] < F.col("_cum")) & (t["k"] >= F.col("_cum") - F.col("_c"))))
    picked = found.select(*keys, "n", value, mine.alias("_t"))
    out = picked.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_t.o") == o, F.col(value))).alias(o) for o in ranks])
    return out.select(*by, "n", *ranks)


def exact_percentiles(df: DataFrame, *, by: Sequence[str] = (), value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles (the NumPy default) per group, without a per-group buffer."""
    pos = lambda q: (lambda n: F.lit(q) * (n - 1))
    ranks = {}
    for o, q in qs.items():
        ranks[f"{o}_lo"] = lambda n, f=pos(q): F.floor(f(n))
        ranks[f"{o}_hi"] = lambda n, f=pos(q): F.ceil(f(n))
    v = values_at_ranks(df, by=by, value=value, ranks=ranks)
    mix = lambda o, q: F.col(f"{o}_lo") + (pos(q)(F.col("n")) - F.floor(pos(q)(F.col("n")))) * (F.col(f"{o}_hi") - F.col(f"{o}_lo"))
    return v.select(*by, "n", *[mix(o, q).alias(o) for o, q in qs.items()])
