"""Exact classification metrics as grouped aggregations.

Every metric takes an optional weight column, so a bootstrap replicate is just
another grouping key.  Rows with a missing score or label are excluded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.functions.hashing import col
from groupaudit.operators.ranks import bucket_of, quantile_bounds, value_rank


def _usable(score: str, label: str) -> Column:
    s = F.col(score)
    return s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def roc_auc(
    df: DataFrame,
    *,
    score: str,
    label: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Mann-Whitney AUC with ties counted one half; NULL when a class is absent.

    The AUC numerator is split over score buckets: pairs inside a bucket need only that
    bucket's sorted distinct scores, pairs across buckets need only bucket totals.  So even
    one group holding most rows is spread over all buckets, and the only window that sees
    a whole group runs over its bucket totals.
    """
    by = list(by)
    if bounds is None:
        bounds = quantile_bounds(df, score)
    w = F.col(weight) if weight else F.lit(1)
    points = (
        df.where(_usable(score, label))
        .groupBy(*by, F.col(score).cast("double").alias("_s"))
        .agg(
            F.sum(w * F.col(label)).cast("double").alias("_p"),
            F.sum(w * (1 - F.col(label))).cast("double").alias("_n"),
        )
        .withColumn("_b", bucket_of(F.col("_s"), bounds))
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(inside), F.lit(0.0))
    buckets = (
        points.select(*by, "_b", "_p", "_n", (F.col("_p") * (below + F.col("_n") / 2)).alias("_u"))
        .groupBy(*by, "_b")
        .agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_u").alias("_u"))
    )
    part = by or [F.lit(0)]
    across = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(across), F.lit(0.0))
    u = buckets.select(*by, "_p", "_n", (F.col("_u") + F.col("_p") * before).alias("_u"))
    return u.groupBy(*by).agg(
        F.sum("_p").alias("n_pos"),
        F.sum("_n").alias("n_neg"),
        ratio(F.sum("_u"), F.sum("_p") * F.sum("_n")).alias("auc"),
    )


def directionless(auc: str = "auc", floor: float = 0.60) -> list[Column]:
    """Raw AUC stays; the directionless value and its flag are added beside it."""
    d = F.greatest(F.col(auc), 1 - F.col(auc))
    return [d.alias("auc_directionless"), (d >= F.lit(floor)).alias("clears_floor")]


def threshold_metrics(
    df: DataFrame,
    *,
    score: str,
    label: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """UAR, accuracy and F1 at a threshold; F1 is 0 when it has no positives at all.

    UAR averages recall over the classes that occur.
    """
    w = F.col(weight) if weight else F.lit(1)
    pred = (F.col(score) >= F.lit(threshold)).cast("int")
    y = F.col(label)
    counts = (
        df.where(_usable(score, label))
        .groupBy(*by)
        .agg(
            F.sum(w * y * pred).cast("double").alias("tp"),
            F.sum(w * (1 - y) * pred).cast("double").alias("fp"),
            F.sum(w * y * (1 - pred)).cast("double").alias("fn"),
            F.sum(w * (1 - y) * (1 - pred)).cast("double").alias("tn"),
        )
    )
    tpr = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(
        *by,
        n.alias("n"),
        F.when(tpr.isNull(), tnr).when(tnr.isNull(), tpr).otherwise((tpr + tnr) / 2).alias("uar"),
        ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        F.coalesce(
            ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)
        ).alias("f1"),
    )


def width_bin(p: Column, n_bins: int = 15) -> Column:
    """Equal-width bin of [0, 1]: right-open, the last bin closed."""
    return F.greatest(F.lit(0), F.least(F.floor(p * n_bins), F.lit(n_bins - 1))).cast("int")


def width_bins(p: np.ndarray, n_bins: int = 15) -> np.ndarray:
    """``width_bin`` of an array."""
    return np.clip(np.floor(p * n_bins), 0, n_bins - 1).astype(int)


def ece_equal_width(
    df: DataFrame,
    *,
    score: str,
    label: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    n_bins: int = 15,
) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    w = F.col(weight) if weight else F.lit(1)
    bins = (
        df.where(_usable(score, label))
        .groupBy(*by, width_bin(F.col(score), n_bins).alias("_bin"))
        .agg(F.sum(w).alias("_n"), F.sum(w * F.col(label)).alias("_y"), F.sum(w * F.col(score)).alias("_p"))
    )
    return bins.groupBy(*by).agg(
        F.sum("_n").cast("double").alias("n"),
        ratio(F.sum(F.abs(F.col("_y") - F.col("_p"))), F.sum("_n")).alias("ece"),
    )


def equal_mass_bins(
    df: DataFrame,
    *,
    score: str,
    label: str,
    unit: str,
    by: Sequence[str] = (),
    n_bins: int = 15,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Reliability table over bins of equal counts (sizes differ by at most one).

    The first ``n mod bins`` bins hold one row more, as when an array is split evenly.
    """
    by = list(by)
    d = df.where(_usable(score, label)).select(*by, score, label, unit)
    ranked = value_rank(d, part=by, value=score, tie=unit, out="_rn", bounds=bounds)
    if by:
        totals = d.groupBy(*by).agg(F.count("*").alias("_total"))
        ranked = ranked.join(totals, by)
        total = F.col("_total")
    else:
        total = d.agg(F.count("*")).scalar()
    ranked = ranked.withColumn("_t", total)
    base, extra = F.floor(F.col("_t") / n_bins), F.col("_t") % n_bins
    pos = F.col("_rn") - 1
    head = extra * (base + 1)
    bin_ = F.when(pos < head, F.floor(pos / (base + 1))).otherwise(
        extra + F.floor((pos - head) / F.greatest(base, F.lit(1)))
    )
    return (
        ranked.withColumn("bin", bin_.cast("int"))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("n"), F.avg(score).alias("conf"), F.avg(label).alias("acc"))
    )


def ece_from_bins(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ECE of a reliability table with columns n, conf, acc."""
    return bins.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("n"),
        ratio(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))), F.sum("n")).alias("ece"),
    )


def brier_decomposition(
    df: DataFrame, *, score: str, label: str, by: Sequence[str] = (), n_bins: int = 15
) -> DataFrame:
    """Brier score with Murphy's reliability, resolution and uncertainty over equal-width bins."""
    by = list(by)
    bins = (
        df.where(_usable(score, label))
        .groupBy(*by, width_bin(F.col(score), n_bins).alias("_bin"))
        .agg(
            F.count("*").alias("_n"),
            F.sum(label).alias("_y"),
            F.sum(score).alias("_p"),
            F.sum((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("_se"),
        )
    )
    # Sums over bins: with N rows, base rate m = Y/N,
    # resolution = sum n (y/n - m)^2 / N = sum y^2/n / N - m^2.
    n, y = F.sum("_n"), F.sum("_y")
    rel = F.sum((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y")) / F.col("_n"))
    base = ratio(y, n)
    return bins.groupBy(*by).agg(
        n.cast("bigint").alias("n"),
        ratio(F.sum("_se"), n).alias("brier"),
        ratio(rel, n).alias("reliability"),
        (ratio(F.sum(F.col("_y") * F.col("_y") / F.col("_n")), n) - base * base).alias("resolution"),
        (base * (1 - base)).alias("uncertainty"),
    )


def to_group_scores(
    df: DataFrame, *, group: str, score: str, label: str, by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: mean score, and the mean label rounded half to even."""
    return df.groupBy(*by, group).agg(
        F.avg(score).alias("p"),
        F.bround(F.avg(label), 0).cast("int").alias("y"),
        F.count("*").alias("n_units"),
        F.when(F.sum(F.when(F.col(score) >= 0.5, 1).otherwise(0)) * 2 > F.count(score), 1)
        .otherwise(0)
        .alias("vote"),
    )


def subgroup_auc(
    df: DataFrame,
    *,
    score: str,
    label: str,
    partitions: Sequence[str],
    min_n: int = 30,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """AUC of every cell of every partition; small cells stay visible but do not count."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(p).alias("partition"), col(p).cast("string").alias("cell")) for p in partitions])
    )
    long = df.select(score, label, cells.alias("_c")).select(
        score, label, F.col("_c.partition").alias("partition"), F.col("_c.cell").alias("cell")
    )
    out = roc_auc(long, score=score, label=label, by=["partition", "cell"], bounds=bounds)
    n = F.col("n_pos") + F.col("n_neg")
    return out.select(
        "partition", "cell", n.cast("bigint").alias("n"), "auc", (n >= min_n).alias("counts")
    )


def worst_cell(cells: DataFrame, pooled: DataFrame) -> DataFrame:
    """Smallest AUC among the cells that count, and its gap to the pooled AUC."""
    worst = cells.where("counts").agg(F.min("auc").alias("auc_min"), F.count("*").alias("n_cells"))
    return worst.withColumn("auc_pooled", pooled.select("auc").scalar()).withColumn(
        "gap", F.col("auc_pooled") - F.col("auc_min")
    )
