"""Dataset profiling: census, key integrity, leakage exposure, cross-tabs, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.functions.scalars import non_blank, number_or_null, or_missing
from groupaudit.operators.metrics import ratio, roc_auc
from groupaudit.operators.ranks import values_at_ranks


def per_group(df: DataFrame, group: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: units, positives, rounded majority label, mixed flag."""
    return df.groupBy(*by, group).agg(
        F.count("*").alias("n_units"),
        F.sum(label).alias("n_pos"),
        F.bround(F.avg(label), 0).cast("int").alias("y"),
        (F.min(label) != F.max(label)).alias("mixed"),
    )


def census(df: DataFrame, *, group: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts at both grains, units per group, groups that carry both labels."""
    g = per_group(df, group, label, by)
    n_units, n_groups = F.sum("n_units"), F.count("*")
    return g.groupBy(*by).agg(
        n_units.alias("n_units"),
        n_groups.alias("n_groups"),
        F.sum("n_pos").alias("n_pos_units"),
        (n_units - F.sum("n_pos")).alias("n_neg_units"),
        F.sum("y").cast("bigint").alias("n_pos_groups"),
        (n_groups - F.sum("y")).cast("bigint").alias("n_neg_groups"),
        ratio(n_units, n_groups).alias("units_per_group"),
        F.count_if("mixed").alias("n_mixed_groups"),
    )


def key_integrity(df: DataFrame, *, key: str, date: str) -> DataFrame:
    """Is the key unique per row, and does one key carry several dates?"""
    # (key, date) first, so a key with many rows is combined before it meets one task
    pairs = df.groupBy(key, date).agg(F.count("*").alias("_n"))
    keys = pairs.groupBy(key).agg(F.sum("_n").alias("_rows"), F.count(date).alias("_dates"))
    return keys.agg(
        F.sum("_rows").alias("n_rows"),
        F.count("*").alias("n_keys"),
        (F.max("_rows") == 1).alias("unique_per_row"),
        F.max("_rows").alias("max_rows_per_key"),
        F.count_if(F.col("_rows") > 1).alias("n_keys_multi_row"),
        F.count_if(F.col("_dates") > 1).alias("n_keys_multi_date"),
    )


def leakage_exposure(df: DataFrame, *, group: str, archive: str) -> DataFrame:
    """What a split on sessions instead of groups would leak."""
    g = (
        df.groupBy(group, archive)
        .agg(F.count("*").alias("_n"))
        .groupBy(group)
        .agg(F.sum("_n").alias("_n"), F.count("*").alias("_archives"))
    )
    multi = F.col("_n") > 1
    at_risk = F.sum(F.when(multi, F.col("_n")).otherwise(0))
    return g.agg(
        F.count("*").alias("n_groups"),
        F.count_if(multi).alias("n_groups_multi_session"),
        at_risk.alias("n_sessions_at_risk"),
        F.max("_n").alias("max_sessions_per_group"),
        F.round(100 * ratio(at_risk, F.sum("_n")), 2).alias("pct_rows_at_risk"),
        F.count_if(F.col("_archives") > 1).alias("n_groups_multi_archive"),
    )


def cross_label_groups(df: DataFrame, *, group: str, label: str) -> DataFrame:
    """Groups found on both label sides."""
    return df.groupBy(group).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo <> _hi").select(group)


def cross_label_examples(df: DataFrame, *, group: str, label: str, n: int = 10) -> DataFrame:
    """The first n cross-label groups in key order (a report of n examples)."""
    return cross_label_groups(df, group=group, label=label).orderBy(group).limit(n)


def crosstab(df: DataFrame, *, cls: str | Column, fields: Sequence[str], top: int) -> DataFrame:
    """Class x value counts of many fields in one job, missing as its own level, top n per class."""
    cls_col = F.col(cls) if isinstance(cls, str) else cls
    long = df.select(
        cls_col.alias("cls"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), or_missing(f).alias("value")) for f in fields])).alias("_f"),
    )
    counts = long.groupBy("cls", F.col("_f.field").alias("field"), F.col("_f.value").alias("value")).agg(
        F.count("*").alias("n")
    )
    w = Window.partitionBy("cls", "field").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def numeric_profile(df: DataFrame, *, cls: str, value: str) -> DataFrame:
    """n, mean (2 decimals), upper median, min and max per class."""
    d = df.select(cls, number_or_null(value).alias("_v")).where("_v IS NOT NULL")
    stats = d.groupBy(cls).agg(
        F.count("*").alias("n"), F.round(F.avg("_v"), 2).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    median = values_at_ranks(d, by=[cls], value="_v", ranks={"upper_median": lambda n: F.floor(n / 2)})
    return stats.join(median.drop("n"), cls)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-blank count of every column, one pass."""
    agg = df.agg(F.count("*").alias("_n"), *[F.count_if(non_blank(c)).alias(c) for c in columns])
    return agg.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_filled"), F.col("_n").alias("n_rows")) for c in columns])
        ).alias("_c")
    ).select("_c.*")


def rater_profile(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Label counts over k rater columns, with rows rated by any and by all of them."""
    filled = F.array(*[non_blank(c) for c in raters])
    totals = df.agg(
        F.count_if(F.exists(filled, lambda x: x)).alias("n_any"), F.count_if(F.forall(filled, lambda x: x)).alias("n_all")
    )
    labels = (
        df.select(F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in raters])).alias("label"))
        .where(non_blank("label"))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )
    return labels.select(
        "label", "n", totals.select("n_any").scalar().alias("n_any"), totals.select("n_all").scalar().alias("n_all")
    )


def threshold_profile(df: DataFrame, *, value: str, label: str, threshold: float) -> DataFrame:
    """Per label: rows, rows with a value, mean value, rows at or above the threshold."""
    v = number_or_null(value)
    return df.groupBy(or_missing(label).alias("label")).agg(
        F.count("*").alias("n_all"),
        F.count(v).alias("n_with_value"),
        F.round(F.avg(v), 4).alias("mean"),
        F.count_if(F.coalesce(v, F.lit(0.0)) >= threshold).alias("n_at_threshold"),
    )


def repeated_pairs(df: DataFrame, *, a: str, b: str, top: int = 10) -> DataFrame:
    """The most repeated value pairs beside the number of distinct pairs (a top-k report)."""
    pairs = df.where(non_blank(a)).groupBy(a, b).agg(F.count("*").alias("n"))
    return (
        pairs.orderBy(F.desc("n"), a, b)
        .limit(top)
        .withColumn("n_distinct_pairs", pairs.agg(F.count("*")).scalar())
    )


def class_bar(df: DataFrame, *, label: str, group: str, floor: int = 500) -> DataFrame:
    """Do both classes reach the floor, counted in distinct groups?"""
    d = df.select(group, label).distinct()
    return d.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        (F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)) >= floor).alias("meets_bar"),
    )


# Group-count thresholds of the long-tail report.
TAIL_THRESHOLDS = (100, 50, 30, 5, 1)


def condition_sizes(df: DataFrame, *, condition: str, group: str) -> DataFrame:
    return df.where(F.col(condition).isNotNull()).groupBy(condition).agg(F.count_distinct(group).alias("n_groups"))


def long_tail(sizes: DataFrame, thresholds: Sequence[int] = TAIL_THRESHOLDS) -> DataFrame:
    """Per threshold t: conditions with at least t groups and their groups; singletons alongside."""
    n = F.col("n_groups")
    agg = sizes.agg(
        F.count("*").alias("_all"),
        F.count_if(n == 1).alias("_one"),
        *[F.count_if(n >= t).alias(f"c{t}") for t in thresholds],
        *[F.coalesce(F.sum(F.when(n >= t, n)), F.lit(0)).alias(f"g{t}") for t in thresholds],
    )
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.col(f"c{t}").alias("n_conditions"),
            F.col(f"g{t}").alias("n_groups"),
            F.col("_all").alias("n_all_conditions"),
            F.col("_one").alias("n_singletons"),
        )
        for t in thresholds
    ]
    return agg.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def histogram(df: DataFrame, *, cls: str, value: str, width: int = 4, lo: int = 0, hi: int = 100) -> DataFrame:
    """Counts per class and bin over [lo, hi)."""
    v = F.col(value)
    return (
        df.where((v >= lo) & (v < hi))
        .groupBy(cls, (F.floor((v - lo) / width) * width + lo).cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def confound_profile(df: DataFrame, *, group: str, label: str, confounds: Sequence[str]) -> DataFrame:
    """AUC of every covariate used directly as a score, per unit and per group."""
    pairs = lambda: F.explode(
        F.array(*[F.struct(F.lit(c).alias("confound"), F.col(c).cast("double").alias("v")) for c in confounds])
    )
    units = df.select(F.lit("unit").alias("grain"), F.col(label).alias("y"), pairs().alias("_c"))
    groups = (
        df.groupBy(group)
        .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in confounds], F.bround(F.avg(label), 0).cast("int").alias("y"))
        .select(F.lit("group").alias("grain"), "y", pairs().alias("_c"))
    )
    long = units.unionByName(groups).select("grain", "y", F.col("_c.confound").alias("confound"), F.col("_c.v").alias("v"))
    return roc_auc(long, score="v", label="y", by=["grain", "confound"])
