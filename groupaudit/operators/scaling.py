"""Fold-scoped imputation and scaling as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.functions.scalars import is_finite
from groupaudit.operators.metrics import ratio


def fold_statistics(df: DataFrame, *, features: Sequence[str], scope: str = "train") -> DataFrame:
    """(repeat, fold, feature, n, mean, std) of the training rows of every fold.

    One aggregation per (repeat, fold) and feature; training totals are the repeat's totals
    minus the fold's own, so rows are never copied into k - 1 training sets.  Totals are taken
    about the repeat's mean, so that a large offset costs no digits.  ``scope="all"`` is the leaky
    variant over the whole table.  A zero standard deviation becomes 1.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select("repeat", "fold", F.explode(pairs).alias("_p")).select("repeat", "fold", "_p.feature", "_p.v")
    v = F.when(is_finite(F.col("v")), F.col("v"))
    cells = long.groupBy("repeat", "fold", "feature").agg(
        F.count(v).alias("_n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("_m"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("_v")
    )
    folds = Window.partitionBy("repeat", "feature")  # one row a fold
    cells = cells.withColumn("_mu", F.coalesce(ratio(F.sum(F.col("_n") * F.col("_m")).over(folds), F.sum("_n").over(folds)), F.lit(0.0)))
    gap = F.col("_m") - F.col("_mu")
    cells = cells.withColumn("_s", F.col("_n") * gap).withColumn("_q", F.col("_n") * (F.col("_v") + gap * gap))
    keep = F.lit(1 if scope == "train" else 0)
    rest = lambda c: F.sum(c).over(folds) - keep * F.col(c)
    n = rest("_n")
    about = ratio(rest("_s"), n)
    var = ratio(rest("_q"), n) - about * about
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return cells.select(
        "repeat", "fold", "feature", n.alias("n"), (F.col("_mu") + about).alias("mean"),
        F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std"),
    )


def impute_from_train(df: DataFrame, *, column: str, label: str | None = None) -> DataFrame:
    """Adds <column>_imputed: the value, or its fold's training mean; and a flag for reports per class."""
    stats = fold_statistics(df, features=[column]).select("repeat", "fold", F.col("mean").alias("_mean"))
    ok = is_finite(F.col(column).cast("double"))
    return (
        df.join(stats, ["repeat", "fold"])
        .withColumn(f"{column}_imputed", F.when(ok, F.col(column).cast("double")).otherwise(F.col("_mean")))
        .withColumn("was_imputed", ~ok)
        .drop("_mean")
    )
