"""Expressions over sample and feature arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groupaudit.functions.hashing import col


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(a: str | Column) -> Column:
    return F.try_divide(_sum(col(a)), F.size(col(a)).cast("double"))


def rms(a: str | Column) -> Column:
    a = col(a)
    return F.sqrt(F.try_divide(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))), F.size(a).cast("double")))


def std_pop(a: str | Column) -> Column:
    """Population standard deviation in one pass over running mean and squared deviations."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, x: Column) -> Column:
        n, gap = acc["n"] + 1, x.cast("double") - acc["mean"]
        mean = acc["mean"] + gap / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + gap * (x.cast("double") - mean)).alias("m2"))

    return F.aggregate(col(a), zero, add, lambda acc: F.sqrt(F.try_divide(acc["m2"], acc["n"])))


def peak(a: str | Column) -> Column:
    return F.array_max(F.transform(col(a), lambda x: F.abs(x)))


def l2_norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def quality_flag(samples: str | Column, rate: int = 16_000) -> Column:
    """Reason an otherwise readable signal is unusable, or NULL."""
    a = col(samples)
    n = F.size(a)
    return (
        F.when(a.isNull() | (n < rate // 10), F.concat(F.lit("too short ("), F.format_string("%.3f", F.coalesce(n, F.lit(0)) / F.lit(float(rate))), F.lit("s)")))
        .when(peak(a) == 0, "digital silence")
        .when(std_pop(a) < 1e-6, "constant signal (no variation)")
    )


def crop_or_pad(samples: str | Column, n_min: int, n_max: int) -> tuple[Column, Column]:
    """(samples cut to n_max and zero-padded to n_min, number of true samples kept)."""
    a = col(samples)
    cut = F.slice(a, 1, n_max)
    kept = F.size(cut)
    zero = F.lit(0.0).cast("double")
    padded = F.concat(
        F.transform(cut, lambda x: x.cast("double")),
        F.array_repeat(zero, F.greatest(F.lit(0), F.lit(n_min) - kept)),
    )
    return padded, kept


def all_finite(a: str | Column) -> Column:
    return ~F.exists(col(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
