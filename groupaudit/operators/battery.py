"""The pinned confound battery: nine probes on identical folds, each run or refused with its reason."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.operators import models as mod

# The members and the inputs each needs.
MEMBERS = {
    "age_only": ("age",),
    "age_sex_only": ("age", "sex"),
    "device_or_site_only": ("site",),
    "duration_only": ("duration",),
    "intensity_rms_only": ("rms",),
    "metadata_only": ("age", "sex", "site"),
    "sex_only": ("sex",),
    "silence_only": ("silence",),
    "snr_only": ("snr",),
}
INPUTS = ("age", "sex", "site", "duration", "rms", "silence", "snr")
SITE_COLUMNS = 32  # sites are dealt to so many indicator columns by hash, however many there are


def _numbers(name: str, c: Column) -> Column:
    """An input as an array of numbers, NaN where missing."""
    nan = F.lit(float("nan"))
    if name == "sex":
        flag = F.when(F.trim(c.cast("string")) != "", F.upper(c.cast("string")).startswith("M").cast("double"))
        return F.array(F.coalesce(flag, nan))
    if name == "site":
        at = F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(SITE_COLUMNS))
        return F.transform(F.sequence(F.lit(0), F.lit(SITE_COLUMNS - 1)), lambda i: (at == i).cast("double"))
    if name == "silence":
        return F.transform(c, lambda v: F.coalesce(v.cast("double"), nan))
    return F.array(F.coalesce(c.cast("double"), nan))


def _present(name: str, c: Column) -> Column:
    """A value to count and compare, NULL where the input is missing."""
    if name == "silence":
        known = F.filter(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
        return F.when(F.size(known) > 0, F.to_json(F.struct(known.alias("v"))))
    if name in ("sex", "site"):
        return F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    number = c.cast("double")
    return F.when(~F.isnan(number), number)


def applicability(units: DataFrame, columns: Mapping[str, str]) -> dict[str, str | None]:
    """Why each input cannot be used, or None, from one scan of what the table holds."""
    unknown = sorted(set(columns) - set(INPUTS))
    if unknown:
        raise ValueError(f"unknown battery input {unknown[0]!r}; known: {sorted(INPUTS)}")
    here = {k: c for k, c in columns.items() if c in units.columns}
    seen = [_present(k, F.col(c)) for k, c in here.items()]
    row = units.agg(F.count("*").alias("_"), *[F.struct(F.count(v), F.min(v) < F.max(v)).alias(k) for k, v in zip(here, seen)]).first()
    out: dict[str, str | None] = {}
    for k in INPUTS:
        if k not in columns:
            out[k] = f"no column for {k}"
        elif k not in here:
            out[k] = f"column {columns[k]} is absent"
        elif not row[k][0]:
            out[k] = f"column {columns[k]} holds no value"
        else:
            out[k] = None if row[k][1] else f"column {columns[k]} has one value"
    return out


def _silence_width(units: DataFrame, columns: Mapping[str, str], reasons: Mapping[str, str | None]) -> int:
    if reasons["silence"]:
        return 0
    sizes = units.agg(F.min(F.size(columns["silence"])).alias("lo"), F.max(F.size(columns["silence"])).alias("hi")).first()
    if sizes["lo"] not in (sizes["hi"], -1):
        raise ValueError(f"column {columns['silence']} has arrays of {sizes['lo']} to {sizes['hi']} values")
    return sizes["hi"]


def confound_battery(
    units: DataFrame, folds: DataFrame, columns: Mapping[str, str], *, unit: str, group: str, label: str, n_folds: int, repeats: int
) -> DataFrame:
    """Nine rows (member, status, n_features, auc_mean, auc_std, n_repeats), whatever the table holds.

    ``columns`` maps inputs to columns of ``units``.  A member whose inputs are absent, empty or constant
    is ``NOT_APPLICABLE(reason)``; the others run on the given folds with the same head.
    """
    reasons = applicability(units, columns)
    widths = {k: 1 for k in INPUTS} | {"site": SITE_COLUMNS, "silence": _silence_width(units, columns, reasons)}
    usable = [k for k in INPUTS if reasons[k] is None]
    at, start = {}, 0
    for k in usable:
        at[k] = tuple(range(start, start + widths[k]))
        start += widths[k]
    views = [
        mod.View(name, tuple(i for k in needs for i in at[k])) for name, needs in MEMBERS.items() if all(k in at for k in needs)
    ]
    why = {n: "; ".join(reasons[k] for k in needs if reasons[k]) for n, needs in MEMBERS.items()}
    width = {v.name: len(v.columns) for v in views}
    rows = [(n, f"NOT_APPLICABLE({why[n]})" if why[n] else "OK", width.get(n, 0)) for n in MEMBERS]
    plan = units.sparkSession.createDataFrame(rows, "member string, status string, n_features int")
    if not views:
        none = F.lit(None).cast("double")
        return plan.select("*", none.alias("auc_mean"), none.alias("auc_std"), F.lit(0).cast("long").alias("n_repeats"))
    blank = F.array_repeat(F.lit(float("nan")), widths["silence"])
    parts = [F.coalesce(_numbers(k, F.col(columns[k])), blank) if k == "silence" else _numbers(k, F.col(columns[k])) for k in usable]
    table = units.select(unit, group, F.col(label).cast("int").alias("y"), F.concat(*parts).alias("x"))
    scored = mod.out_of_fold_auc(table, folds, group=group, views=views, n_folds=n_folds, repeats=repeats)
    auc = scored.groupBy(F.col("head").alias("member")).agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.count("auc").alias("n_repeats")
    )
    return plan.join(auc, "member", "left").withColumn("n_repeats", F.coalesce("n_repeats", F.lit(0).cast("long")))


def strongest(battery: DataFrame) -> DataFrame:
    """(member, auc_mean) of the strongest confound that ran: the bar a claim must clear."""
    ran = battery.where("auc_mean IS NOT NULL")
    best = ran.agg(F.min_by(F.struct("member", "auc_mean"), F.struct(-F.col("auc_mean"), F.col("member"))).alias("b"))
    return best.select("b.member", "b.auc_mean")
