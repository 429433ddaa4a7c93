"""Split audits and data contracts.

Each audit returns one row: check, status, n_violations, example, fingerprint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupaudit.functions.hashing import hash_key, order_free_digest, short_sha256
from groupaudit.functions.scalars import is_finite
from groupaudit.operators.ranks import running_before, values_at_ranks


def verdict(violations: DataFrame, check: str, example: str | Column, fail: str = "FAIL") -> DataFrame:
    """Count violations into the common audit row; the example is the smallest by text."""
    ex = F.col(example) if isinstance(example, str) else example
    v = violations.agg(F.count("*").alias("n_violations"), F.min(ex.cast("string")).alias("example"))
    status = F.when(F.col("n_violations") == 0, "PASS").otherwise(fail)
    v = v.select(F.lit(check).alias("check"), status.alias("status"), "n_violations", "example")
    return v.withColumn(
        "fingerprint",
        short_sha256(F.concat_ws("|", "check", "status", F.col("n_violations").cast("string"), F.coalesce("example", F.lit("")))),
    )


def _spans(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys found in more than one split; min/max combine map-side whatever the key's size."""
    return df.groupBy(key).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi")).where("_lo <> _hi")


def index_disjoint(df: DataFrame, *, unit: str, split: str) -> DataFrame:
    return verdict(_spans(df, unit, split), "index_disjoint", unit)


def group_disjoint(df: DataFrame, *, group: str, split: str, provenance: str | None = None) -> DataFrame:
    """Groups on one side only; proxy group ids cannot support the claim at all."""
    spans = _spans(df, group, split)
    if provenance is None:
        return verdict(spans, "group_disjoint", group)
    proxies = df.where(F.col(provenance) != "participant").groupBy(group).agg(F.count("*").alias("_n"))
    bad = spans.select(F.col(group).cast("string").alias("_e")).unionByName(
        proxies.select(F.concat(F.lit("proxy:"), F.col(group).cast("string")).alias("_e"))
    )
    return verdict(bad, "group_disjoint", "_e", fail="REFUSED")


def protocol_match(
    df: DataFrame, expected: DataFrame, *, split: str, group: str | None = None, prescribed: DataFrame | None = None, tol: float = 0.005
) -> DataFrame:
    """Split sizes within tol of the protocol (``split, n_expected``); groups in their prescribed split."""
    sizes = df.groupBy(split).agg(F.count("*").alias("_n"))
    j = expected.join(sizes, split, "full")
    off = j.where(
        F.col("n_expected").isNull() | F.col("_n").isNull() | (F.abs(F.col("_n") - F.col("n_expected")) > F.lit(tol) * F.col("n_expected"))
    ).select(F.concat(F.lit("size:"), F.col(split)).alias("_e"))
    if prescribed is not None:
        found = df.select(group, F.col(split).alias("_found")).distinct()
        wrong = found.join(prescribed, group, "left").where(F.col(split).isNull() | (F.col("_found") != F.col(split)))
        off = off.unionByName(wrong.select(F.concat(F.lit("group:"), F.col(group).cast("string")).alias("_e")))
    return verdict(off, "protocol_match", "_e")


def size_floors(df: DataFrame, floors: DataFrame, *, split: str) -> DataFrame:
    """Every configured split (``split, floor``) reaches its floor."""
    sizes = df.groupBy(split).agg(F.count("*").alias("_n"))
    low = floors.join(sizes, split, "left").where(F.coalesce("_n", F.lit(0)) < F.col("floor"))
    return verdict(low, "size_floors", F.concat(F.col(split), F.lit(":"), F.coalesce("_n", F.lit(0))))


def class_balance(df: DataFrame, *, split: str, label: str, lo: float, hi: float) -> DataFrame:
    """Both classes in every split and prevalence inside the documented range."""
    c = df.groupBy(split).agg(F.avg(label).alias("_m"))
    bad = c.where((F.col("_m") <= 0) | (F.col("_m") >= 1) | (F.col("_m") < lo) | (F.col("_m") > hi))
    return verdict(bad, "class_balance", split)


def split_keys_not_features(df: DataFrame, *, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Split keys are no features, by name and by value.

    A feature in one-to-one correspondence with a key is that key under another name.
    """
    by_name = sorted(set(keys) & set(features))
    text = lambda c, n: F.col(c).cast("string").alias(n)
    pairs = [F.struct(F.lit(f"{f}={k}").alias("_e"), text(k, "k"), text(f, "f")) for k in keys for f in features if f not in by_name]
    out = None
    if pairs:
        # a bijection: every key has one feature value and every feature value one key; one scan for all pairs
        u = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()
        c = u.groupBy("_e").agg(F.count("*").alias("n"), F.count_distinct("k").alias("nk"), F.count_distinct("f").alias("nf"))
        out = c.where("n = nk AND n = nf AND n > 1").select("_e")
    spark = df.sparkSession
    named = spark.createDataFrame([(n,) for n in by_name], T.StructType([T.StructField("_e", T.StringType())]))
    return verdict(named if out is None else out.unionByName(named), "split_keys_not_features", "_e")


def feature_consistency(
    df: DataFrame, *, split: str, train: str, features: Sequence[str], scaler: DataFrame | None = None, tol: float = 1e-6
) -> DataFrame:
    """No missing, NaN or infinite value in any feature; scaler statistics equal the train statistics.

    ``scaler`` holds ``feature, mean, std``.  Splits of one frame agree in names and types; for tables of
    their own see ``split_schemas``.
    """
    return verdict(_inconsistent(df, split, train, features, scaler, tol), "feature_consistency", "_e")


def _inconsistent(df: DataFrame, split: str, train: str, features: Sequence[str], scaler: DataFrame | None, tol: float) -> DataFrame:
    entry = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]
    long = df.select(split, F.explode(F.array(*entry)).alias("_f")).select(split, "_f.feature", "_f.v")
    finite = is_finite(F.col("v"))
    stats = long.groupBy("feature").agg(
        F.count_if(~finite).alias("_bad"),
        F.avg(F.when(finite & (F.col(split) == train), F.col("v"))).alias("_m"),
        F.stddev_pop(F.when(finite & (F.col(split) == train), F.col("v"))).alias("_s"),
    )
    bad = stats.where("_bad > 0").select(F.concat(F.lit("nonfinite:"), "feature").alias("_e"))
    if scaler is not None:
        drift = (F.abs(F.col("mean") - F.col("_m")) > tol * F.greatest(F.lit(1.0), F.abs("_m"))) | (
            F.abs(F.col("std") - F.col("_s")) > tol * F.greatest(F.lit(1.0), F.abs("_s"))
        )
        off = scaler.join(stats, "feature", "left").where(F.col("_m").isNull() | drift)
        bad = bad.unionByName(off.select(F.concat(F.lit("scaler:"), "feature").alias("_e")))
    return bad


def split_schemas(splits: Mapping[str, DataFrame], *, train: str, features: Sequence[str], scaler: DataFrame | None = None) -> DataFrame:
    """``feature_consistency`` of splits that are tables of their own: same names, same types, clean values.

    Every feature of the train table must be in every split under its name and type, and no split may
    have columns the train table lacks.  Features that agree are then checked together.
    """
    if train not in splits:
        raise ValueError(f"no split {train!r}")
    base = dict(splits[train].dtypes)
    found = [f"missing:{train}:{f}" for f in features if f not in base]
    agreed = {f for f in features if f in base}
    for name, table in splits.items():
        own = dict(table.dtypes)
        for f in features:
            if f in base and f not in own:
                found.append(f"missing:{name}:{f}")
                agreed.discard(f)
            elif f in base and own[f] != base[f]:
                found.append(f"type:{name}:{f}:{own[f]}<>{base[f]}")
                agreed.discard(f)
        found += [f"extra:{name}:{c}" for c in own if c not in base]
    spark, kept = splits[train].sparkSession, sorted(agreed)
    bad = spark.createDataFrame([(x,) for x in found], "_e string")
    if kept:
        parts = [t.select(F.lit(n).alias("_split"), *kept) for n, t in splits.items()]
        values = _inconsistent(reduce(DataFrame.unionByName, parts), "_split", train, kept, scaler, 1e-6)
        bad = bad.unionByName(values)
    return verdict(bad, "split_schemas", "_e")


def temporal_order(df: DataFrame, *, split: str, ts: str, order: Sequence[str], gap_seconds: int = 0) -> DataFrame:
    """max(ts) of a split plus the gap lies before min(ts) of the next split."""
    micros = wall_micros(F.col(ts))
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))
    b = df.groupBy(split).agg(F.min(micros).alias("_min"), F.max(micros).alias("_max")).withColumn("_pos", pos)
    nxt = F.lead("_min").over(Window.partitionBy(F.lit(0)).orderBy("_pos"))  # one row per split
    bad = b.where("_pos > 0").withColumn("_next", nxt).where(F.col("_max") + gap_seconds * 1_000_000 >= F.col("_next"))
    return verdict(bad, "temporal_order", split)


def wall_micros(ts: Column) -> Column:
    """Microseconds of the wall clock since 1970, free of any time zone rule."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def lookback_mean(df: DataFrame, *, key: str, ts: str, value: str, unit: str, seconds: int) -> DataFrame:
    """Mean of ``value`` over [ts - seconds, ts) of the same key, strictly before ts.

    It is the difference of two prefix sums of the key: those before ``ts`` and before its lookback.
    Both moments are rows among the values, and prefixes run in buckets of time that hold equal numbers
    of rows whatever the keys, so a key with all rows spreads.  Sums are decimals of twelve places, so
    that a difference loses nothing to the length of the history.
    """
    span = seconds * 1_000_000
    d = df.select(F.col(key).alias("_k"), F.col(unit).alias("_u"), F.col(value).cast("double").alias("_v"), wall_micros(F.col(ts)).alias("_t"))
    usable = F.col("_v").isNotNull()
    number = F.when(usable, F.col("_v").cast("decimal(38,12)"))
    # at one moment the questions (0, 1) stand before the values (2), which therefore do not count
    rows = F.array(
        F.struct(F.col("_t").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("decimal(38,12)").alias("v"), F.lit(0).alias("n")),
        F.struct((F.col("_t") - span).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("decimal(38,12)").alias("v"), F.lit(0).alias("n")),
        F.struct(F.col("_t").alias("t"), F.lit(2).alias("kind"), number.alias("v"), usable.cast("int").alias("n")),
    )
    long = d.select("_k", "_u", F.explode(rows).alias("_r")).select("_k", "_u", "_r.*")
    # rows of one moment and kind may stand in any order: no question sees a value among them
    seen = running_before(long, part=["_k"], order="t", tie="kind", sums={"_s": "v", "_c": "n"}).where("kind < 2")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    both = seen.groupBy("_k", "_u").agg(*[(pick(0, c) - pick(1, c)).alias(c) for c in ("_s", "_c")])
    mean = F.when(F.col("_c") > 0, F.col("_s").cast("double") / F.col("_c"))
    return both.select(F.col("_k").alias(key), F.col("_u").alias(unit), mean.alias("expected"))


def no_lookahead(
    df: DataFrame, *, key: str, ts: str, value: str, unit: str, stored: str, seconds: int, tol: float = 1e-9
) -> DataFrame:
    """A stored lag feature equals its re-derivation from strictly earlier rows; ``unit`` tells rows apart."""
    derived = lookback_mean(df, key=key, ts=ts, value=value, unit=unit, seconds=seconds)
    j = df.select(unit, stored).join(derived, unit)
    same = (F.col(stored).isNull() & F.col("expected").isNull()) | F.coalesce(
        F.abs(F.col(stored) - F.col("expected")) <= tol, F.lit(False)
    )
    return verdict(j.where(~same), "no_lookahead", unit)


def edges_disjoint(df: DataFrame, *, src: str, dst: str, split: str, mode: str = "transductive") -> DataFrame:
    """Edges (transductive) or endpoint nodes (inductive) in one split only."""
    if mode == "transductive":
        lo, hi = F.least(src, dst), F.greatest(src, dst)
        keyed = df.select(F.concat_ws("-", lo, hi).alias("_e"), split)
    else:
        keyed = df.select(F.explode(F.array(F.col(src), F.col(dst))).alias("_e"), split)
    return verdict(_spans(keyed, "_e", split), f"edges_disjoint_{mode}", "_e")


def reproducibility(
    df: DataFrame, *, unit: str, split: str, features: Sequence[str], expected: str | None = None, age_hours: float = 0.0
) -> DataFrame:
    """Fingerprint of sizes, id sets and feature names; stale or changed splits are refused."""
    ids = df.select(F.col(split).alias("_split"), F.sha2(F.concat_ws("|", split, F.col(unit).cast("string")), 256).alias("_d"))
    per = order_free_digest(ids, "_d", ["_split"])
    names = ",".join(sorted(features))
    fp = per.agg(
        short_sha256(
            F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "_split", F.col("n_rows").cast("string"), "fingerprint"))), F.lit(names))
        ).alias("fingerprint"),
        F.sum("n_rows").alias("_n"),
    )
    changed = F.lit(False) if expected is None else F.col("fingerprint") != expected
    status = F.when(F.lit(age_hours > 24), "REFUSED: stale").when(changed, "REFUSED: changed").otherwise("PASS")
    return fp.select(
        F.lit("reproducibility").alias("check"),
        status.alias("status"),
        F.when(status == "PASS", 0).otherwise(1).cast("bigint").alias("n_violations"),
        F.concat(F.col("_n").cast("string"), F.lit(" ids")).alias("example"),
        "fingerprint",
    )


def loader_contract(
    train: DataFrame, evaluation: DataFrame, *, unit: str, target: str, features: Sequence[str], delta: float = 0.0, k: int = 8,
    seed: int = 0, targets: DataFrame | None = None,
) -> DataFrame:
    """Contract between two tables: schema, target set, value range, pair counts, index pairs.

    Ranges compare with exact 1st and 99th percentile ranks of the training side.  ``targets`` is
    the table of (unit, target) that a loader pairs with the evaluation features, if it is one of its
    own: every unit must occur as often in both, and a hash sample of k units (a sampling operator)
    must have the same target in both.
    """
    targets = evaluation if targets is None else targets
    diff = set(map(str, train.schema)) ^ set(map(str, evaluation.schema))
    spark = train.sparkSession
    one = T.StructType([T.StructField("_e", T.StringType())])
    rows = [verdict(spark.createDataFrame([(x,) for x in sorted(diff)], one), "schema_equal", "_e")]
    unseen = evaluation.select(target).distinct().join(train.select(target).distinct(), target, "left_anti")
    rows.append(verdict(unseen, "target_subset", target))
    entry = lambda: F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("_f")
    tr = train.select(entry()).select("_f.*")
    ev = evaluation.select(entry()).select("_f.*").groupBy("feature").agg(F.min("v").alias("_min"), F.max("v").alias("_max"))
    edges = values_at_ranks(
        tr, by=["feature"], value="v", ranks={"_p1": lambda n: F.floor(n * 0.01), "_p99": lambda n: F.floor(n * 0.99)}
    )
    out = ev.join(edges, "feature").where(
        (F.col("_min") < F.col("_p1") - delta) | (F.col("_max") > F.col("_p99") + delta)
    )
    rows.append(verdict(out, "value_range", "feature"))
    count = lambda d, n: d.groupBy(F.col(unit).alias(f"_{n}")).agg(F.count("*").alias(n))
    left, right = count(evaluation, "n_features"), count(targets, "n_targets")
    both = left.join(right, F.col("_n_features").eqNullSafe(F.col("_n_targets")), "full")
    unpaired = both.where(~F.col("n_features").eqNullSafe(F.col("n_targets"))).select(F.coalesce("_n_features", "_n_targets").alias(unit))
    rows.append(verdict(unpaired, "pair_count", unit))
    sample = evaluation.orderBy(hash_key(seed, unit), unit).limit(k).select(unit, F.col(target).alias("_t"))
    mism = sample.join(targets.select(unit, target), unit).where(~F.col(target).eqNullSafe(F.col("_t")))
    rows.append(verdict(mism, "index_pair", unit))
    res = rows[0]
    for x in rows[1:]:
        res = res.unionByName(x)
    return res
