"""Group-disjoint partitions.  Assignment happens at group grain and is joined back to units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.functions.hashing import hash_key, uniform
from groupaudit.operators.metrics import ratio
from groupaudit.operators.ranks import hash_rank, value_rank


def group_labels(units: DataFrame, group: str, label: str) -> DataFrame:
    """Majority label per group: mean rounded half to even."""
    return units.groupBy(group).agg(F.bround(F.avg(label), 0).cast("int").alias("y"), F.count("*").alias("n_units"))


def _repeats(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def stratified_folds(
    units: DataFrame, *, group: str, label: str, n_folds: int = 5, repeats: int = 1, seed: int = 0
) -> DataFrame:
    """(repeat, group, y, fold): groups dealt round-robin inside each label, in hash order.

    Dealing in rank order equals sending every group to the fold that has fewest groups of
    its label, so folds differ by at most one group per label.
    """
    g = (
        group_labels(units, group, label)
        .withColumn("repeat", _repeats(repeats))
        .withColumn("_h", F.md5(F.concat_ws("|", (F.col("repeat") + seed).cast("string"), group).cast("binary")))
    )
    ranked = hash_rank(g, part=["repeat", "y"], key="_h", out="_rn")
    return ranked.select("repeat", group, "y", "n_units", ((F.col("_rn") - 1) % n_folds).cast("int").alias("fold"))


def _serpentine(rank: Column, k: int | Column) -> Column:
    pos = rank - 1
    turn, step = F.floor(pos / k), pos % k
    return F.when(turn % 2 == 0, step).otherwise(k - 1 - step).cast("int")


def balanced_folds(
    units: DataFrame, *, group: str, n_folds: int = 5, repeats: int = 1, seed: int = 0
) -> DataFrame:
    """(repeat, group, n_units, fold): serpentine deal over groups by descending size.

    Within every pair of passes the fold totals differ by less than the size drop across
    the pass, so the spread stays below the largest group.
    """
    sizes = units.groupBy(group).agg(F.count("*").alias("n_units")).withColumn("repeat", _repeats(repeats))
    sizes = sizes.withColumn("_tie", F.concat_ws("|", (F.col("repeat") + seed).cast("string"), group))
    ranked = value_rank(sizes, part=["repeat"], value="n_units", tie="_tie", out="_rn", ascending=False)
    return ranked.select("repeat", group, "n_units", _serpentine(F.col("_rn"), n_folds).alias("fold"))


def fold_balance(folds: DataFrame) -> DataFrame:
    """Spread of fold totals beside the largest group, the stated bound."""
    per = folds.groupBy("repeat", "fold").agg(F.sum("n_units").alias("_n"), F.max("n_units").alias("_big"))
    return per.groupBy("repeat").agg(
        F.count("*").alias("n_folds"),
        (F.max("_n") - F.min("_n")).alias("spread"),
        F.max("_big").alias("largest_group"),
        (F.max("_n") - F.min("_n") <= F.max("_big")).alias("within_bound"),
    )


def inner_folds(folds: DataFrame, *, group: str, outer: int, n_inner: int = 3, seed: int = 0) -> DataFrame:
    """(repeat, outer_fold, group, inner_fold) over the training groups of every outer fold.

    ``max(2, min(n_inner, groups))`` inner folds, dealt by size like the outer balanced folds.
    """
    train = folds.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).where(
        "outer_fold <> fold"
    )
    train = train.withColumn("_tie", F.concat_ws("|", (F.col("repeat") + seed).cast("string"), "outer_fold", group))
    ranked = value_rank(
        train, part=["repeat", "outer_fold"], value="n_units", tie="_tie", out="_rn", ascending=False
    )
    counts = train.groupBy("repeat", "outer_fold").agg(
        F.greatest(F.lit(2), F.least(F.lit(n_inner), F.count("*"))).alias("_k")
    )
    return ranked.join(counts, ["repeat", "outer_fold"]).select(
        "repeat", "outer_fold", group, "n_units", _serpentine(F.col("_rn"), F.col("_k")).alias("inner_fold")
    )


def fold_report(assigned: DataFrame, *, label: str) -> DataFrame:
    """Per (repeat, fold): test size, training classes, and whether the fold is usable.

    Unusable folds (one training class, or no test rows) are listed, never skipped silently.
    """
    cells = assigned.groupBy("repeat", "fold").agg(
        F.count("*").alias("n_test"), F.sum(label).alias("_p")
    )
    totals = cells.groupBy("repeat").agg(F.sum("n_test").alias("_n"), F.sum("_p").alias("_tp"))
    train_pos = F.col("_tp") - F.col("_p")
    train_n = F.col("_n") - F.col("n_test")
    return cells.join(totals, "repeat").select(
        "repeat",
        "fold",
        "n_test",
        train_n.alias("n_train"),
        train_pos.alias("n_train_pos"),
        ((train_pos > 0) & (train_pos < train_n)).alias("usable"),
    )


def disjointness_evidence(
    assigned: DataFrame, *, group: str, provenance: str | None = None, min_test_groups: int = 8
) -> DataFrame:
    """Evidence row per (repeat, fold): sizes on both sides and groups on both sides.

    ``examples`` names the first five groups (as text) that are on both sides.
    A split claim is refused when group ids are only recording proxies.
    """
    proxy = F.bool_or(F.col(provenance) != "participant") if provenance else F.bool_or(F.lit(False))
    cells = assigned.groupBy("repeat", "fold", group).agg(F.count("*").alias("_n"), proxy.alias("_proxy"))
    per_group = cells.groupBy("repeat", group).agg(F.count("*").alias("_folds"))
    cells = cells.join(per_group, ["repeat", group])
    named = cells.where("_folds > 1").select("repeat", "fold", F.col(group).cast("string").alias("_key"))
    first = Window.partitionBy("repeat", "fold").orderBy("_key")  # tasks keep five before the shuffle
    named = named.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= 5)
    named = named.groupBy("repeat", "fold").agg(F.array_join(F.array_sort(F.collect_list("_key")), ",").alias("examples"))
    test = cells.groupBy("repeat", "fold").agg(
        F.count("*").alias("n_test_groups"),
        F.sum("_n").alias("n_test_rows"),
        F.count_if(F.col("_folds") > 1).alias("n_overlap"),
        F.bool_or("_proxy").alias("_proxy"),
    )
    totals = per_group.groupBy("repeat").agg(F.count("*").alias("_g"))
    rows = test.groupBy("repeat").agg(F.sum("n_test_rows").alias("_rows"))
    status = (
        F.when(F.col("_proxy"), "REFUSED: group ids are recording proxies")
        .when(F.col("n_overlap") > 0, "LEAK")
        .when(F.col("n_test_groups") < min_test_groups, "TOO FEW TEST GROUPS")
        .otherwise("PASS")
    )
    return (
        test.join(totals, "repeat")
        .join(rows, "repeat")
        .join(named, ["repeat", "fold"], "left")
        .withColumn("examples", F.coalesce("examples", F.lit("")))
        .select(
            "repeat",
            "fold",
            "n_test_groups",
            # a group on both sides counts on both sides
            (F.col("_g") - F.col("n_test_groups") + F.col("n_overlap")).alias("n_train_groups"),
            "n_test_rows",
            (F.col("_rows") - F.col("n_test_rows")).alias("n_train_rows"),
            "n_overlap",
            "examples",
            status.alias("status"),
        )
    )


def require_disjoint(assigned: DataFrame, *, group: str, provenance: str | None = None) -> None:
    """Raise before any fit when a group is on both sides of a fold."""
    if provenance is None:  # one aggregation tells whether there is anything to name
        known = F.count("fold")
        torn = ~F.min("fold").eqNullSafe(F.max("fold")) | ((known > 0) & (known < F.count("*")))
        if assigned.groupBy("repeat", group).agg(torn.alias("_torn")).where("_torn").isEmpty():
            return
    bad = disjointness_evidence(assigned, group=group, provenance=provenance, min_test_groups=1).where(
        "status <> 'PASS'"
    )
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"group leakage: {first[0].asDict()}")


def holdout(groups: DataFrame, *, group: str, fraction: float = 0.8, seed: int = 0, exact: bool = False) -> DataFrame:
    """Adds ``is_train`` per group: hash uniform below the fraction, or exactly floor(fraction * U) groups."""
    if not exact:
        return groups.withColumn("is_train", uniform(seed, group) < F.lit(fraction))
    g = groups.withColumn("_h", hash_key(seed, group))
    n = F.floor(F.lit(fraction) * groups.agg(F.count("*")).scalar())
    return hash_rank(g, key="_h", out="_rn").withColumn("is_train", F.col("_rn") <= n).drop("_h", "_rn")


def half_split(
    units: DataFrame, *, group: str, unit: str, min_units: int, n_groups: int, seed: int = 0
) -> DataFrame:
    """Within-group half split over a hash sample of n_groups large groups (a sampling operator).

    Each sampled group gives max(2, n // 2) units to training.
    """
    sampled = (
        units.groupBy(group)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_units)
        .orderBy(hash_key(seed, group), group)
        .limit(n_groups)
    )
    d = units.join(sampled, group).withColumn("_h", hash_key(seed, unit))
    ranked = hash_rank(d, part=[group], key="_h", out="_rn")
    return ranked.select(
        *units.columns,
        (F.col("_rn") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2))).alias("is_train"),
    )


def random_split_leak(units: DataFrame, *, group: str, unit: str, trials: int, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """What a recording-level random split would leak, averaged over trials.

    Rows collapse to counts per (trial, group, fold) first; any number of folds will do.
    """
    t = units.select(group, unit).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    fold = F.floor(
        F.conv(F.substring(F.md5(F.concat_ws("|", (F.col("trial") + seed).cast("string"), unit).cast("binary")), 1, 13), 16, 10).cast("bigint")
        % n_folds
    ).cast("int")
    cells = t.groupBy("trial", group, fold.alias("_fold")).agg(F.count("*").alias("_n"))
    g = cells.groupBy("trial", group).agg(F.count("*").alias("_folds"), F.sum("_n").alias("_n"))
    split = F.col("_folds") > 1
    per_trial = g.groupBy("trial").agg(
        (100 * ratio(F.count_if(split), F.count("*"))).alias("_g"),
        (100 * ratio(F.sum(F.when(split, F.col("_n")).otherwise(0)), F.sum("_n"))).alias("_r"),
    )
    return per_trial.agg(
        F.count("*").alias("n_trials"),
        F.avg("_g").alias("pct_groups_split"),
        F.avg("_r").alias("pct_rows_leaked"),
    )


def _repeat_ranks(groups: DataFrame, *, group: str, repeats: int, seed: int) -> DataFrame:
    g = groups.select(group).withColumn("repeat", _repeats(repeats))
    g = g.withColumn("_h", F.md5(F.concat_ws("|", (F.col("repeat") + seed).cast("string"), group).cast("binary")))
    return hash_rank(g, part=["repeat"], key="_h", out="_rn")


def nested_samples(groups: DataFrame, *, group: str, sizes: Sequence[int], repeats: int = 1, seed: int = 0) -> DataFrame:
    """(repeat, n_train, group): nested training subsets, each a hash-order head of the next."""
    ranked = _repeat_ranks(groups, group=group, repeats=repeats, seed=seed)
    wanted = F.filter(F.array(*[F.lit(int(n)) for n in sizes]), lambda n: n >= F.col("_rn"))
    return ranked.select("repeat", group, F.explode(wanted).alias("n_train"))


def nested_ranks(groups: DataFrame, *, group: str, repeats: int = 1, seed: int = 0) -> DataFrame:
    """(group, ranks): the same orders as one short array of ranks per group."""
    ranked = _repeat_ranks(groups, group=group, repeats=repeats, seed=seed)
    return ranked.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "_rn"))), lambda s: s["_rn"]).alias("ranks")
    )


def controlled_overlap(
    units: DataFrame,
    *,
    group: str,
    unit: str,
    rhos: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0),
    test_fraction: float = 0.2,
    seed: int = 0,
) -> DataFrame:
    """(rho, unit, side): a fraction rho of test groups also seen in training, training size fixed.

    An overlapping test group gives half its rows to training; as many other training rows,
    the last in hash order, are dropped.
    """
    g = units.groupBy(group).agg(F.count("*").alias("_n"))
    g = g.withColumn("_test", uniform(seed, group) < F.lit(test_fraction)).withColumn("_gh", hash_key(seed + 1, group))
    g = hash_rank(g, part=["_test"], key="_gh", out="_gr")
    n_test = g.agg(F.count_if("_test")).scalar()
    n_train = g.agg(F.sum(F.when(~F.col("_test"), F.col("_n")).otherwise(0))).scalar()
    u = units.select(group, unit).join(g.drop("_gh"), group).withColumn("_uh", hash_key(seed + 2, unit))
    # one ranking serves both uses: inside its group for test rows, over all training rows otherwise
    u = u.withColumn("_scope", F.when(F.col("_test"), F.col(group).cast("string")).otherwise(F.lit("train")))
    u = hash_rank(u, part=["_test", "_scope"], key="_uh", out="_ur")
    moved = [
        g.agg(F.sum(F.when(F.col("_test") & (F.col("_gr") <= F.floor(F.lit(r) * n_test)), F.floor(F.col("_n") / 2)).otherwise(0))).scalar()
        for r in rhos
    ]
    sides = F.array(
        *[
            F.struct(
                F.lit(float(r)).alias("rho"),
                F.when(
                    F.col("_test"),
                    F.when(
                        (F.col("_gr") <= F.floor(F.lit(r) * n_test)) & (F.col("_ur") <= F.floor(F.col("_n") / 2)), "train"
                    ).otherwise("test"),
                )
                .when(F.col("_ur") <= n_train - m, "train")
                .otherwise("dropped")
                .alias("side"),
            )
            for r, m in zip(rhos, moved)
        ]
    )
    return u.select(group, unit, F.explode(sides).alias("_s")).select("_s.rho", group, unit, "_s.side")


def shuffle_group_labels(groups: DataFrame, *, group: str, label: str, seed: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """Permute the group -> label map (optionally inside strata); units of a group stay alike.

    Groups in one hash order receive the labels of the groups in another, joined on rank.
    """
    within = list(within)
    a = groups.select(*within, group).withColumn("_h", hash_key(seed, group))
    b = groups.select(*within, F.col(group).alias("_donor"), F.col(label).alias("y_shuffled"))
    b = b.withColumn("_h", hash_key(seed + 1, "_donor"))
    left = hash_rank(a, part=within, key="_h", out="_rn").drop("_h")
    right = hash_rank(b, part=within, key="_h", out="_rn").drop("_h", "_donor")
    return left.join(right, [*within, "_rn"]).drop("_rn")


def time_blocks(groups: DataFrame, *, group: str, time: str, n_blocks: int, out: str = "block") -> DataFrame:
    """Adds the contiguous block in time of every group, blocks of equal size up to one group."""
    order = groups.withColumn("_t", F.col(time).cast("timestamp_ntz").cast("timestamp").cast("double")) if dict(groups.dtypes)[time] in ("date", "timestamp", "timestamp_ntz") else groups.withColumn("_t", F.col(time).cast("double"))
    ranked = value_rank(order, value="_t", tie=group, out="_rn")
    total = groups.agg(F.count("*")).scalar()
    return ranked.withColumn(out, F.floor((F.col("_rn") - 1) * n_blocks / total).cast("int")).drop("_rn", "_t")


SHUFFLES = ("hard", "within_group", "block")


def shuffle_labels(
    groups: DataFrame, *, group: str, label: str, mode: str, seed: int = 0, within: Sequence[str] = (), time: str | None = None, n_blocks: int = 5
) -> DataFrame:
    """(within or block, group, y_shuffled): labels permuted over all groups, inside strata, or inside blocks of time."""
    if mode not in SHUFFLES:
        raise ValueError(f"unknown shuffle mode {mode!r}")
    if mode == "within_group" and not within or mode == "block" and time is None:
        raise ValueError(f"mode {mode!r} lacks its {'strata' if mode == 'within_group' else 'time'}")
    if mode == "block":
        groups, within = time_blocks(groups, group=group, time=time, n_blocks=n_blocks), ["block"]
    return shuffle_group_labels(groups, group=group, label=label, seed=seed, within=within if mode != "hard" else ())
