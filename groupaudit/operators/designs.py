"""Demographic matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupaudit.functions.hashing import hash_key
from groupaudit.operators.ranks import hash_rank, running_before
from groupaudit.session import materialise


def round_order(tol: int) -> list[int]:
    """Cell distances nearest first: 0, -1, 1, -2, 2, ..."""
    return [0] + [s * d for d in range(1, tol + 1) for s in (-1, 1)]


_ALLOCATION = "exact string, y int, cell long, lo long, hi long, d int, pair_cell long, base long"


def _allocate(rounds: Sequence[int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Counts per cell of one exact stratum -> rank intervals that are matched in each round."""
        left = {y: dict(zip(g["cell"], g["n"])) for y, g in pdf.groupby("y")}
        free = {0: dict(left.get(0, {})), 1: dict(left.get(1, {}))}
        rows = []
        for d in rounds:
            for cell in sorted(free[0]):
                m = min(free[0][cell], free[1].get(cell + d, 0))
                if m <= 0:
                    continue
                for y, c in ((0, cell), (1, cell + d)):
                    lo = left[y][c] - free[y][c]
                    rows.append((pdf["exact"].iloc[0], y, c, lo + 1, lo + m, d, cell, lo))
                free[0][cell] -= m
                free[1][cell + d] -= m
        return pd.DataFrame(rows, columns=["exact", "y", "cell", "lo", "hi", "d", "pair_cell", "base"])

    return run


def _cell_rounds(g: DataFrame, width: float, rounds: Sequence[int], tol: float) -> DataFrame:
    """Pairs (exact, control, case, age_control, age_case) of members ``g`` in cells at the given distances.

    Members of a cell are consumed in hash order, so the members a round takes form a rank interval:
    the rounds run on the table of cell counts, and one ranking of the members then yields all pairs.
    """
    g = g.withColumn("cell", F.floor(F.col("age") / width).cast("bigint"))
    cells = g.groupBy("exact", "y", "cell").agg(F.count("*").alias("n"))
    # one row per stratum, label and age cell: bounded by the number of cells, not of people
    alloc = cells.groupBy("exact").applyInPandas(_allocate(rounds), _ALLOCATION)
    slots = alloc.groupBy("exact", "y", "cell").agg(
        F.collect_list(F.struct("lo", "hi", "d", "pair_cell", "base")).alias("_slots")
    )
    ranked = hash_rank(g, part=["exact", "y", "cell"], key="_h", out="_rn").join(slots, ["exact", "y", "cell"])
    slot = F.get(F.filter("_slots", lambda s: (s["lo"] <= F.col("_rn")) & (F.col("_rn") <= s["hi"])), F.lit(0))
    taken = ranked.withColumn("_s", slot).where("_s IS NOT NULL").select(
        "id", "y", "exact", "age", F.col("_s.d").alias("d"), F.col("_s.pair_cell").alias("c"), (F.col("_rn") - F.col("_s.base")).alias("k")
    )
    # both members of a pair carry the same (stratum, cell, round, position)
    return _paired(taken, ["exact", "c", "d", "k"], tol)


def _paired(members: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    side = lambda y, c: F.max(F.when(F.col("y") == y, F.col(c)))
    pairs = members.groupBy(*keys).agg(
        side(0, "id").alias("control"), side(1, "id").alias("case"), side(0, "age").alias("age_control"), side(1, "age").alias("age_case")
    )
    return pairs.where(F.abs(F.col("age_case") - F.col("age_control")) <= tol).select("exact", "control", "case", "age_control", "age_case")


def _proposals(left: DataFrame, tol: float) -> DataFrame:
    """(exact, age_control, age_case): each age with cases takes the nearest age whose controls propose to it.

    Controls of an age propose to the nearest age with cases.  Both neighbours come from prefix maxima
    over the distinct ages, in buckets, so one large stratum spreads.
    """
    ages = left.groupBy("exact", "age").agg(F.max(F.when(F.col("y") == 0, 1)).alias("has_control"), F.max(F.when(F.col("y") == 1, F.col("age"))).alias("case_age"))
    ages = materialise(ages.withColumn("minus", -F.col("age")).withColumn("minus_case", -F.col("case_age")))
    below = running_before(ages, part=["exact"], order="age", tie="age", maxs={"lower": "case_age"})
    both = running_before(below, part=["exact"], order="minus", tie="age", maxs={"upper": "minus_case"})
    near = F.array_min(
        F.filter(
            F.transform(F.array("case_age", "lower", -F.col("upper")), lambda v: F.struct(F.abs(v - F.col("age")).alias("gap"), v.alias("age"))),
            lambda v: v["age"].isNotNull() & (v["gap"] <= tol),
        )
    )
    offers = both.where("has_control = 1").select("exact", F.col("age").alias("age_control"), near.alias("n")).where("n IS NOT NULL")
    best = offers.groupBy("exact", F.col("n.age").alias("age_case")).agg(F.min(F.struct("n.gap", "age_control")).alias("b"))
    return best.select("exact", F.col("b.age_control").alias("age_control"), "age_case")


def _proposal_round(left: DataFrame, tol: float) -> DataFrame:
    """Pairs of members of ages that accepted each other, by rank."""
    accepted = _proposals(left, tol)
    # an age with controls proposes to one age with cases, so (exact, age_case) names the pair of ages
    keyed = accepted.select("exact", F.lit(0).alias("y"), F.col("age_control").alias("age"), F.col("age_case").alias("to")).unionByName(
        accepted.select("exact", F.lit(1).alias("y"), F.col("age_case").alias("age"), F.col("age_case").alias("to"))
    )
    ranked = hash_rank(left.join(keyed, ["exact", "y", "age"]), part=["exact", "y", "age"], key="_h", out="k")
    pairs = _paired(ranked, ["exact", "to", "k"], tol)
    return pairs.where("control IS NOT NULL AND case IS NOT NULL")


FINER = 8  # cells to a caliper on the first level, and by how much each level narrows them
LEVELS = 3


def caliper_match(groups: DataFrame, *, group: str, label: str, age: str, exact: str, tol: float, width: float = 1, seed: int = 0) -> DataFrame:
    """1:1 pairs of controls (label 0) and cases (label 1): same ``exact``, age within ``tol``.

    Rounds go from the nearest cells outwards and nobody is used twice.  Where ages are multiples of
    ``width``, a cell is an age and the rounds leave no pair that could still be made.  Other ages are
    matched in cells narrower than the caliper, at distances that are sure to lie within it; members
    that found nobody are offered again in ever narrower cells, and at last age by age: controls propose
    to the nearest age with cases left, which takes its nearest proposer, until no proposal is left.
    ``d`` is the distance in cells of ``width``.
    """
    g = groups.select(
        F.col(group).alias("id"),
        F.col(label).cast("int").alias("y"),
        F.col(exact).cast("string").alias("exact"),
        F.col(age).alias("age"),
    ).where("y IS NOT NULL AND age IS NOT NULL AND NOT isnan(CAST(age AS DOUBLE)) AND exact IS NOT NULL")
    g = g.withColumn("_h", hash_key(seed, "id"))
    whole = g.agg(F.coalesce(F.bool_and(F.col("age") % width == 0), F.lit(True))).first()[0]
    if whole:
        pairs = _cell_rounds(g, width, round_order(int(tol // width)), tol)
    else:
        g = materialise(g.withColumn("age", F.col("age").cast("double")))
        parts, left = [], g
        for level in range(LEVELS):
            m = FINER ** (level + 1)  # cells to a caliper
            done = m // FINER - 1  # distances below this many of the wider cells are exhausted
            first = done * FINER - 1 if level else 0
            sure = [d for d in round_order(m - 1) if abs(d) >= first]
            parts.append(materialise(_cell_rounds(left, tol / m, sure, tol)))
            left = _without(left, parts[-1])
        while True:
            one = materialise(_proposal_round(left, tol))
            if one.isEmpty():
                break
            parts.append(one)
            left = _without(left, one)
        pairs = reduce(DataFrame.unionByName, parts)
    cell = lambda c: F.floor(F.col(c) / width)
    return pairs.select(
        "exact", "control", "case", "age_control", "age_case", (cell("age_case") - cell("age_control")).cast("int").alias("d")
    )


def _without(members: DataFrame, pairs: DataFrame) -> DataFrame:
    used = pairs.select(F.explode(F.array("control", "case")).alias("id"))
    return materialise(members.join(used, "id", "left_anti"))


def match_report(pairs: DataFrame) -> DataFrame:
    """Pairs made, mean ages, and the residual gap."""
    return pairs.agg(
        F.count("*").alias("n_pairs"),
        F.avg("age_control").alias("age_control"),
        F.avg("age_case").alias("age_case"),
        F.abs(F.avg("age_case") - F.avg("age_control")).alias("age_gap"),
        F.avg(F.abs(F.col("age_case") - F.col("age_control"))).alias("mean_abs_diff"),
    )
