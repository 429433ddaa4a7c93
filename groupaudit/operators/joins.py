"""Enrichment, reconciliation and pairing joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich_with_reasons(
    units: DataFrame,
    metadata: DataFrame,
    *,
    key: str,
    group: str,
    reason: Column | None = None,
) -> DataFrame:
    """Left join to metadata; every unit keeps exactly one outcome (reason NULL = accepted).

    ``reason`` carries rejects known before the join, e.g. an unreadable name.
    """
    meta = metadata.withColumn("_known", F.lit(True))
    early = reason if reason is not None else F.lit(None).cast("string")
    return (
        units.join(meta, key, "left")
        .withColumn(
            "reason",
            F.when(early.isNotNull(), early)
            .when(F.col("_known").isNull(), "absent from metadata -> no speaker_id")
            .when(F.col(group).isNull(), "null speaker_id"),
        )
        .drop("_known")
    )


def first_per_key(df: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a given order, as a map-side combinable aggregate."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*key, "_r.*")
        .select(*df.columns)
    )


def members(df: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an accepted set."""
    return df.join(accepted.select(key), key, "left_semi")


def aligned_arms(base: DataFrame, arms: Mapping[str, DataFrame], *, key: str) -> DataFrame:
    """Per arm: does every base row find a partner?  Incomplete arms are reported, not dropped."""
    out = None
    total = base.agg(F.count("*")).scalar()
    for name, arm in arms.items():
        hit = base.join(arm.select(key).distinct(), key, "left_semi")
        row = hit.agg(F.count("*").alias("n_aligned")).select(
            F.lit(name).alias("arm"), total.alias("n_base"), "n_aligned"
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn(
        "status", F.when(F.col("n_aligned") == F.col("n_base"), "RUN").otherwise("SKIPPED: rows without a partner")
    )


def reconcile_registry(declared: DataFrame, present: DataFrame, *, key: str) -> DataFrame:
    """Both directions of disagreement between a registry and what exists."""
    a = declared.select(key).distinct().withColumn("_d", F.lit(True))
    b = present.select(key).distinct().withColumn("_p", F.lit(True))
    return (
        a.join(b, key, "full")
        .withColumn(
            "problem",
            F.when(F.col("_p").isNull(), "declared but missing").when(F.col("_d").isNull(), "present but undeclared"),
        )
        .where("problem IS NOT NULL")
        .select(key, "problem")
    )


def _melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], out: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias(out)) for v in values])
    return df.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.*")


def claim_disagreements(
    recorded: DataFrame, recomputed: DataFrame, *, keys: Sequence[str], values: Sequence[str], tol: float = 1e-6
) -> DataFrame:
    """Recorded numbers that a recomputation does not confirm (or that exist on one side only)."""
    a, b = _melt(recorded, keys, values, "recorded"), _melt(recomputed, keys, values, "recomputed")
    gap = F.abs(F.col("recorded") - F.col("recomputed"))
    same_missing = F.col("recorded").isNull() & F.col("recomputed").isNull()
    return a.join(b, [*keys, "metric"], "full").where(
        ~same_missing & (F.col("recorded").isNull() | F.col("recomputed").isNull() | (gap > tol))
    )


def duplicate_content(
    df: DataFrame, *, digest: str, crossing: Sequence[str]
) -> DataFrame:
    """Digests held by several rows, and whether their copies cross groups, labels or folds.

    Only counts leave each digest, so a digest with very many copies stays one row.
    """
    return (
        df.groupBy(digest)
        .agg(
            F.count("*").alias("n_copies"),
            *[(F.min(c) != F.max(c)).alias(f"crosses_{c}") for c in crossing],
        )
        .where("n_copies > 1")
    )


def pair_scores(
    predictions: DataFrame, *, head: str, score: str, keys: Sequence[str], a: str, b: str
) -> DataFrame:
    """Scores of two heads on identical keys only."""
    wide = predictions.where(F.col(head).isin(a, b)).groupBy(*keys).agg(
        F.max(F.when(F.col(head) == a, F.col(score))).alias("p_a"),
        F.max(F.when(F.col(head) == b, F.col(score))).alias("p_b"),
    )
    return wide.where("p_a IS NOT NULL AND p_b IS NOT NULL")


def key_sets(a: DataFrame, b: DataFrame, *, key: str) -> DataFrame:
    """Every key with the side it occurs on: both, only_a or only_b.

    One aggregation over both inputs replaces an INTERSECT and two EXCEPTs.
    """
    tagged = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    side = tagged.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return side.select(
        key,
        F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "only_a").otherwise("only_b").alias("side"),
    )
