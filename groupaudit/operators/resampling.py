"""Cluster bootstrap: a replicate is a weight per group, and weights are never a table of rows.

A whole number per group (``mix_key``) and two per replicate give every weight, so a task that holds
some rows derives the weights of all replicates for them, in NumPy, and returns vectors over the
replicates.  What moves are rows, once each, and vectors whose number depends on buckets alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.functions.hashing import (
    LAST_COUNT,
    MODULUS,
    hash_key,
    mix_key,
    mixed,
    mixed_array,
    poisson_count,
    poisson_draws,
    poisson_weight,
    replicate_factors,
    uniform,
)
from groupaudit.operators.metrics import ratio, roc_auc
from groupaudit.operators.ranks import bucket_of, hash_rank, quantile_bounds, running_before
from groupaudit.session import materialise, ship_package

SLICE = 250  # replicates of one vector
CELLS = 1 << 21  # weights derived at a time
BLOCK, CHUNK_BLOCKS = 64, 64  # rows of a score block, and blocks worked on at a time
BUCKET_ROWS = 100_000  # rows a score bucket is planned for


def independent_poisson_weights(groups: DataFrame, *, group: str, n_boot: int, seed: int = 0) -> DataFrame:
    """``poisson_weights`` with a digest for every group and replicate: no two draws hang on one another.

    Mixed draws are independent in pairs, and groups whose ``mix_key`` is the same, about n^2 / 2^32 pairs of n
    groups, have the same weights in every replicate.
    """
    # uniforms leave the explode as a column: a branch of the count does not take the digest anew
    draws = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: F.struct(b.alias("b"), uniform(seed, b, group).alias("u")))
    d = groups.select(group, F.explode(draws).alias("_d")).select(group, "_d.b", "_d.u")
    return d.select("b", group, poisson_weight(F.col("u"), LAST_COUNT).alias("w")).where("w > 0")


def poisson_weights(groups: DataFrame, *, group: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(b, group, w > 0) with Poisson(1) counts from a hash: an expression, no join and no shuffle."""
    d = groups.select(group, mix_key(seed, group).alias("_h"))
    d = d.select(group, "_h", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    return d.select("b", group, poisson_count(mixed(seed, F.col("b"), F.col("_h"))).alias("w")).where("w > 0")


def _numbered(groups: DataFrame, group: str, seed: int) -> DataFrame:
    return hash_rank(groups.select(group).withColumn("_h", hash_key(seed, group)), key="_h", out="_r").drop("_h")


def multinomial_weights(groups: DataFrame, *, group: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(b, group, w > 0): U draws with replacement from U groups per replicate.

    Groups are numbered in hash order; slot r of replicate b draws number floor(u * U) + 1.
    """
    numbered = _numbered(groups, group, seed)
    total = groups.agg(F.count("*")).scalar()
    slots = numbered.select(mix_key(seed, "_r").alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    pick = (F.floor(mixed(seed, F.col("b"), F.col("_slot")) * total / F.lit(MODULUS)) + 1).cast("bigint")
    counts = slots.select("b", pick.alias("_r")).groupBy("b", "_r").agg(F.count("*").alias("w"))
    return counts.join(numbered, "_r").select("b", group, F.col("w").cast("int").alias("w"))


def independent_multinomial_weights(groups: DataFrame, *, group: str, n_boot: int, seed: int = 0) -> DataFrame:
    """``multinomial_weights`` with a digest for every slot and replicate: no two draws hang on one another."""
    numbered = _numbered(groups, group, seed)
    total = groups.agg(F.count("*")).scalar()
    draws = numbered.select(F.col("_r").alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    pick = (F.floor(uniform(seed, "b", "_slot") * total) + 1).cast("bigint")
    counts = draws.select("b", pick.alias("_r")).groupBy("b", "_r").agg(F.count("*").alias("w"))
    return counts.join(numbered, "_r").select("b", group, F.col("w").cast("int").alias("w"))


SCHEMES = {"multinomial": multinomial_weights, "poisson": poisson_weights}


@dataclass(frozen=True)
class Draw:
    """One draw of groups, shared by every metric, score and grain that is given it.

    ``poisson`` needs nothing but the keys.  ``multinomial`` needs the drawn groups: their weights come
    as one vector per group, joined to the rows once, and a task that draws holds a number per group.
    """

    groups: DataFrame
    group: str
    n_boot: int
    seed: int = 0
    scheme: str = "poisson"

    def rows(self) -> DataFrame:
        """(b, group, w > 0), for the eye and for small settings."""
        return SCHEMES[self.scheme](self.groups, group=self.group, n_boot=self.n_boot, seed=self.seed)

    def attach(self, df: DataFrame, group: str) -> DataFrame:
        """``df`` with what its rows' weights are derived from: ``_h``, and ``_v`` for multinomial draws."""
        if self.scheme == "poisson":
            return df.withColumn("_h", mix_key(self.seed, group)).withColumn("_v", F.lit(None).cast("binary"))
        return df.join(self._vectors().withColumnRenamed(self.group, group), group).withColumn("_h", mix_key(self.seed, group))

    def _vectors(self) -> DataFrame:
        numbered, spark = _numbered(self.groups, self.group, self.seed), self.groups.sparkSession
        n, n_boot, seed = self.groups.count(), self.n_boot, self.seed
        block, chunk = SLICE, 4096

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            slots = np.array([int(h[:13], 16) % MODULUS for h in map(_md5, (f"{seed}|{r}" for r in range(1, n + 1)))], np.int64)
            a, c = replicate_factors(seed, n_boot)
            for pdf in batches:
                for lo in (pdf["id"].to_numpy() * block).tolist():
                    hi = min(lo + block, n_boot)
                    counts = np.empty((n, hi - lo), np.uint8)
                    for b in range(lo, hi):
                        picks = mixed_array(a[b : b + 1], c[b : b + 1], slots)[:, 0] * n // MODULUS
                        counts[:, b - lo] = np.bincount(picks, minlength=n)
                    for k in range(0, n, chunk):
                        yield pd.DataFrame({"k": [k // chunk], "lo": [lo], "w": [counts[k : k + chunk].tobytes()]})

        def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
            first = int(pdf["k"].iloc[0]) * chunk
            rows = min(chunk, n - first)
            parts = [np.frombuffer(w, np.uint8).reshape(rows, -1) for w in pdf.sort_values("lo")["w"]]
            whole = np.hstack(parts)
            return pd.DataFrame({"_r": np.arange(first + 1, first + rows + 1), "_v": [w.tobytes() for w in whole]})

        ship_package(spark)
        blocks = spark.range(0, -(-n_boot // block), 1, -(-n_boot // block))
        vectors = blocks.mapInPandas(draw, "k long, lo long, w binary").groupBy("k").applyInPandas(assemble, "_r long, _v binary")
        return vectors.join(numbered, "_r").select(self.group, "_v")

    def weights(self) -> Callable[[np.ndarray, Sequence[bytes | None], int, int], np.ndarray]:
        """(keys, vectors, lo, hi) -> weights of rows (rows) in replicates lo .. hi - 1 (columns)."""
        a, c = replicate_factors(self.seed, self.n_boot)
        n_boot = self.n_boot
        if self.scheme == "poisson":
            return lambda keys, vectors, lo, hi: poisson_draws(a[lo:hi], c[lo:hi], keys)
        return lambda keys, vectors, lo, hi: np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, n_boot)[:, lo:hi]


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def cluster_weights(groups: DataFrame, *, group: str, n_boot: int, seed: int = 0, scheme: str = "poisson") -> Draw:
    """A draw by a named scheme, the same at every size."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme}")
    return Draw(groups, group, n_boot, seed, scheme)


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def _keys(pdf: pd.DataFrame, by: Sequence[str], n: int) -> dict:
    return {c: [pdf[c].iloc[0]] * n for c in by}


def _parts(rows: int, n_boot: int) -> Iterator[tuple[int, int, int]]:
    """(slice, from, to): slices of replicates, cut further so that a matrix of weights stays bounded."""
    step = max(1, min(SLICE, CELLS // max(1, rows)))
    for lo in range(0, n_boot, SLICE):
        for at in range(lo, min(lo + SLICE, n_boot), step):
            yield lo // SLICE, at, min(at + step, lo + SLICE, n_boot)


def _score_blocks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of sorted scores into blocks of at most ``BLOCK`` rows, and which block is one score of more rows.

    No score lies in two blocks.
    """
    starts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
    cuts, tied, at = [0], [], 0
    for lo, hi in zip(starts, starts[1:]):
        if hi - at > BLOCK and lo > at:
            cuts.append(lo)
            tied.append(False)
            at = lo
        if hi - at > BLOCK:
            cuts.append(hi)
            tied.append(True)
            at = hi
    if at < len(s):
        cuts.append(len(s))
        tied.append(False)
    return np.array(cuts), np.array(tied, bool)


def _block_sums(
    s: np.ndarray, p: np.ndarray, n: np.ndarray, cuts: np.ndarray, tied: np.ndarray, weights: Callable[[int, int], np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted positives, negatives and pairs inside every block (rows) for every replicate (columns)."""
    # small counts: whole and half numbers inside a block are exact in single precision
    kind = np.float32 if max(p.max(), n.max()) <= 2 else np.float64
    out, b = None, 0
    while b < len(tied):
        e = b + 1
        while not tied[b] and e < len(tied) and not tied[e] and e - b < CHUNK_BLOCKS:
            e += 1
        if tied[b]:
            for lo in range(cuts[b], cuts[e], BLOCK * CHUNK_BLOCKS):
                hi = min(lo + BLOCK * CHUNK_BLOCKS, cuts[e])
                w = weights(lo, hi).astype(np.float64)
                out = np.zeros((3, len(tied), w.shape[1])) if out is None else out
                out[0, b] += p[lo:hi] @ w
                out[1, b] += n[lo:hi] @ w
            out[2, b] = out[0, b] * out[1, b] / 2
        else:
            lo, sizes = cuts[b], np.diff(cuts[b : e + 1])
            block = np.repeat(np.arange(e - b), sizes)
            place = block * BLOCK + np.arange(len(block)) - np.repeat(cuts[b:e] - lo, sizes)
            w = weights(lo, cuts[e])
            out = np.zeros((3, len(tied), w.shape[1])) if out is None else out
            spread = np.zeros(((e - b) * BLOCK, w.shape[1]), kind)
            spread[place] = w
            spread = spread.reshape(e - b, BLOCK, -1)
            score, pos, neg = (np.zeros((e - b) * BLOCK, t) for t in (float, kind, kind))
            score[place], pos[place], neg[place] = s[lo : cuts[e]], p[lo : cuts[e]], n[lo : cuts[e]]
            score, pos, neg = (v.reshape(e - b, BLOCK) for v in (score, pos, neg))
            higher = (score[:, :, None] > score[:, None, :]) + (score[:, :, None] == score[:, None, :]) / kind(2)
            pairs = higher.astype(kind) * pos[:, :, None] * neg[:, None, :]
            out[2, b:e] = np.einsum("bij,bij->bj", np.matmul(pairs, spread), spread)
            out[:2, b:e] = np.matmul(np.stack([pos, neg], axis=1), spread).transpose(1, 0, 2)
        b = e
    return out[0], out[1], out[2]


def alike_rows(df: DataFrame, *, group: str, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """(by, _g, _s, _p, _n): usable rows of one group and score as one, with its positives and negatives."""
    s, y = F.col(score).cast("double"), F.col(label)
    usable = s.isNotNull() & ~F.isnan(s) & y.isNotNull()
    return df.where(usable).groupBy(*by, F.col(group).alias("_g"), s.alias("_s")).agg(
        F.sum(y.cast("double")).alias("_p"), F.sum(F.lit(1) - y.cast("double")).alias("_n")
    )


def auc_replicates(df: DataFrame, draw: Draw, *, group: str, score: str, label: str, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """(by, b, metric): weighted AUC of every replicate; equal rows of a group become one with counts."""
    return alike_replicates(alike_rows(df, group=group, score=score, label=label, by=by), draw, by=by, bounds=bounds)


def alike_replicates(alike: DataFrame, draw: Draw, *, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """(by, b, metric) from ``alike_rows``.

    Rows meet in score buckets; each gives vectors
    over the replicates: positives, negatives, and pairs inside it.  A score that is a bucket's edge, as
    every frequent one is, gets a bucket of its own, spread by group: its positives and negatives just
    add up.  Prefix sums of the vectors over the buckets give the pairs across them.
    """
    spark, by, n_boot, weights = alike.sparkSession, list(by), draw.n_boot, draw.weights()
    ship_package(spark)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    edge = F.col("_s").isin([float(b) for b in bounds]) if bounds else F.lit(False)
    sub = F.when(edge, F.pmod(F.hash("_g"), F.lit(spread))).otherwise(F.lit(-1))
    rows = draw.attach(alike, "_g").select(*by, bucket_of(F.col("_s"), bounds).alias("_b"), sub.alias("_e"), "_s", "_h", "_v", "_p", "_n")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """An edge, sorted before the rest of its bucket, has no pairs of its own yet: its parts add up first."""
        first, whole = pdf["_e"].iloc[0] >= 0, pdf.sort_values("_s")
        keys, vectors = whole["_h"].to_numpy(np.int64), whole["_v"].tolist()
        s, p, n = (whole[c].to_numpy(float) for c in ("_s", "_p", "_n"))
        cuts, tied = (np.array([0, len(s)]), np.ones(1, bool)) if first else _score_blocks(s)
        ks, blobs = range(0, n_boot, SLICE), []
        for lo in ks:
            w = lambda i, j: weights(keys[i:j], vectors[i:j], lo, min(lo + SLICE, n_boot))  # noqa: E731, B023
            pos, neg, u = _block_sums(s, p, n, cuts, tied, w)
            u = np.zeros(pos.shape[1]) if first else (u + pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0)
            blobs.append(np.hstack([pos.sum(axis=0), neg.sum(axis=0), u]).astype("<f8").tobytes())
        where = [2 * int(pdf["_b"].iloc[0]) + (not first)] * len(ks)
        return pd.DataFrame(_keys(pdf, by, len(ks)) | {"_k": [lo // SLICE for lo in ks], "_b": where, "_w": blobs})

    vectors = rows.groupBy(*by, "_b", "_e").applyInPandas(inside, f"{_fields(alike, by)}_k int, _b int, _w binary")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        """Buckets in order; an odd place is the open rest of a bucket, an even one its edge."""
        stack = np.array([np.frombuffer(w, "<f8") for w in pdf["_w"]]).reshape(len(pdf), 3, -1)
        places, at = np.unique(pdf["_b"].to_numpy(), return_inverse=True)
        total = np.zeros((len(places), *stack.shape[1:]))
        np.add.at(total, at, stack)
        pos, neg, u = total[:, 0], total[:, 1], total[:, 2]
        edges = (places % 2 == 0)[:, None]
        u = u + pos * (np.cumsum(neg, axis=0) - neg) + np.where(edges, pos * neg / 2, 0)
        n = stack.shape[2]
        pairs = pos.sum(axis=0) * neg.sum(axis=0)
        auc = np.divide(u.sum(axis=0), pairs, out=np.full(n, np.nan), where=pairs > 0)
        b = int(pdf["_k"].iloc[0]) * SLICE + np.arange(n)
        metric = pd.array([None if v != v else v for v in auc], dtype="Float64")
        return pd.DataFrame(_keys(pdf, by, n) | {"b": b, "metric": metric})

    return vectors.groupBy(*by, "_k").applyInPandas(across, f"{_fields(alike, by)}b int, metric double")


# Metrics that are sums: per row, columns whose weighted sums give the metric; the first two are the classes.


def _uar_columns(s: Column, y: Column) -> list[Column]:
    pred = (s >= 0.5).cast("double")
    return [y, 1 - y, y * pred, (1 - y) * (1 - pred)]


def _brier_columns(s: Column, y: Column) -> list[Column]:
    return [y, 1 - y, (s - y) * (s - y)]


def _ece_columns(s: Column, y: Column) -> list[Column]:
    bins = F.greatest(F.lit(0), F.least(F.floor(s * 15), F.lit(14)))
    return [y, 1 - y, *[F.when(bins == k, y - s).otherwise(0.0) for k in range(15)]]


SUMS: dict[str, tuple[Callable, Callable]] = {
    "uar": (_uar_columns, lambda t: (t[2] / t[0] + t[3] / t[1]) / 2),
    "brier": (_brier_columns, lambda t: t[2] / (t[0] + t[1])),
    "ece": (_ece_columns, lambda t: np.abs(t[2:]).sum(axis=0) / (t[0] + t[1])),
}


def sum_replicates(df: DataFrame, draw: Draw, *, group: str, score: str, label: str, metric: str, by: Sequence[str]) -> DataFrame:
    """(by, b, metric) of a metric made of sums: rows add up to one per group before any weight is derived."""
    spark, by, n_boot, weights = df.sparkSession, list(by), draw.n_boot, draw.weights()
    ship_package(spark)
    columns, finish = SUMS[metric]
    s, y = F.col(score).cast("double"), F.col(label)
    usable = s.isNotNull() & ~F.isnan(s) & y.isNotNull()
    z = [F.sum(c).alias(f"_z{i}") for i, c in enumerate(columns(F.col("_s"), F.col("_y")))]
    alike = df.where(usable).select(*by, F.col(group).alias("_g"), s.alias("_s"), y.cast("double").alias("_y")).groupBy(*by, "_g").agg(*z)
    rows = draw.attach(alike, "_g").drop("_g")
    names = [f"_z{i}" for i in range(len(z))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                if not len(part):
                    continue
                grouped, keys, vectors = part[names].to_numpy(float), part["_h"].to_numpy(np.int64), part["_v"].tolist()
                total = sums.setdefault(key, np.zeros((len(names), n_boot)))
                for _, lo, hi in _parts(len(keys), n_boot):
                    total[:, lo:hi] += grouped.T @ weights(keys, vectors, lo, hi)
        slot = TaskContext.get().partitionId() % 64
        for key, total in sums.items():
            ks = range(0, n_boot, SLICE)
            named = {c: [None if v != v else v] * len(ks) for c, v in zip(by, key)}  # pandas shows a null key as NaN
            blobs = [total[:, lo : lo + SLICE].astype("<f8").tobytes() for lo in ks]
            yield pd.DataFrame(named | {"_k": [lo // SLICE for lo in ks], "_slot": slot, "_w": blobs})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, "<f8") for w in pdf["_w"])
        return pd.DataFrame(_keys(pdf, by, 1) | {"_k": pdf["_k"].iloc[:1].tolist(), "_slot": pdf["_slot"].iloc[:1].tolist(), "_w": [total.tobytes()]})

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["_k"].iloc[0])
        n = min(SLICE, n_boot - k * SLICE)
        total = sum(np.frombuffer(w, "<f8") for w in pdf["_w"]).reshape(-1, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where((total[0] > 0) & (total[1] > 0), finish(total), np.nan)
        metric = pd.array([None if v != v else v for v in value], dtype="Float64")
        return pd.DataFrame(_keys(pdf, by, n) | {"b": k * SLICE + np.arange(n), "metric": metric})

    schema = f"{_fields(df, by)}_k int, _slot int, _w binary"
    parts = rows.mapInPandas(partial, schema).groupBy(*by, "_k", "_slot").applyInPandas(added, schema)
    return parts.groupBy(*by, "_k").applyInPandas(finished, f"{_fields(df, by)}b int, metric double")


def _score_bounds(df: DataFrame, score: str) -> list[float]:
    """Edges of as many buckets as keep one bucket's rows bounded; at most 4,096."""
    width = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return quantile_bounds(df, score, min(4096, max(width, df.count() // BUCKET_ROWS)))


def replicates(
    df: DataFrame,
    draw: Draw,
    *,
    group: str,
    score: str,
    label: str,
    metric: str = "auc",
    by: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """(by, b, metric) of every replicate; one-class replicates give NULL."""
    if metric != "auc":
        return sum_replicates(df, draw, group=group, score=score, label=label, metric=metric, by=by)
    bounds = _score_bounds(df, score) if bounds is None else bounds
    return auc_replicates(df, draw, group=group, score=score, label=label, by=by, bounds=bounds)


def percentile_ci(reps: DataFrame, *, by: Sequence[str] = (), value: str = "metric") -> DataFrame:
    """2.5 and 97.5 percentiles over the replicates that have a value, and how many do."""
    return reps.groupBy(*by).agg(
        F.percentile(value, 0.025).alias("lo"),
        F.percentile(value, 0.975).alias("hi"),
        F.count(value).alias("n_boot"),
    )


def paired_deltas(
    df: DataFrame,
    draw: Draw,
    *,
    group: str,
    label: str,
    a: str,
    b: str,
    by: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """(by, b, metric): AUC(a) - AUC(b) under the same draw of groups."""
    return _deltas(_paired_rows(df, group=group, label=label, a=a, b=b, by=by), draw, by, bounds)


def _paired_rows(df: DataFrame, *, group: str, label: str, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """``alike_rows`` of both sides, stored: ``df``, often a join of all units, is derived once."""
    # the sides share the draw, not the rows
    long = df.select(*by, group, label, _sides(a, b)).select(*by, group, label, "_x.*")
    return materialise(alike_rows(long, group=group, score="s", label=label, by=[*by, "side"]))


def _deltas(alike: DataFrame, draw: Draw, by: Sequence[str], bounds: Sequence[float] | None) -> DataFrame:
    bounds = quantile_bounds(alike, "_s") if bounds is None else bounds
    auc = alike_replicates(alike, draw, by=[*by, "side"], bounds=bounds).withColumnRenamed("metric", "auc")
    return auc.groupBy(*by, "b").agg((_side_auc("a") - _side_auc("b")).alias("metric"))


def _sides(a: str, b: str) -> Column:
    pair = [F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("s")) for s, c in (("a", a), ("b", b))]
    return F.explode(F.array(*pair)).alias("_x")


def _side_auc(side: str) -> Column:
    return F.max(F.when(F.col("side") == side, F.col("auc")))


def paired_bootstrap(
    df: DataFrame, draw: Draw, *, group: str, label: str, a: str, b: str, by: Sequence[str] = ()
) -> DataFrame:
    """Delta on all rows, its percentile CI, and the share of replicates above zero."""
    by = list(by)
    alike = _paired_rows(df, group=group, label=label, a=a, b=b, by=by)
    bounds = quantile_bounds(alike, "_s")
    reps = _deltas(alike, draw, by, bounds)
    classes = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.col(n).alias("w")) for y, n in ((1, "_p"), (0, "_n"))]))
    whole = alike.select(*by, "side", "_s", classes.alias("_c")).select(*by, "side", "_s", "_c.*")
    point = roc_auc(whole, score="_s", label="y", weight="w", by=[*by, "side"], bounds=bounds)
    delta = point.groupBy(*by).agg((_side_auc("a") - _side_auc("b")).alias("delta"))
    ci = percentile_ci_with_share(reps, by=by)
    return ci.join(delta, by) if by else ci.withColumn("delta", delta.scalar())


def percentile_ci_with_share(reps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return reps.groupBy(*by).agg(
        F.percentile("metric", 0.025).alias("lo"),
        F.percentile("metric", 0.975).alias("hi"),
        ratio(F.count_if(F.col("metric") > 0), F.count("metric")).alias("p_gt_zero"),
        F.count("metric").alias("n_boot"),
    )


def bootstrap_mean(df: DataFrame, *, study: str, order: str, value: str, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """Percentile CI of the mean over a study's few repeats (resampled with replacement)."""
    # repeats per study are partition draws, a handful; their values travel as one array
    arrays = df.groupBy(study).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("_v")
    )
    draws = arrays.select(study, "_v", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    n = F.size("_v")
    picked = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.get("_v", F.floor(uniform(seed, F.col("b"), i) * n).cast("int"))
    )
    means = draws.select(study, (F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x) / n).alias("metric"))
    point = df.groupBy(study).agg(F.avg(value).alias("mean"), F.count("*").alias("n_repeats"))
    ci = percentile_ci(means, by=[study])
    excludes = (F.col("lo") > 0) | (F.col("hi") < 0)
    return point.join(ci, study).withColumn("excludes_zero", excludes)


def jackknife_auc(df: DataFrame, *, group: str, score: str, label: str, bounds: Sequence[float] | None = None) -> DataFrame:
    """(group, auc_without): leave-one-group-out AUC of every group in one pass.

    Removing group g removes its positives' wins and its negatives' losses; pairs inside g
    are removed twice that way and are added back once.
    """
    bounds = quantile_bounds(df, score) if bounds is None else bounds
    y = F.col(label)
    own = df.groupBy(group, F.col(score).alias("_s")).agg(
        F.sum(y).cast("double").alias("p"), F.sum(1 - y).cast("double").alias("n")
    )
    dist = own.groupBy("_s").agg(F.sum("p").alias("P"), F.sum("n").alias("N")).withColumn("_b", bucket_of(F.col("_s"), bounds))
    per_b = dist.groupBy("_b").agg(F.sum("P").alias("bp"), F.sum("N").alias("bn"))
    w_all = Window.partitionBy(F.lit(0))  # one row per bucket
    before = w_all.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select(
        "_b",
        F.coalesce(F.sum("bn").over(before), F.lit(0.0)).alias("on"),
        F.coalesce(F.sum("bp").over(before), F.lit(0.0)).alias("op"),
        F.sum("bp").over(w_all).alias("TP"),
        F.sum("bn").over(w_all).alias("TN"),
    )
    inside = Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    cum = dist.select(
        "_s", "_b", "P", "N",
        F.coalesce(F.sum("N").over(inside), F.lit(0.0)).alias("cn"),
        F.coalesce(F.sum("P").over(inside), F.lit(0.0)).alias("cp"),
    ).join(offs, "_b").select(
        "_s", "TP", "TN",
        (F.col("on") + F.col("cn") + F.col("N") / 2).alias("neg_below"),
        (F.col("TP") - F.col("op") - F.col("cp") - F.col("P") + F.col("P") / 2).alias("pos_above"),
    )
    per_group = own.join(cum, "_s").groupBy(group).agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"),
        F.sum(F.col("p") * F.col("neg_below")).alias("wins"),
        F.sum(F.col("n") * F.col("pos_above")).alias("losses"),
        F.max("TP").alias("TP"), F.max("TN").alias("TN"),
    )
    inner = roc_auc(df, score=score, label=label, by=[group], bounds=bounds).select(
        group, F.coalesce(F.col("auc") * F.col("n_pos") * F.col("n_neg"), F.lit(0.0)).alias("own")
    )
    total = per_group.agg(F.sum("wins")).scalar()
    left = F.col("TP") - F.col("p"), F.col("TN") - F.col("n")
    return per_group.join(inner, group).select(
        group, ratio(total - F.col("wins") - F.col("losses") + F.col("own"), left[0] * left[1]).alias("auc_without")
    )


def _bca(alpha: float):
    norm = NormalDist()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """Adjusted percentiles from the sorted replicate values (at most n_boot of them)."""
        v = pdf["metric"].dropna().sort_values()
        theta, acc = float(pdf["theta"].iloc[0]), float(pdf["acc"].iloc[0])
        share = min(max(((v < theta).sum() + 0.5 * (v == theta).sum()) / len(v), 1 / (2 * len(v))), 1 - 1 / (2 * len(v)))
        z0 = norm.inv_cdf(share)
        ends = []
        for q in (alpha / 2, 1 - alpha / 2):
            z = z0 + norm.inv_cdf(q)
            ends.append(float(v.quantile(norm.cdf(z0 + z / (1 - acc * z)))))
        return pd.DataFrame([(theta, ends[0], ends[1], z0, acc, len(v))], columns=["theta", "lo", "hi", "z0", "acc", "n_boot"])

    return solve


def bca_interval(df: DataFrame, draw: Draw, *, group: str, score: str, label: str, alpha: float = 0.05) -> DataFrame:
    """Bias-corrected accelerated interval with a group jackknife."""
    bounds = quantile_bounds(df, score)
    reps = replicates(df, draw, group=group, score=score, label=label, bounds=bounds)
    jack = jackknife_auc(df, group=group, score=score, label=label, bounds=bounds).where("auc_without IS NOT NULL")
    m = jack.agg(F.avg("auc_without")).scalar()
    dev = m - F.col("auc_without")
    acc = jack.agg(
        F.coalesce(F.try_divide(F.sum(dev * dev * dev), 6 * F.pow(F.sum(dev * dev), F.lit(1.5))), F.lit(0.0))
    ).scalar()
    theta = roc_auc(df, score=score, label=label, bounds=bounds).select("auc").scalar()
    d = reps.select("metric", theta.alias("theta"), acc.alias("acc"), F.lit(0).alias("_k"))
    return d.groupBy("_k").applyInPandas(
        _bca(alpha), "theta double, lo double, hi double, z0 double, acc double, n_boot long"
    )


RANKS = 64  # ranks whose distribution one task builds
DIRECT = 1 << 26  # products of a convolution term by term; longer ones go through the FFT


def _convolve(a: np.ndarray, b: np.ndarray, keep: int) -> np.ndarray:
    """First ``keep`` terms of the distribution of a sum."""
    if len(a) * len(b) <= DIRECT:
        return np.convolve(a, b)[:keep]
    n = 1 << (len(a) + len(b) - 2).bit_length()
    return np.maximum(np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n)[: min(keep, len(a) + len(b) - 1)], 0.0)


def _tie_distribution(rank2: int, n: int, keep: int) -> np.ndarray:
    """Distribution of rank2 * Binomial(n, 1/2), up to ``keep`` terms."""
    k = np.arange(min(n, (keep - 1) // rank2) + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k.tolist()]) - n * math.log(2)
    out = np.zeros(int(k[-1]) * rank2 + 1)
    out[k * rank2] = np.exp(logs) if n > 50 else [math.comb(n, i) / 2**n for i in k.tolist()]
    return out


def wilcoxon_exact(df: DataFrame, *, family: str, a: str, b: str) -> DataFrame:
    """Exact two-sided paired signed-rank test per family; NULL when all differences are zero.

    Equal absolute differences are one row with counts; prefix sums in buckets of the size give their
    mean rank.  Runs of at most 64 ranks give the null distributions of their own doubled rank sums, up
    to the observed statistic, and those are merged two by two: a family spreads over as many tasks as
    it has runs, and the last step is a sum of products.
    """
    d = df.select(F.col(family).alias("_f"), (F.col(a) - F.col(b)).alias("_d")).where("_d IS NOT NULL")
    sizes = materialise(
        d.where("_d <> 0").groupBy("_f", F.abs("_d").cast("double").alias("_z")).agg(
            F.count("*").alias("n"), F.count_if(F.col("_d") > 0).alias("p")
        )
    )
    ranked = running_before(sizes, part=["_f"], order="_z", tie="_z", sums={"before": "n"})
    ranked = materialise(ranked.select("_f", "n", "p", "before", (2 * F.col("before") + F.col("n") + 1).alias("r2")))
    s = ranked.groupBy("_f").agg(
        F.least(F.sum(F.col("p") * F.col("r2")), F.sum((F.col("n") - F.col("p")) * F.col("r2"))).alias("stat2"),
        F.sum("n").alias("n_nonzero"),
    )
    schema = d.schema["_f"].dataType.simpleString()
    arrays = f"_f {schema}, run long, stat2 long, w binary"

    def one_run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, w = int(pdf["stat2"].iloc[0]) + 1, np.ones(1)
        for r2, n in sorted(zip(pdf["r2"].tolist(), pdf["n"].tolist())):
            w = _convolve(w, _tie_distribution(r2, n, keep), keep)
        return _blob(pdf, w)

    def two_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, w = int(pdf["stat2"].iloc[0]) + 1, np.ones(1)
        for blob in pdf.sort_values("run")["w"]:
            w = _convolve(w, np.frombuffer(blob), keep)
        return _blob(pdf.assign(run=pdf["run"] // 2), w)

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        """P(sum <= stat2) from the two halves left, without their convolution."""
        stat2, parts = int(pdf["stat2"].iloc[0]), [np.frombuffer(b) for b in pdf["w"]]
        lower = parts[0]
        upper = np.cumsum(parts[1]) if len(parts) > 1 else np.ones(1)
        at = np.minimum(stat2 - np.arange(len(lower)), len(upper) - 1)
        cdf = float((lower * upper[at]).sum())
        return pd.DataFrame({"_f": pdf["_f"].iloc[:1], "p_value": [min(1.0, 2 * cdf)]})

    runs = ranked.withColumn("run", F.floor(F.col("before") / RANKS)).join(s, "_f")
    parts = materialise(runs.groupBy("_f", "run").applyInPandas(one_run, arrays))
    last = parts.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    while last > 1:
        parts = materialise(parts.groupBy("_f", F.floor(F.col("run") / 2)).applyInPandas(two_runs, arrays))
        last //= 2
    p = parts.groupBy("_f").applyInPandas(below, f"_f {schema}, p_value double")
    out = s.join(p, "_f").select("_f", "n_nonzero", (F.col("stat2") / 2).alias("statistic"), "p_value")
    return d.select("_f").distinct().join(out, "_f", "left").withColumnRenamed("_f", family)


def _blob(pdf: pd.DataFrame, w: np.ndarray) -> pd.DataFrame:
    return pdf[["_f", "run", "stat2"]].iloc[:1].assign(w=[np.ascontiguousarray(w, dtype="<f8").tobytes()])
