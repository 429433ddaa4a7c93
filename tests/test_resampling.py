"""Bootstrap, jackknife, intervals and rank tests."""

import collections
import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_metrics import brute_auc

from groupaudit.functions import hashing as h
from groupaudit.operators import inference as inf
from groupaudit.operators import resampling as rs
from groupaudit.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 120
    pdf = pd.DataFrame({"g": rng.integers(0, 12, n), "y": rng.integers(0, 2, n), "s": rng.integers(0, 15, n) / 15, "t": rng.random(n).round(2)})
    return pdf, spark.createDataFrame(pdf)


def test_multinomial_draws_as_many_groups_as_there_are(spark, data):
    _, df = data
    w = rs.multinomial_weights(df.select("g").distinct(), group="g", n_boot=30, seed=3)
    sums = w.groupBy("b").agg(F.sum("w").alias("n")).toPandas()
    assert len(sums) == 30 and (sums.n == 12).all()


def test_poisson_weights_have_mean_and_variance_one(spark):
    g = spark.range(4000).withColumnRenamed("id", "g")
    w = rs.poisson_weights(g, group="g", n_boot=20, seed=0).toPandas()
    full = np.zeros(80_000)
    full[: len(w)] = w.w
    assert full.mean() == pytest.approx(1.0, abs=0.02) and full.var() == pytest.approx(1.0, abs=0.03)


def test_groups_whose_mixed_keys_are_equal_draw_for_themselves(spark):
    g = spark.createDataFrame([(14685,), (154048,)], "g long")
    per = lambda w: {k: set(zip(p.b, p.w)) for k, p in w.toPandas().groupby("g")}
    mixed, alone = (per(f(g, group="g", n_boot=40, seed=1)) for f in (rs.poisson_weights, rs.independent_poisson_weights))
    assert mixed[14685] == mixed[154048] and alone[14685] != alone[154048]


def test_the_poisson_query_draws_for_every_speaker_and_replicate(spark, sf):
    got = {(r["b"], r["speaker_id"]): r["w"] for r in QUERIES["b01_poisson_weights"].fn(spark, sf).collect()}
    speakers = [r["o_custkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect()]
    for b, k in itertools.product(range(40), speakers):
        u = int(hashlib.md5(f"1|{b}|{k}".encode()).hexdigest()[:13], 16) / 2**52
        assert got.get((b, k), 0) == sum(u >= t for t in h.poisson_thresholds(h.LAST_COUNT))


def test_the_multinomial_query_draws_for_every_slot_and_replicate(spark, sf):
    got = {(r["b"], r["group_id"]): r["w"] for r in QUERIES["b01_multinomial_weights"].fn(spark, sf).collect()}
    suppliers = {r["l_suppkey"] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    digest = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    order, n = sorted(suppliers, key=lambda k: digest(1, k)), len(suppliers)
    want = collections.Counter(
        (b, order[int(int(digest(1, b, slot)[:13], 16) / 2**52 * n)]) for b in range(50) for slot in range(1, n + 1)
    )
    assert got == want


@pytest.mark.parametrize("scheme", ["poisson", "multinomial"])
@pytest.mark.parametrize("edges", [[], [0.2, 0.4, 0.8], None])
def test_replicates_equal_copying_rows(spark, data, scheme, edges):
    pdf, df = data
    draw = rs.cluster_weights(df.select("g").distinct(), group="g", n_boot=300, seed=5, scheme=scheme)
    got = {r["b"]: r["metric"] for r in rs.replicates(df, draw, group="g", score="s", label="y", bounds=edges).collect()}
    assert sorted(got) == list(range(300))
    for b, ww in draw.rows().toPandas().groupby("b"):
        copies = pd.concat([pdf[pdf.g == g] for g, k in zip(ww.g, ww.w) for _ in range(k)])
        assert got[b] == pytest.approx(brute_auc(copies.y.to_numpy(), copies.s.to_numpy()), abs=1e-12)


@pytest.mark.parametrize("metric", ["uar", "brier", "ece"])
def test_sums_equal_copying_rows(spark, data, metric):
    pdf, df = data
    draw = rs.cluster_weights(df.select("g").distinct(), group="g", n_boot=260, seed=5)
    two = df.withColumn("k", F.lit("x")).union(df.where("g < 6").withColumn("k", F.lit(None)))
    got = {(r["k"], r["b"]): r["metric"] for r in rs.replicates(two, draw, group="g", score="s", label="y", metric=metric, by=["k"]).collect()}
    assert len(got) == 520
    for b, ww in draw.rows().toPandas().groupby("b"):
        w = pdf.g.map(dict(zip(ww.g, ww.w))).fillna(0).to_numpy()
        for k, use in (("x", w), (None, w * (pdf.g < 6))):
            y, s = pdf.y.to_numpy(), pdf.s.to_numpy()
            if not (use @ y and use @ (1 - y)):
                assert got[k, b] is None
                continue
            want = {
                "uar": (use @ (y * (s >= 0.5)) / (use @ y) + use @ ((1 - y) * (s < 0.5)) / (use @ (1 - y))) / 2,
                "brier": use @ (s - y) ** 2 / use.sum(),
                "ece": sum(abs((use * (y - s))[np.minimum(np.floor(s * 15), 14) == i].sum()) for i in range(15)) / use.sum(),
            }[metric]
            assert got[k, b] == pytest.approx(want, abs=1e-12)


def test_one_class_replicates_are_null_and_odd_rows_do_not_count(spark, data):
    _, df = data
    one = df.withColumn("y", (F.col("g") == 3).cast("int"))
    odd = one.union(spark.createDataFrame([(3, 1, float("nan"), 0.5), (3, None, 0.5, 0.5), (4, 0, None, 0.5)], df.schema))
    draw = rs.cluster_weights(df.select("g").distinct(), group="g", n_boot=60, seed=5)
    drawn = {r["b"] for r in draw.rows().where("g = 3").collect()}
    a, b = ({r["b"]: r["metric"] for r in rs.replicates(x, draw, group="g", score="s", label="y").collect()} for x in (one, odd))
    assert a == b and {k for k, v in a.items() if v is not None} == drawn and 0 < len(drawn) < 60
    assert rs.replicates(df.where("false"), draw, group="g", score="s", label="y").count() == 0


def test_bootstrap_plan_has_no_replicate_rows(spark, data):
    """Rows are joined to nothing; the widest thing that moves has one row per bucket and slice."""
    _, df = data
    big = spark.range(20_000).selectExpr("id % 500 AS g", "cast(id % 2 AS int) AS y", "rand(3) AS s")
    draw = rs.cluster_weights(big.select("g").distinct(), group="g", n_boot=2000, seed=1)
    reps = rs.replicates(big, draw, group="g", score="s", label="y")
    plan = reps._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert reps.count() == 2000


def test_hot_score_and_hot_group_spread(spark):
    """A third of the rows share one score, a third one group: exact under any edges."""
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.33, 0, rng.integers(1, 40, n)), "y": rng.integers(0, 2, n)})
    pdf["s"] = np.where(rng.random(n) < 0.33, 0.5, rng.random(n)).round(3)
    draw = rs.cluster_weights(spark.range(40).selectExpr("id AS g"), group="g", n_boot=20, seed=2)
    got = {r["b"]: r["metric"] for r in rs.replicates(spark.createDataFrame(pdf), draw, group="g", score="s", label="y").collect()}
    for b, ww in draw.rows().toPandas().groupby("b"):
        w = pdf.g.map(dict(zip(ww.g, ww.w))).fillna(0).to_numpy()
        assert got[b] == pytest.approx(brute_auc(pdf.y.to_numpy(), pdf.s.to_numpy(), w), abs=1e-12)


def test_paired_bootstrap_derives_its_rows_once(spark, data):
    _, df = data
    left, right = df.select("g", "y", "s", F.monotonically_increasing_id().alias("u")), df.select("t", F.monotonically_increasing_id().alias("u"))
    draw = rs.cluster_weights(df.select("g").distinct(), group="g", n_boot=20, seed=3)
    out = rs.paired_bootstrap(left.join(right, "u"), draw, group="g", label="y", a="s", b="t")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_paired_deltas_share_the_draw(spark, data):
    pdf, df = data
    draw = rs.cluster_weights(df.select("g").distinct(), group="g", n_boot=5, seed=5)
    got = {r["b"]: r["metric"] for r in rs.paired_deltas(df, draw, group="g", label="y", a="s", b="t").collect()}
    for b, ww in draw.rows().toPandas().groupby("b"):
        wt = pdf.g.map(dict(zip(ww.g, ww.w))).fillna(0).to_numpy()
        want = brute_auc(pdf.y.to_numpy(), pdf.s.to_numpy(), wt) - brute_auc(pdf.y.to_numpy(), pdf.t.to_numpy(), wt)
        assert got[b] == pytest.approx(want, abs=1e-12)


def test_jackknife_equals_leaving_each_group_out(spark, data):
    pdf, df = data
    for r in rs.jackknife_auc(df, group="g", score="s", label="y").collect():
        rest = pdf[pdf.g != r["g"]]
        assert r["auc_without"] == pytest.approx(brute_auc(rest.y.to_numpy(), rest.s.to_numpy()), abs=1e-12)


def test_bca_brackets_the_estimate_and_reduces_to_percentiles(spark, data):
    _, df = data
    w = rs.cluster_weights(df.select("g").distinct(), group="g", n_boot=200, seed=5)
    r = rs.bca_interval(df, w, group="g", score="s", label="y").first()
    assert r["lo"] < r["theta"] < r["hi"] and r["n_boot"] == 200
    solve = rs._bca(0.05)
    v = np.linspace(0, 1, 1001)
    flat = solve(pd.DataFrame({"metric": v, "theta": 0.5, "acc": 0.0})).iloc[0]
    assert (flat.lo, flat.hi) == pytest.approx((0.025, 0.975), abs=1e-6)


@pytest.mark.parametrize("d, stat, p", [([1, 2, 3, 4, 5, 6, 7, 8], 0.0, 0.0078125), ([-1, 2, 3, 4, 5, 6, 7, 8], 1.0, 0.015625)])
def test_wilcoxon_golden(spark, d, stat, p):
    rows = [("f", float(x), 0.0) for x in d]
    r = rs.wilcoxon_exact(spark.createDataFrame(rows, "f string, a double, b double"), family="f", a="a", b="b").first()
    assert (r["statistic"], r["p_value"]) == pytest.approx((stat, p))


def test_wilcoxon_with_ties_equals_enumeration_and_zero_is_null(spark):
    d = [0.5, -0.5, 1.0, 2.0, 2.0, -3.0, 0.0]
    nz = np.array([x for x in d if x])
    ranks = pd.Series(np.abs(nz)).rank().to_numpy()
    stat = min(ranks[nz > 0].sum(), ranks[nz < 0].sum())
    sums = [sum(r for r, k in zip(ranks, mask) if k) for mask in itertools.product([0, 1], repeat=len(nz))]
    want = min(1.0, 2 * np.mean(np.array(sums) <= stat))
    rows = [("f", x, 0.0) for x in d] + [("z", 1.0, 1.0)]
    got = {r["f"]: r["p_value"] for r in rs.wilcoxon_exact(spark.createDataFrame(rows, "f string, a double, b double"), family="f", a="a", b="b").collect()}
    assert got["f"] == pytest.approx(want) and got["z"] is None


@pytest.mark.parametrize("n, decimals, direct", [(900, 6, True), (900, 6, False), (700, 2, True)])
def test_wilcoxon_of_one_large_family_spreads(spark, monkeypatch, n, decimals, direct):
    """Runs of ranks merged two by two equal the distribution built rank by rank; ties are binomials."""
    if not direct:
        monkeypatch.setattr(rs, "DIRECT", 1000)
    rng = np.random.default_rng(n)
    d = (rng.normal(0.04, 1, n)).round(decimals)
    d[:3] = 0
    rows = [("f", float(x), 0.0) for x in d] + [("g", 1.0, 0.0), ("g", -2.0, 0.0)]
    got = {r["f"]: r for r in rs.wilcoxon_exact(spark.createDataFrame(rows, "f string, a double, b double"), family="f", a="a", b="b").collect()}
    nz = d[d != 0]
    r2 = (2 * pd.Series(np.abs(nz)).rank()).astype(int).to_numpy()
    stat2 = min(r2[nz > 0].sum(), r2[nz < 0].sum())
    null = np.zeros(r2.sum() + 1)
    null[0] = 1
    for r in r2:
        null[r:] = (null[r:] + null[: len(null) - r]) / 2
        null[:r] /= 2
    assert got["f"]["n_nonzero"] == len(nz) and got["f"]["statistic"] == stat2 / 2
    assert got["f"]["p_value"] == pytest.approx(min(1, 2 * null[: stat2 + 1].sum()), rel=1e-9)
    assert got["g"]["p_value"] == 1.0


@pytest.mark.parametrize("n, largest_m", [(7, 3), (8, 6), (9, 12), (10, 25), (12, 102)])
def test_power_table(spark, n, largest_m):
    rows = spark.createDataFrame([(n, largest_m), (n, largest_m + 1)], "n int, m int")
    got = [r["feasible"] for r in rows.select(*inf.power_columns(F.col("n"), F.col("m"))).collect()]
    assert got == [True, False]


def test_holm_is_monotone_and_matches_hand_computation(spark):
    ps = [0.01, 0.04, 0.03, 0.005]
    rows = [("f", i, p) for i, p in enumerate(ps)]
    got = inf.holm(spark.createDataFrame(rows, "f string, i int, p double"), family="f", p="p", tie="i").toPandas().sort_values("p")
    assert list(got.p_holm.round(6)) == [0.02, 0.03, 0.06, 0.06]
    assert list(got.reject) == [True, True, False, False]


def test_holm_of_one_large_family_with_ties_and_holes(spark):
    rng = np.random.default_rng(1)
    p = np.where(rng.random(3000) < 0.3, 0.01, rng.random(3000) ** 4)
    pdf = pd.DataFrame({"f": ["one"] * 2990 + [None] * 10, "i": range(3000), "p": p})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([("one", 9999, None)], "f string, i long, p double"))
    got = inf.holm(df, family="f", p="p", tie="i").toPandas().set_index("i")
    assert len(got) == 3001 and np.isnan(got.p_holm[9999])
    for f, own in pdf.groupby("f", dropna=False):
        order = own.sort_values("p")
        want = np.minimum(1, np.maximum.accumulate(order.p.to_numpy() * (len(own) - np.arange(len(own)))))
        assert got.p_holm[order.i].to_numpy() == pytest.approx(want, rel=1e-12)


def test_wins_and_mean_delta_golden(spark):
    rng = np.random.default_rng(0)
    a = rng.random(10)
    rows = [(0, float(x), float(x - 0.026930)) for x in a]
    r = inf.paired_wins(spark.createDataFrame(rows, "k int, a double, b double"), by=["k"], a="a", b="b").first()
    assert r["n_wins"] == 10 and r["mean_delta"] == pytest.approx(0.026930)


def test_sign_aware_verdict_golden(spark):
    rows = [(-0.05, 0.01, -0.09), (0.05, 0.01, 0.02), (0.05, 0.2, 0.02), (0.05, 0.01, -0.01)]
    df = spark.createDataFrame(rows, "d double, p double, lo double")
    got = [r[0] for r in df.select(inf.sign_aware_verdict(F.col("d"), F.col("p"), F.col("lo"))).collect()]
    assert got == ["FALSIFIED", "SUPPORTED", "INCONCLUSIVE", "INCONCLUSIVE"]


def test_identity_share_raises_without_support(spark):
    df = spark.createDataFrame([(0.1, False)], "d double, excludes_zero boolean")
    with pytest.raises(Exception, match="no rank excludes zero"):
        inf.identity_share(df, auc_full=F.lit(0.7)).collect()
    ok = spark.createDataFrame([(0.0565, True), (0.0922, True), (0.5, False)], "d double, excludes_zero boolean")
    r = inf.identity_share(ok, auc_full=F.lit(0.7382)).first()
    assert (round(r["share_lo"], 3), round(r["share_hi"], 3)) == (0.237, 0.387)


def test_margin_floor_and_binding_interval(spark):
    df = spark.createDataFrame([(0.7, 0.4, -0.1, 0.2, 0.0, 0.3)], "a double, bar double, l1 double, h1 double, l2 double, h2 double")
    assert df.select(inf.honest_margin(F.col("a"), F.col("bar"))).first()[0] == pytest.approx(0.2)
    r = inf.more_conservative(df, lo_a="l1", hi_a="h1", lo_b="l2", hi_b="h2").first()
    assert (r["lo"], r["hi"]) == (-0.1, 0.3)


def test_scheme_is_chosen_and_not_a_matter_of_size(spark):
    g = spark.range(50).select(F.col("id").alias("g"))
    for scheme, fn in rs.SCHEMES.items():
        got = rs.cluster_weights(g, group="g", n_boot=4, seed=2, scheme=scheme)
        assert sorted(got.rows().collect()) == sorted(fn(g, group="g", n_boot=4, seed=2).collect())


def test_a_groups_fingerprint_does_not_depend_on_other_groups(spark):
    from groupaudit.functions.hashing import order_free_digest

    one = spark.range(300).select(F.lit("a").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    more = one.union(spark.range(3000).select(F.lit("b"), F.sha2(F.col("id").cast("string"), 256)))
    alone, among = (order_free_digest(x, "d", ["k"]).where("k = 'a'").first() for x in (one, more))
    assert alone == among


def test_fingerprints_add_up_and_forget_the_order(spark):
    """A stored state and new rows give the fingerprint of all rows; taking rows away gives the old one."""
    import hashlib

    from groupaudit.functions import hashing as h

    rows = spark.range(500).select((F.col("id") % 2).alias("k"), F.sha2((F.col("id") % 90).cast("string"), 256).alias("d"))
    old, new = h.multiset_state(rows.limit(300), "d", ["k"]), h.multiset_state(rows.exceptAll(rows.limit(300)), "d", ["k"])
    both = h.merge_states(old.union(new), ["k"])
    whole = {r["k"]: r["fingerprint"] for r in h.order_free_digest(rows.repartition(7), "d", ["k"]).collect()}
    merged = both.select("k", h.state_digest(F.col("lanes"), F.col("n_rows")).alias("f"))
    assert {r["k"]: r["f"] for r in merged.collect()} == whole
    minus = new.select("k", -F.col("n_rows"), F.transform("lanes", lambda x: -x))
    back = h.merge_states(both.union(minus), ["k"]).select("k", h.state_digest(F.col("lanes"), F.col("n_rows")).alias("f"))
    first = {r["k"]: r["fingerprint"] for r in h.order_free_digest(rows.limit(300), "d", ["k"]).collect()}
    assert {r["k"]: r["f"] for r in back.collect()} == first
    total = sum(int(r["d"], 16) for r in rows.where("k = 0").collect()) % 2**256
    assert whole[0] == hashlib.sha256(f"{total:064x}:250".encode()).hexdigest()
    plan = h.order_free_digest(rows, "d", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan.lower()


def test_sums_are_added_up_per_group_before_weights_are_derived(spark):
    df = spark.createDataFrame([(i % 3, 0.1 * (i % 10), i % 2) for i in range(60)], "g int, s double, y int")
    draw = rs.cluster_weights(df.select("g").distinct(), group="g", n_boot=20, seed=4)
    for metric in rs.SUMS:
        plan = rs.replicates(df, draw, group="g", score="s", label="y", metric=metric)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [" in plan[plan.index("MapInPandas") :]


def test_score_blocks_keep_ties_together_and_count_every_pair():
    rng = np.random.default_rng(8)
    s = np.sort(np.concatenate([rng.integers(0, 40, 900) / 7, np.full(200, 2.5), rng.random(500), [-np.inf, -np.inf, np.inf]]))
    p = rng.integers(0, 3, len(s)).astype(float)
    n, w = rng.integers(0, 5, len(s)).astype(float), rng.integers(0, 6, (len(s), 7)).astype(np.uint8)
    cuts, tied = rs._score_blocks(s)
    assert cuts[0] == 0 and cuts[-1] == len(s) and tied.any() and (s[cuts[1:-1]] != s[cuts[1:-1] - 1]).all()
    assert (np.diff(cuts)[~tied] <= rs.BLOCK).all()
    pos, neg, u = rs._block_sums(s, p, n, cuts, tied, lambda i, j: w[i:j])
    got = (u + pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0)
    higher = (s[:, None] > s) + (s[:, None] == s) / 2
    assert np.allclose(got, ((p[:, None] * w) * (higher @ (n[:, None] * w))).sum(axis=0), rtol=1e-12)
    a, c = h.replicate_factors(3, 300)
    keys = rng.integers(0, h.MODULUS, 130)
    assert (h.poisson_draws(a, c, keys) == h.poisson_counts(h.mixed_array(a, c, keys))).all()
