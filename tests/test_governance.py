"""Ledger rules against golden rows and brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupaudit.functions import hashing as h
from groupaudit.functions import scalars as s
from groupaudit.operators import governance as gov

# Honest AUC, bar, ECE, worst subgroup, cross-corpus, leaky, negative control, and the total.
GOLDEN = [
    ("R0", 0.86, 0.62, 0.07, 0.81, 0.71, 0.92, 0.51, 0.0800),
    ("R1", 0.66, 0.58, 0.06, 0.63, 0.64, 0.67, 0.51, 0.0530),
    ("D1", 0.63, 0.58, 0.09, 0.60, 0.52, 0.95, 0.52, -0.3560),
    ("D2", 0.85, 0.84, 0.06, 0.80, 0.55, 0.86, 0.51, -0.1850),
    ("D3", 0.88, 0.62, 0.34, 0.84, 0.70, 0.90, 0.51, -0.0130),
    ("D4", 0.89, 0.62, 0.06, 0.58, 0.72, 0.90, 0.51, -0.0420),
    ("D6", 0.50, 0.50, 0.01, 0.50, 0.50, 0.50, 0.50, -0.1000),
    ("D7", 0.72, 0.55, 0.08, 0.68, 0.60, 0.75, 0.66, -0.3070),
]
TERMS = "auc_honest auc_conf_max ece auc_subgroup_min auc_crosscorpus auc_leaky auc_negctrl".split()
SCHEMA = "row string, " + ", ".join(f"{t} double" for t in TERMS) + ", sigma_null double, rung int"


def row(name, values, rung=4):
    return (name, *values, 0.02, rung)


def test_composite_golden_rows(spark):
    df = spark.createDataFrame([row(g[0], g[1:8]) for g in GOLDEN], SCHEMA)
    got = {r["row"]: r["composite"] for r in gov.composite(df).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {g[0]: g[8] for g in GOLDEN}
    assert all(got[k] < got["R1"] for k in got if k.startswith("D"))


def test_composite_null_policy_by_rung(spark):
    full, no_xc = GOLDEN[0][1:8], (*GOLDEN[0][1:5], None, *GOLDEN[0][6:8])
    rows = [row(f"r{k}", full, k) for k in range(5)] + [row("x3", no_xc, 3), row("x4", no_xc, 4)]
    rows += [row(f"miss{i}", [None if i == j else v for j, v in enumerate(full)]) for i in range(7)]
    got = {r["row"]: r["composite"] for r in gov.composite(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[f"r{k}"] is None for k in range(5)] == [True, True, True, False, False]
    assert got["x3"] == pytest.approx(0.17) and got["x4"] is None
    assert all(got[f"miss{i}"] is None for i in range(7))


def test_composite_slope_never_rewards_a_lower_auc(spark):
    base = (0.80, 0.55, 0.05, 0.60, 0.60, 0.90, 0.50)
    up = (0.81, *base[1:])
    got = [r["composite"] for r in gov.composite(spark.createDataFrame([row("a", base), row("b", up)], SCHEMA)).orderBy("row").collect()]
    assert (got[1] - got[0]) / 0.01 == pytest.approx(0.65)


def test_pareto_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(k=range(300))
    want = {i for i in range(300) if not (((x >= x[i]).all(1)) & ((x > x[i]).any(1))).any()}
    df = spark.createDataFrame(pdf).repartition(7).unionByName(spark.createDataFrame([(None, 99.0, 99.0, 999)], "a double, b double, c double, k long"))
    got = {r["k"] for r in gov.pareto_frontier(df, key="k", axes=list("abc")).collect()}
    assert got == want


def frontier_of(x):
    return {i for i in range(len(x)) if not ((x >= x[i]).all(1) & (x > x[i]).any(1)).any()}


@pytest.mark.parametrize("block,fan", [(64, 2), (64, 8), (8192, 8)])
def test_pareto_of_seven_opposed_axes(spark, block, fan):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 7))
    x -= x.mean(axis=1, keepdims=True) * rng.choice([0.7, 1.0], (1500, 1))  # what one axis gains the others lose
    x[::5, 0], x[1::5, 1] = np.inf, -np.inf
    axes = list("abcdefg")
    df = spark.createDataFrame(pd.DataFrame(x, columns=axes).assign(k=range(1500))).repartition(5)
    out = gov.pareto_frontier(df, key="k", axes=axes, block=block, fan=fan)
    want = frontier_of(x)
    assert len(want) > 600 and {r["k"] for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_pareto_keeps_every_copy_and_takes_odd_numbers(spark):
    nan = float("nan")
    rows = [(i, 1.0, 2.0) for i in range(2000)] + [(3000, 0.0, 3.0), (3001, -0.0, 3.0), (3002, 1.0, 1.0), (3003, nan, -9.0), (3004, None, 99.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    assert {r["k"] for r in gov.pareto_frontier(df, key="k", axes=["a", "b"]).collect()} == {*range(2000), 3000, 3001, 3003}
    assert gov.pareto_frontier(df.where("false"), key="k", axes=["a", "b"]).count() == 0


def test_promotion_gate_rules(spark):
    rows = [
        ("tie", 1, 0.5, 1.0, True, None), ("win", 1, 0.6, 1.0, True, None), ("side", 1, 0.6, 0.1, True, None),
        ("audit", 1, 0.6, 1.0, False, True), ("shuffle", 3, 0.6, 1.0, True, False), ("top", 4, 0.6, 1.0, True, True), ("wait", 1, None, 1.0, True, True),
        ("unaudited", 1, 0.6, 1.0, None, True), ("no_side", 1, 0.6, None, True, True),
    ]
    df = spark.createDataFrame(rows, "m string, rung int, primary double, side double, split_audit_ok boolean, shuffle_ok boolean")
    base = spark.createDataFrame([(k, 0.5, 1.0) for k in range(5)], "rung int, primary_base double, side_base double")
    got = {r["m"]: r["verdict"] for r in gov.promotion_gate(df, base, method="m", side_axes=["side"], tolerance=0.2).collect()}
    assert got == {"tie": "DEMOTE", "win": "PROMOTE", "side": "DEMOTE", "audit": "DEMOTE", "shuffle": "DEMOTE", "top": "HOLD", "wait": "HOLD", "unaudited": "DEMOTE", "no_side": "HOLD"}


def test_champion_needs_strict_improvement_and_seeds(spark):
    rows = [(1, 0.5, 7), (2, 0.9, 1), (3, 0.5, 7), (4, 0.8, 3), (5, 0.7, 9), (6, 0.75, 4)]  # 4, a nominee, raises no bar
    df = spark.createDataFrame([("c", *r) for r in rows], "c string, t int, m double, n int")
    got = gov.champion_trace(df, claim="c", order="t", tie="t", metric="m", seeds="n").orderBy("t").collect()
    assert [r["status"] for r in got] == ["CHAMPION", "EXPLORATION", "KEEP OLD", "NOMINEE", "CHAMPION", "NOMINEE"]


def test_budget_prefix_keeps_the_group_that_crosses(spark):
    df = spark.createDataFrame([(1, 6), (2, 6), (3, 6)], "d int, n int")
    got = gov.budget_prefix(df, order="d", size="n", budget=10).orderBy("d").collect()
    assert [r["processed"] for r in got] == [True, True, False]


@pytest.mark.parametrize(
    "gates, verdict",
    [
        ((1, 1, 1, 1, 1, 1, 0, 0), "BREAKS"), ((1, 1, 1, 1, 1, 1, 1, 0), "ATTENUATED"), ((1, 1, 1, 1, 1, 0, 1, 1), "HOLDS"),
        ((0, 1, 1, 1, 1, 1, 0, 0), "BROKEN"), ((1, 1, 1, 0, 1, 1, 0, 0), "BROKEN"), ((1, 1, 1, 1, 0, 1, 0, 0), "INCONCLUSIVE"),
        ((1, 1, 1, 1, 1, 0, 1, 0), "INCONCLUSIVE"), ((1, 1, None, 1, 1, 1, 0, 0), "INCONCLUSIVE"), ((0, 1, 1, 1, None, 1, 0, 0), "INCONCLUSIVE"),
    ],
)
def test_claim_verdict_table(spark, gates, verdict):
    names = ("manipulation_ok orthogonal_ok class_direction_collapses shuffle_in_band variance_matched "
             "effect_excludes_zero removed_excludes_chance effect_in_noise").split()
    df = spark.createDataFrame([tuple(None if g is None else bool(g) for g in gates)], ", ".join(f"{n} boolean" for n in names))
    assert df.select(gov.claim_verdict()).first()[0] == verdict


def test_status_and_leak_patterns(spark):
    texts = [("fine * text", None), ("a **bold** word", "bold"), ("| ---- |", "table_rule"), ("x\n## Head", "heading"), ("**b** and | --- |", "bold,table_rule")]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [",".join(x["pattern"] for x in r[0]) or None for r in df.select(s.leaks("t")).collect()] == [p for _, p in texts]
    ids = spark.createDataFrame([("see arXiv:2401.12345 and arXiv:1234.5678",)], "t string").select(s.identifiers("t")).first()[0]
    assert ids == ["2401.12345", "1234.5678"]


def test_found_or_raise(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    with pytest.raises(Exception, match="no match for anchor"):
        df.select(s.found_or_raise(F.col("t"), "anchor")).collect()


def test_ordered_digest_has_two_levels_however_large_the_keys(spark):
    keys = [0, 1, 2, 5, 9, 100, 101, 1_000_003]
    df = spark.createDataFrame([(k, f"line {k}") for k in reversed(keys)], "k long, line string")
    digest = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    blocks = [digest(f"line {k}" for k in keys if k // 2 == b) for b in sorted({k // 2 for k in keys})]
    got = h.ordered_digest(df, order="k", line="line", block=2).first()
    assert tuple(got) == (digest(blocks), len(blocks))
    assert tuple(h.ordered_digest(df.limit(0), order="k", line="line", block=2).first()) == (None, 0)
