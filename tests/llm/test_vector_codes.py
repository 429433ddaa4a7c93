"""Product codes against plain k-means in whole numbers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect

from groupaudit.llm import queries
from groupaudit.llm.vector_codes import assign, search_all, shifted, squared, vector_codes


def plain(vectors, first, parts, rounds):
    """Lloyd's rounds in Python integers: nearest entry, ties to the lower index; floor of the mean."""
    width = len(first[0])
    cuts = [slice(k * width // parts, (k + 1) * width // parts) for k in range(parts)]
    books = [[list(f[c]) for f in first] for c in cuts]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for c, book in zip(cuts, books):
            members = [[] for _ in book]
            for v in vectors:
                members[nearest(v[c], book)[0]].append(v[c])
            for e, own in enumerate(members):
                if own:
                    book[e] = [sum(x) // len(own) for x in zip(*own)]
    coded = [[nearest(v[c], book) for c, book in zip(cuts, books)] for v in vectors]
    return [(bytes(k for k, _ in c), sum(d for _, d in c)) for c in coded], books


def test_query_matches_sql(spark, sf):
    got = queries.QUERIES["op13_vector_codes"](spark, sf).toArrow()
    assert compare(got, connect(sf).sql(queries.SQL["op13_vector_codes"]).to_arrow_table()) == []


@pytest.mark.parametrize("entries,parts,width,spread", [(16, 8, 64, 1.0), (32, 3, 10, 0.004), (5, 2, 4, 1.0)])
def test_codes_match_plain_rounds(spark, entries, parts, width, spread):
    rng = np.random.default_rng(entries)
    centres = rng.normal(0, spread, (7, width))
    vectors = (centres[rng.integers(0, 7, 600)] + rng.normal(0, spread / 5, (600, width))).round(6)
    rows = [(i * 3 % 601, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    coded, books = vector_codes(df, entries=entries, parts=parts, rounds=4)
    whole = {i: [math.floor(4096 * x) for x in v] for i, v, _ in rows}
    want, want_books = plain([whole[i] for i, _, _ in rows], [whole[i] for i in sorted(whole)[:entries]], parts, 4)
    got = {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in coded.collect()}
    assert got == {r[0]: w for r, w in zip(rows, want)}
    cuts = [slice(k * width // parts, (k + 1) * width // parts) for k in range(parts)]
    assert [books[:, c].tolist() for c in cuts] == want_books


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 20), st.integers(0, 6), st.integers(1, 30))
def test_bounds_never_decide_wrongly(seed, k, b, most):
    """Entries and rows from a small grid, so that ties abound; several moves, b as it may come."""
    rng, b = np.random.default_rng(seed), min(b, k - 1)
    x, entries = rng.integers(-most, most + 1, (80, 2)), rng.integers(-most, most + 1, (k, 2))
    code, near, bound = search_all(x, entries, b)
    for _ in range(4):
        new = entries + rng.integers(-2, 3, (k, 2)) * rng.integers(0, 2, (k, 1))
        moved = np.sqrt(((new - entries) ** 2).sum(axis=1))
        code, near, bound, used = assign(x, new, code, near, shifted(code, near, bound, np.nextafter(moved, np.inf)))
        d = squared(x, new)
        assert np.array_equal(code, d.argmin(axis=1))
        assert (bound[:, 0] >= np.sqrt(d[np.arange(80), code])).all()
        for i in range(b):
            assert (bound[:, 1 + i] <= np.sqrt(d[np.arange(80), near[:, i]]) + 1e-9).all()
        rest = np.ones_like(d, dtype=bool)
        rest[np.arange(80)[:, None], np.column_stack([code, near])] = False
        assert (bound[:, -1] <= np.where(rest, np.sqrt(d), np.inf).min(axis=1)).all()
        assert used.max() <= b + 1
        entries = new


def test_bounds_spare_distances(spark):
    """Well parted groups: after the first round hardly any part needs a distance."""
    rng = np.random.default_rng(0)
    entries = rng.integers(-4000, 4000, (16, 8))
    x = np.repeat(entries, 50, axis=0) + rng.integers(-40, 40, (800, 8))
    code, near, bound = search_all(x, entries, 4)
    moved = entries + rng.integers(-9, 10, (16, 8))
    *_, used = assign(x, moved, code, near, shifted(code, near, bound, np.sqrt(((moved - entries) ** 2).sum(axis=1)) + 1e-9))
    assert (used == 0).mean() > 0.99


NAN, INF = float("nan"), float("inf")


def test_odd_rows(spark):
    good = [(i, [math.sin(i + j) for j in range(8)], "a" if i % 3 else None) for i in range(40)]
    rows = good + [
        (100, None, "a"), (101, [None] * 8, "a"), (102, [NAN] * 8, "b"), (103, [INF, *[0.0] * 7], "b"), (104, [0.5] * 7, "b"),
        (105, [1e30] + [0.0] * 7, "b"), (None, [0.25] * 8, "b"), (7, good[7][1], "b"), (7, [9.0] * 8, None),
    ]
    schema = "vec_id long, embedding array<double>, label string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS code", "2 AS v", "3 AS error", "'x' AS of")
    coded, books = vector_codes(df, parts=4)
    kept = [r for r in rows if r[0] is None or r[0] < 100]
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    first = [min(w for w, r in zip(whole, kept) if r[0] == i) for i in range(16)]
    want, _ = plain(whole, first, 4, 6)
    got = coded.collect()
    assert sorted((str(r["vec_id"]), str(r["label"]), bytes(r["code"]), r["error"]) for r in got) == sorted(
        (str(r[0]), str(r[2]), *w) for r, w in zip(kept, want)
    )
    for name in (None, "a", "b"):
        total = sum(r["error"] for r in got if r["label"] == name)
        assert {r["label_error"] for r in got if r["label"] == name} == {total}
    assert vector_codes(df.where("false"))[0].count() == 0
    for some in (df.where("vec_id IS NULL"), df.where("vec_id = 3"), df.where("vec_id < 5")):
        out, own = vector_codes(some)
        assert out.count() == some.where("embedding IS NOT NULL").count() and len(own) == max(1, some.select("vec_id").distinct().where("vec_id IS NOT NULL").count())
        assert all(r["error"] == 0 for r in out.collect())
    empty = spark.createDataFrame([(1, [], "a"), (2, [], None)], schema)
    assert [bytes(r["code"]) for r in vector_codes(empty)[0].collect()] == [bytes(8)] * 2
