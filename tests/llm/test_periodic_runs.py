"""Periodic runs against a plain search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groupaudit.llm import queries
from groupaudit.llm.periodic_runs import PRIME, find_runs, periodic_runs, recurrences, text_runs, transform

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every maximal stretch of every period, kept if no smaller period spans it."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(s <= i and i + length <= s + k and p < q and q % p == 0 for s, k, p in found)
            if length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(words, **limits):
    return [tuple(r) for r in find_runs(np.array(words, dtype=np.int64), np.array([len(words)]), **limits).tolist()]


PIECES = st.lists(
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=8
).map(lambda ps: [x for p, k in ps for x in p * k])


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_runs_of_small_texts(words):
    assert runs_of(words) == brute(words)
    assert runs_of(words, most_block=2) == brute(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(PIECES, max_size=6))
def test_texts_do_not_meet(texts):
    got = text_runs([" ".join(map(str, t)).encode() for t in texts])
    assert [[tuple(r) for r in runs.tolist()] for _, runs in got] == [brute(t) for t in texts]


@pytest.mark.parametrize("size", [2, 64, 128, 256, 4096, 16384])
def test_transform_is_exact_and_invertible(size):
    x = np.random.default_rng(size).integers(0, PRIME, (2, size)).astype(float)
    y = transform(x.copy())
    root = pow(3, (PRIME - 1) // size, PRIME)
    k = (size // 2 + 1) % size
    assert int(y[0, k]) % PRIME == sum(int(v) * pow(root, k * i, PRIME) for i, v in enumerate(x[0].astype(int))) % PRIME
    assert np.array_equal(transform(y, inverse=True) % PRIME, x * size % PRIME)


@pytest.mark.parametrize("block,away", [(1, 1), (4, 1), (4, 3), (64, 1), (128, 1), (256, 2)])
def test_recurrences_are_the_equal_windows(block, away):
    rng = np.random.default_rng(block + away)
    words = np.concatenate([rng.integers(0, 3, 40), np.tile(rng.integers(0, 900, block + block // 2), 9), rng.integers(0, 2, 30)])
    want = [
        j * block + i
        for j in range(len(words) // block)
        for i in range(block)
        if (at := (j + away) * block + i) + block <= len(words) and np.array_equal(words[j * block : (j + 1) * block], words[at : at + block])
    ]
    assert recurrences(words, block, away).tolist() == want


def test_numbers_beyond_the_modulus_do_not_deceive():
    words = np.arange(40_000)
    words[20_000:] = 7 * np.arange(20_000) % 4_999  # period 4,999, four times
    assert runs_of(words) == [(20_000, 20_000, 4_999)]
    assert runs_of([0] * 30_000) == [(0, 30_000, 1)]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_periodic_runs"](spark, sf).select(*COLUMNS).collect()
    small = {d for d, t in docs if len(t or "") < 8_000}
    assert len(small) > 100
    want = [expected(d, t) for d, t in docs if d in small]
    assert sorted(tuple(r) for r in got if r["doc_id"] in small) == sorted(want)
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got) > 5


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "a a a a a a", 0), (4, "a b " * 40_000, 1), (4, "a b " * 40_000, 1),
        (5, "ä b   \x1c c " * 6, 2), (6, "x" * 300_000, 3),
    ] + [(i, f"w{i} " * 9 + "end", 0) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()
    short = [r for r in rows if r[0] != 4]
    assert sorted((tuple(r) for r in got if r["doc_id"] != 4), key=repr) == sorted((expected(d, t) for d, t, _ in short), key=repr)
    assert sum(r["doc_id"] == 4 for r in got) == 2
    plain = {r["doc_id"]: r for r in periodic_runs(df).collect()}
    assert plain[4]["collapsed"] == "a b" and [tuple(r) for r in plain[4]["runs"]] == [(0, 80_000, 2)]
    assert plain[1]["runs"] == [] and plain[1]["collapsed"] == ""
    assert periodic_runs(df.where("false")).count() == 0
