"""Top-k search and language identification."""

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from groupaudit.llm import language, queries
from groupaudit.llm.byte_gru import ByteGRU, letters, windows
from groupaudit.llm.exact_topk import exact_top_k


def brute(rows, k=5, scale=256):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            v = tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)
            ok[i] = max(ok.get(i, v), v)
    out = []
    for q in (i for i in ok if i % 50 == 0):
        s = sorted(((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q))[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def searched(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, score long, id string")
    got = exact_top_k(df, is_query=F.col("vec_id") % 50 == 0, **options).collect()
    return sorted(tuple(r) for r in got)


def test_top_k_matches_sql(spark, sf):
    got = queries.QUERIES["op1_exact_top_k"](spark, sf).toArrow()
    assert compare(got, connect(sf).sql(queries.SQL["op1_exact_top_k"]).to_arrow_table()) == []


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60, "block_rows": 2, "parts": 3}])
def test_top_k_with_ties_bad_and_repeated_vectors(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(300)]
    rows += [(i, rows[1][1]) for i in range(300, 420)]  # one very common vector
    rows += [(50, [9.0] * 6), (500, None), (501, [None, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (504, []), (505, [1.0, 2.0]), (7, rows[7][1])]
    assert searched(spark, rows, **options) == brute(rows)


def test_top_k_of_few_empty_and_huge(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0])]) == []
    rows = [(0, [1e12, 1.0]), (50, [2e12, 3.0]), (3, [1e12, -1.0])]
    end = (1 << 63) - 1  # scores beyond a long are held at its end, and tie there
    assert searched(spark, rows) == [(0, 1, 3, end), (0, 2, 50, end), (50, 1, 0, end), (50, 2, 3, end)]


def test_backpropagation_through_time():
    m = ByteGRU(["a", "b", "c"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(60, 130, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, g = m.gradients(x, y)
    for key in g:
        at = tuple(rng.integers(0, s) for s in m.p[key].shape)
        at = (int(x[1, 2]), at[1]) if key.startswith("E") else at
        loss = []
        for step in (1e-5, -1e-5):
            m.p[key][at] += step
            loss.append(m.gradients(x, y)[0])
            m.p[key][at] -= step
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(g[key][at], abs=1e-6)


def test_windows_cover_a_long_word():
    word = "é" * 100
    assert b"".join(windows(word)) == b" " + word.encode() + b" "
    assert letters(np.frombuffer(b"aZ1 \xc3\xa9@[`{", np.uint8)).tolist() == [True, True, False, False, True, True] + [False] * 4


def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op2_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    words = {"aa": "aba caba daba ", "zz": "zizy xozo vuzu "}
    rows = [(i, words["aa" if i % 2 else "zz"] * 5, "aa" if i % 2 else "zz", "keep", 1.0) for i in range(60)]
    rows += [(100, None, "aa", "k", 1.0), (101, "", None, "k", 1.0), (102, "12 !? --", "zz", "k", 1.0), (None, "aba", None, "k", 1.0)]
    rows += [(103, "abacaba" * 20_000, None, "k", 1.0), (1, rows[1][1], "aa", "keep", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.language_id(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[100]["score"] == 0.0
    assert by[103]["lang_pred"] == "aa" and by[None]["lang_pred"] == "aa" and by[None]["held_out"] is False
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r["lang_pred"] for r in kept.collect()} == {"keep", "k"}
    assert kept.count() == len(rows) - 3
    none = language.language_id(df.where("false"))
    assert none.count() == 0


def test_noise_and_unknown_languages_are_rejected(spark, sf):
    rng = np.random.default_rng(5)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    noise = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(60)) for _ in range(5)]
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική.",
    ]
    planted = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(noise + strange)], "doc_id long, text string")
    kept = {r["doc_id"] for r in language.keep_identified(docs.unionByName(planted, allowMissingColumns=True)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_every_labelled_document_is_counted(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, word(i), "aa") for i in range(900)] + [(1000 + i, "опа", "bb") for i in range(30)]
    model, learned = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["aa", "bb"]
    assert all(learned[word(i)].tolist() == [True, False] for i in range(900)) and learned["опа"].tolist() == [False, True]


def test_the_query_learns_no_triples_and_reads_as_the_network_does(spark, sf, monkeypatch):
    def no_triples(*args):
        raise AssertionError("triples are of no use to the query")

    monkeypatch.setattr(language, "learned_triples", no_triples)
    model = ByteGRU(["a", "b", "c"], seed=3)
    items = [w for word in ("one", "two", "Ünïx", "x" * 70) for w in windows(word)]
    sums, counts = model.pooled(items)
    for s, n, w in zip(sums, counts, items):
        x = np.frombuffer(w, np.uint8)[None, :]
        assert n == letters(x).sum()
        np.testing.assert_allclose(s, model.positions(x)[0][letters(x)[0], 0].sum(axis=0), rtol=1e-4)
    model, learned = language.fit(spark.read.parquet(f"{sf}/documents.parquet").where(~language.held_out("doc_id")).limit(40), rounds=1, with_triples=False)
    assert learned == {} and len(model.labels) > 0


def test_a_full_memory_keeps_the_words_of_several_batches(monkeypatch):
    monkeypatch.setattr(language, "MEMORY_WORDS", 40)
    model = ByteGRU(["a", "b"])
    reader, fresh, asked, pooled = language._Reader(model, {}), language._Reader(model, {}), [], model.pooled
    for n in range(12):
        texts = ["one two three", f"two {' '.join(f'w{n}x{i}' for i in range(10))}", ""]
        want = fresh.read(texts)
        fresh.forget()
        monkeypatch.setattr(model, "pooled", lambda items: asked.extend(items) or pooled(items))
        got = reader.read(texts)
        monkeypatch.setattr(model, "pooled", pooled)
        assert [g[::2] for g in got] == [w[::2] for w in want]
        np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-6)
    assert sorted(asked.count(b" %s " % w) for w in (b"one", b"two", b"three")) == [1, 1, 1] and len(reader.at) <= 40
