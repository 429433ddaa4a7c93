"""SimHash components, against brute force."""

import re

import numpy as np
import pytest
import xxhash

from groupaudit.llm import queries, shingle_links, simhash
from groupaudit.llm.components import connected_components


def brute_components(fp, distance=3):
    a, root = np.array(fp, np.int64).view(np.uint64), list(range(len(fp)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= distance):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_matches_brute_force(spark, sf):
    got = sorted(queries.QUERIES["op3_simhash_components"](spark, sf).collect())
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fp = [brute_fingerprint(d["text"]) for d in docs]
    assert [r["fingerprint"] for r in got] == [f"{x:016x}" for x in fp]
    assert [r["component_id"] for r in got] == [docs[i]["doc_id"] for i in brute_components([signed(x) for x in fp])]


@pytest.mark.parametrize("options", [{"leaf": 32}, {"leaf": 256, "block": 100}, {}])
def test_trees_lose_no_link(spark, options):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 1500, dtype=np.int64)
    near = [base]
    for bits in range(1, 5):
        x = base[:300].copy()
        for _ in range(bits):
            x ^= np.int64(1) << rng.integers(0, 63, 300)
        near.append(x)
    x = base[:1].repeat(400)  # one large group of near copies
    near.append(x ^ (np.int64(1) << rng.integers(0, 63, 400)) ^ (np.int64(1) << rng.integers(0, 63, 400)))
    fp = np.unique(np.concatenate(near))
    nodes = spark.createDataFrame([(int(v),) for v in fp], "fp long")
    links = simhash.near_links(nodes, **options)
    assert links.count() < 2 * 2 * len(fp)  # a forest a task, no pairs of a group
    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert [root.get(int(v), int(v)) for v in fp] == [int(fp[i]) for i in brute_components(fp)]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    rows = [
        (1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "q w e r t y", "n"), (None, "q w e r t y", "m"),
        (2, "A b  c\td e", "z"), (3, None, "z"), (4, "", "z"), (1, "zz yy xx ww vv", "k"), (9, "long word " * 30_000, "l"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (9, 9)]
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)} == {"0" * 16}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept.collect()) == [(0, "q w e"), (1, "a b c"), (1, "zz yy"), (3, ""), (9, "long ")]
    assert simhash.simhash_components(df.where("false")).count() == 0 and simhash.keep_one(df.where("false")).count() == 0


def similar_sets(texts):
    words = [re.findall("[^\x20\x09-\x0d]+", t.lower()) for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


@pytest.mark.parametrize("short", [64, 2])  # lists that are joined, lists in blocks
def test_similar_documents_are_one_component(spark, monkeypatch, short):
    monkeypatch.setattr(shingle_links, "LIST_ROWS", short)
    monkeypatch.setattr(shingle_links, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, texts = word(60), []
    for k in range(40):
        base = word(int(rng.integers(20, 400)))
        texts.append(base)
        for edits in range(1, 5):  # some of these fall below the similarity
            w = list(base)
            for at in rng.integers(0, len(w), max(1, edits * len(w) // 150)):
                w[at] = "edited"
            texts.append(w)
    texts += [word(150) + passage + word(150) for _ in range(30)]  # a shared passage is no near copy
    texts += [[], ["one"], ["one", "two"], ["ONE"]]
    texts = [" ".join(t) for t in texts]
    sets, fp = similar_sets(texts), [signed(brute_fingerprint(t)) for t in texts]
    root = brute_components(fp)

    def join(x, y):
        a, b = sorted((root[x], root[y]))
        root[:] = [a if r == b else r for r in root]

    for x in range(len(texts)):
        for y in range(x):
            if sets[x] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                join(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(df, similar_words=5).collect()}
    assert [got[i] for i in range(len(texts))] == root
    plain = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(df).collect()}
    assert len(set(got.values())) < len(set(plain.values())) and len({got[i] for i in range(200, 230)}) == 30


def test_similar_links_of_odd_rows(spark):
    a = " ".join(f"v{i}" for i in range(100))
    rows = [(1, a, 0), (2, a.replace("v99", "x"), 1), (None, a.replace("v0 ", "y "), 2), (1, "other words of the same id", 3), (3, None, 4), (4, " ", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    kept = simhash.keep_one(df, similar_words=5)
    assert kept.columns == df.columns
    assert {r["_text"] for r in kept.collect()} >= {0, 3, 4} and 1 not in {r["_text"] for r in kept.collect()}
    assert simhash.keep_one(df.where("false"), similar_words=5).count() == 0


def test_long_lists_of_unlike_documents_give_no_candidates(spark, monkeypatch):
    """A family whose sets share 0.6 to 0.75 has many pairs, none of which is to be listed."""
    monkeypatch.setattr(shingle_links, "LIST_ROWS", 8)
    made, kept = [], shingle_links.stored
    monkeypatch.setattr(shingle_links, "stored", lambda df, name: (out := kept(df, name), made.append((name, out.count())))[0])
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(200):
        rows.append((i, " ".join(base + [f"d{x}" for x in rng.integers(0, 10**9, 10)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(df, similar_words=5).collect()}
    sets, fp = similar_sets([t for _, t in rows]), [signed(brute_fingerprint(t)) for _, t in rows]
    assert max(len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]) < 0.8
    assert [got[i] for i in range(200)] == brute_components(fp)
    assert max(n for name, n in made if name == "candidates") < 400
