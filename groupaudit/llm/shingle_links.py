"""Links between components whose documents share most of their word shingles.

Fingerprints at a small Hamming distance miss most pairs that are only just similar.  The rest is found by
the smallest hashes of the shingle sets: two sets of similarity s share a share of about s of these.

A node (the documents of one fingerprint) is posted under its ``KEYS`` smallest hashes together with its
``SKETCH`` smallest.  Nodes of one list whose sizes and sketches allow the similarity and which are not in one
component yet are candidates, and every candidate is verified on the whole sets.  Short lists are joined.  Long
ones are cut into blocks of nodes of like size, which meet pairwise and are compared by their ``WIDE`` smallest hashes, so that
hardly a candidate fails.  First a task returns a spanning forest of its best candidates, of blocks with themselves and,
once verified links have joined these, of all blocks: a large group leaves about one candidate a task.  Then it
returns, for every node, the best candidates in other components, four times as many in every round, until none was left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.llm.common import small_batches, stored
from groupaudit.llm.components import connected_components

KEYS, SKETCH = 4, 16  # at similarity 0.8 two nodes share no key in one of 600 cases
LEAST_EIGHTHS = 3  # share of the sketch, in eighths, that candidates have in common: 6 of 16
WIDE, SLACK = 512, 3.5  # the wide sketch, and standard deviations by which its estimate may fall short: one of 4,000
CODES = 8192  # hashes of a block pair that are counted at once
LIST_ROWS, BLOCK_ROWS = 64, 512  # nodes of a list that is joined; nodes of a block of a longer one


def sketch(hashes: np.ndarray) -> list[int]:
    """The smallest of distinct hashes, ascending, as signed longs."""
    return hashes[:SKETCH].view(np.int64).tolist()


def wide_sketch(hashes: np.ndarray) -> bytes:
    """The leading 32 bits of the ``WIDE`` smallest of distinct hashes, ascending."""
    return (hashes[:WIDE] >> np.uint64(32)).astype("<u4").tobytes()


def _fits(n: Column, m: Column, shared: Column, similarity: float) -> Column:
    alike = F.least(n, m) >= F.greatest(n, m) * similarity
    return alike & (shared * 8 >= F.least(n, m, F.lit(SKETCH)) * LEAST_EIGHTHS)


def _meetings(rows: DataFrame, similarity: float, alone: bool) -> DataFrame:
    """Rows of long lists, once for every pair of blocks that they belong to; ``alone``: blocks with themselves.

    Lists over one block are first cut by classes of size: similar sets are in one class or in neighbours.
    """
    step = max(1e-6, -math.log(similarity) * 1.0001)
    classed = rows.withColumn("cls", F.when(F.col("rows") > BLOCK_ROWS, F.floor(F.log("n") / step)).otherwise(0).cast("int"))
    sizes = classed.groupBy("token", "cls").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    near = Window.partitionBy("token").orderBy("cls").rangeBetween  # a row per class
    sizes = sizes.select("*", F.sum("blocks").over(near(-1, -1)).alias("down"), F.sum("blocks").over(near(1, 1)).alias("up"))
    placed = classed.join(sizes, ["token", "cls"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    numbers = lambda n: F.filter(F.sequence(F.lit(-1), F.coalesce(F.col(n), F.lit(0)).cast("int") - 1), lambda b: b >= 0)
    own, cls = F.col("own"), F.col("cls")
    key = lambda ci, i, cj, j: F.struct(ci.alias("ci"), i.alias("i"), cj.alias("cj"), j.alias("j"))
    keys = F.array(key(cls, own, cls, own))
    if not alone:
        keys = F.concat(
            F.transform(numbers("blocks"), lambda b: key(cls, F.least(own, b), cls, F.greatest(own, b))),
            F.transform(numbers("up"), lambda b: key(cls, own, cls + 1, b)),
            F.transform(numbers("down"), lambda b: key(cls - 1, b, cls, own)),
        )
    return placed.select("token", F.explode(keys).alias("key"), "cls", "own", "fp", "group", "n", "wide").select("token", "key.*", "cls", "own", "fp", "group", "n", "wide")


def _likeness(n: np.ndarray, wide: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Estimated similarity of every left and right set, 0 where it is surely too small.

    Up to the lesser of two sketches' last hashes both are whole, so that these hashes sample the union.
    """
    sizes = np.array([len(w) for w in wide])
    value, code, times = np.unique(np.concatenate(wide), return_inverse=True, return_counts=True)
    node, common = np.repeat(np.arange(len(n)), sizes), times > 1
    at = np.cumsum(common) - 1
    node, code = node[common[code]], at[code[common[code]]]
    shared = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(common.sum()), CODES):
        part = (code >= lo) & (code < lo + CODES)
        has = np.zeros((len(n), min(CODES, int(common.sum()) - lo)), np.float32)
        has[node[part], code[part] - lo] = 1
        shared += has[left] @ has[right].T
    last = np.array([w[-1] if m > len(w) else 1 << 32 for m, w in zip(n, wide)], np.int64)
    below = lambda rows, columns: np.array([np.searchsorted(wide[r], np.minimum(last[r], last[columns]), "right") for r in rows])
    union = below(left, right) + below(right, left).T - shared
    whole = np.maximum.outer(n[left], n[right]) <= WIDE
    slack = np.where(whole, 1e-3, SLACK * np.sqrt(union * similarity * (1 - similarity)) + 1)
    low, high = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    return np.where((low >= high * similarity) & (shared + slack >= similarity * union), shared / np.maximum(1, union), 0)


def _long_lists(rows: DataFrame, similarity: float, best: int, alone: bool = False) -> DataFrame:
    """(u, v, cut): a forest of candidates, or with ``best`` so many of every node; cut if it has more."""
    meet = _meetings(rows, similarity, alone)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [(pdf["cls"] == pdf[c].iloc[0]) & (pdf["own"] == pdf[i].iloc[0]) for c, i in (("ci", "i"), ("cj", "j"))]
        left, right = (e.to_numpy().nonzero()[0] for e in ends)
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": [], "cut": []}).astype({"u": "int64", "v": "int64", "cut": bool})
        fp, n, wide = pdf["fp"].to_numpy(), pdf["n"].to_numpy(np.int64), [np.frombuffer(w, "<u4") for w in pdf["wide"]]
        root = pd.Series(np.arange(len(fp))).groupby(pdf["group"].to_numpy()).transform("min").to_numpy().copy()
        alike = _likeness(n, wide, left, right, similarity)
        alike[root[left][:, None] == root[right]] = 0
        if best:
            ends = [_best_partners(alike, best, left, right), _best_partners(alike.T, best, right, left)]
            x, y, cut = (np.concatenate(c) for c in zip(*ends))
            return pd.DataFrame({"u": fp[x], "v": fp[y], "cut": cut})
        found = []
        level = np.ceil(alike * 64).astype(np.int8)
        for at in np.unique(level[level > 0])[::-1]:
            x, y = np.nonzero(level == at)
            x, y = left[x], right[y]
            while (open_ := root[x] != root[y]).any():
                x, y = x[open_], y[open_]
                found.append((fp[x[0]], fp[y[0]]))
                root[root == root[y[0]]] = root[x[0]]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1], "cut": np.ones(len(pairs), bool)})

    found = meet.groupBy("token", "ci", "i", "cj", "j").applyInPandas(compare, "u long, v long, cut boolean")
    return found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.bool_or("cut").alias("cut"))


def _best_partners(shared: np.ndarray, best: int, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, column and cut flag of the ``best`` greatest entries above zero of each row."""
    order = np.argsort(-shared, axis=1, kind="stable")[:, :best]
    x, at = np.nonzero(np.take_along_axis(shared, order, axis=1))
    return rows[x], columns[order[x, at]], ((shared > 0).sum(axis=1) > best)[x]


def posted(nodes: DataFrame) -> DataFrame:
    """(token, fp, group, n, sketch, rows) of the lists with more than one group; ``rows`` is the list's length."""
    posts = stored(nodes.select("fp", "group", "n", "sketch", F.explode(F.slice("sketch", 1, KEYS)).alias("token")), "posts")
    lists = posts.groupBy("token").agg(F.count("*").alias("rows"), (F.min("group") < F.max("group")).alias("open"))
    return stored(posts.join(lists.where("open").drop("open"), "token"), "lists")


def _short_lists(rows: DataFrame, similarity: float) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    shared = F.size(F.array_intersect("a.sketch", "b.sketch"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.group") != F.col("b.group")))
    pairs = pairs.where(_fits(F.col("a.n"), F.col("b.n"), shared, similarity))
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, *, similarity: float) -> DataFrame:
    """The pairs whose whole sets (fp, hashes) have a Jaccard similarity of at least ``similarity``."""
    left, right = (sets.select(F.col("fp").alias(e), F.col("hashes").alias(f"set_{e}")) for e in ("u", "v"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    share = both / (F.size("set_u") + F.size("set_v") - both)
    return pairs.join(left, "u").join(right, "v").where(share >= similarity).select("u", "v")


def similar_links(
    docs: DataFrame, nodes: DataFrame, *, similarity: float, hashes_of, fingerprint_of, doc_id: str, text: str
) -> DataFrame:
    """Edges (u, v) of groups.

    ``nodes``: fp, first_id, group, n, sketch.  ``hashes_of`` and ``fingerprint_of`` give a text's distinct
    sorted shingle hashes and its fingerprint.  A node without an id takes no part.
    """
    small_batches(docs.sparkSession)
    known = nodes.where("first_id IS NOT NULL")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_doc"), F.col(f"`{text}`").alias("_text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # rows that repeat an id have fingerprints of their own
            hashes = [(fp, hashes_of(t)) for fp, t in zip(pdf["_fp"], pdf["_text"]) if fingerprint_of(t) == fp]
            rows = [(fp, h.view(np.int64), wide_sketch(h)) for fp, h in hashes]
            yield pd.DataFrame(rows, columns=["fp", "hashes", "wide"])

    of = known.select("fp", "group")

    def tested(pairs: DataFrame) -> DataFrame:
        links = verified(pairs, sets, similarity=similarity)
        links = links.join(of.toDF("u", "group_u"), "u").join(of.toDF("v", "group_v"), "v")
        return stored(links.select(F.col("group_u").alias("u"), F.col("group_v").alias("v")), "links")

    rows = posted(known)
    long = rows.where(F.col("rows") > LIST_ROWS)
    seen = stored(_short_lists(rows.where(F.col("rows") <= LIST_ROWS), similarity), "candidates")
    # the texts are read once for all rounds
    ends = seen.select(F.col("u").alias("fp")).union(seen.select("v")).union(long.select("fp")).distinct()
    wanted = known.join(ends, "fp").select(F.col("first_id").alias("_wanted"), F.col("fp").alias("_fp"))
    read = texts.join(wanted, F.col("_doc") == F.col("_wanted")).select("_fp", "_text")
    schema = "fp long, hashes array<long>, wide binary"
    sets = read.mapInPandas(work, schema).groupBy("fp").agg(F.first("hashes").alias("hashes"), F.first("wide").alias("wide"))
    sets = stored(sets, "sets")
    if long.isEmpty():
        return tested(seen)
    long = stored(long.drop("sketch").join(sets.select("fp", "wide"), "fp"), "long")
    links, best, alone = tested(seen), 0, True
    while True:
        joined = stored(connected_components(links), "roots").select(F.col("node").alias("group"), "root")
        now = long.join(joined, "group", "left").withColumn("group", F.coalesce("root", "group")).drop("root")
        found = stored(_long_lists(now, similarity, best, alone), "candidates")
        fresh = stored(found.select("u", "v").join(seen, ["u", "v"], "left_anti"), "candidates")
        if not fresh.isEmpty():
            links, seen = links.union(tested(fresh)), seen.union(fresh)
        if best and found.where("cut").isEmpty():
            return links
        best, alone = (0 if alone else 4 * max(1, best)), False
