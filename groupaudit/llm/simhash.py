"""SimHash near-duplicates with vantage-point trees.

Two fingerprints that differ in at most r of 64 bits differ in at most r // 2 bits of the left or of
the right 32.  Each half has a tree: depth l compares a half with vantage point l and goes inside if
the Hamming distance is at most that depth's radius, the median over all fingerprints.  The path is
the leaf, and a leaf is a shard.

A branch is pruned by the triangle bound: the distances of two near halves to one vantage point
differ by at most r // 2, so a fingerprint has partners across a boundary only if it lies that close
to it.  Such a fingerprint is sent across as a guest; guests meet residents only, so a pair that a
boundary parts meets in one leaf.  Leaves over a fixed size are cut into blocks that meet pairwise.
Every candidate is compared in all 64 bits.  A task returns a spanning forest of its links, never
all pairs of a group; components of the forests are those of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import apart, small_batches, stored
from groupaudit.llm.components import connected_components
from groupaudit.llm.shingle_links import similar_links, sketch

HASH_SEED = 42
LEAF_ROWS, BLOCK_ROWS = 2048, 8192  # fingerprints a leaf is planned for, and compared at once
DEPTH_LIMIT = 26  # leaves of a tree stay far below 2 ** 32 halves


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    norm = b" ".join((text or "").encode("utf-8").lower().split())  # both on ASCII only
    if not norm:
        return []
    space = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = [0, *(space + 1).tolist()], [*space.tolist(), len(norm)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= words:
        return [digest(norm, HASH_SEED)]
    return [digest(norm[a:b], HASH_SEED) for a, b in zip(starts, ends[words - 1 :])]


def distinct_hashes(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits as a signed long: a bit is 1 if set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        h = np.array(hashes[lo : lo + 4096], dtype=">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, words: int = 3, similar_words: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row, and with ``similar_words`` the size n and sketch of its set of such shingles; no shuffle."""
    small_batches(docs.sparkSession)
    more = ", n int, sketch array<long>" if similar_words else ""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([text_fingerprint(t, words) for t in pdf["text"]], np.int64)})
            if similar_words:
                sets = [distinct_hashes(t, similar_words) for t in pdf["text"]]
                out["n"], out["sketch"] = np.array([len(h) for h in sets], np.int32), [sketch(h) for h in sets]
            yield out

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(work, "doc_id string, fp long" + more).withColumn("doc_id", F.col("doc_id").cast("long"))


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text column as 16 hex digits."""

    def work(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{text_fingerprint(t, words) & (1 << 64) - 1:016x}" for t in texts], dtype=object)

    return F.pandas_udf(work, "string").asNondeterministic()(text)


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    v = fp.view(np.uint64)
    return [(v >> np.uint64(32)).astype(np.uint32), (v & np.uint64(0xFFFFFFFF)).astype(np.uint32)]


def vantage_points(depth: int) -> np.ndarray:
    """Two rows (left and right half) of one 32-bit point a depth."""
    return np.array([[xxhash.xxh32_intdigest(f"{h}/{d}") for d in range(depth)] for h in (0, 1)], dtype=np.uint32)


def _radii(nodes: DataFrame, points: np.ndarray) -> np.ndarray:
    """Median distance to every vantage point, from exact counts of the 33 possible distances."""
    depth = points.shape[1]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, depth, 33), dtype=np.int64)
        for pdf in batches:
            for h, half in enumerate(_halves(pdf["fp"].to_numpy())):
                for d in range(depth):
                    total[h, d] += np.bincount(np.bitwise_count(half ^ points[h, d]), minlength=33)
        at = np.argwhere(total)
        yield pd.DataFrame({"h": at[:, 0], "d": at[:, 1], "far": at[:, 2], "n": total[tuple(at.T)]})

    rows = nodes.select("fp").mapInPandas(work, "h int, d int, far int, n long").groupBy("h", "d", "far").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, depth, 33))
    for r in rows.collect():  # at most 2 * depth * 33
        counts[r["h"], r["d"], r["far"]] = r["n"]
    share = counts.cumsum(axis=2) / np.maximum(1, counts.sum(axis=2, keepdims=True))
    return np.abs(share - 0.5).argmin(axis=2)


def leaf_rows(nodes: DataFrame, n: int, distance: int, leaf: int = LEAF_ROWS) -> DataFrame:
    """(half, leaf, fp, home): every fingerprint at home in one leaf of each tree, and its guest rows."""
    depth = int(min(DEPTH_LIMIT, max(0, np.ceil(np.log2(max(1, n) / leaf)))))
    points, near = vantage_points(depth), distance // 2
    radii = _radii(nodes, points) if depth else np.zeros((2, 0), dtype=int)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for h, half in enumerate(_halves(fp)):
                at, code, guest = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), bool)
                for d in range(depth):
                    far = np.bitwise_count(half ^ points[h, d]).astype(int)[at]
                    outside, r = far > radii[h, d], radii[h, d]
                    # who is at home inside may be sent out; a guest follows every bound it is near to
                    cross = np.where(outside, guest & (far <= r + near), far > r - near)
                    bit = np.int64(1) << d
                    code = np.concatenate([np.where(outside, code | bit, code), np.where(outside, code, code | bit)[cross]])
                    at, guest = np.concatenate([at, at[cross]]), np.concatenate([guest, np.ones(cross.sum(), bool)])
                yield pd.DataFrame({"half": np.full(len(at), h, np.int32), "leaf": code, "fp": fp[at], "home": ~guest})

    return nodes.select("fp").mapInPandas(work, "half int, leaf long, fp long, home boolean")


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position reachable from each of n positions."""
    root = np.arange(n)
    for x, y in pairs:
        while len(x):
            a, b = root[x], root[y]
            open_ = a != b
            if not open_.any():
                break
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def near_links(nodes: DataFrame, *, distance: int = 3, leaf: int = LEAF_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs at ``distance`` or fewer differing bits.

    ``nodes`` has distinct fingerprints in column fp.
    """
    n = nodes.count()
    rows = stored(leaf_rows(nodes, n, distance, leaf), "leaves")
    sizes = rows.groupBy("half", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meet = (
        rows.join(sizes, ["half", "leaf"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("half", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "home")
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.sort_values("own", kind="stable")
        fp, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        n_left = int((pdf["own"] == i).sum()) if i != j else len(fp)
        first = n_left if i != j else 0

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            right, right_home = fp[first:], home[first:]
            for lo in range(0, n_left, 128):
                hi = min(n_left, lo + 128)
                skip = lo if i == j else 0
                near = np.bitwise_count(fp[lo:hi, None] ^ right[None, skip:]) <= distance
                x, y = np.nonzero(near)
                x, y = x + lo, y + skip
                keep = (home[x] | right_home[y]) & (x != y + first)
                yield x[keep], y[keep] + first

        root = _forest(len(fp), pairs())
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[moved].view(np.int64), "v": fp[root[moved]].view(np.int64)})

    return meet.groupBy("half", "leaf", "i", "j").applyInPandas(link, "u long, v long")


def simhash_components(
    docs: DataFrame,
    *,
    words: int = 3,
    distance: int = 3,
    similar_words: int = 0,
    similarity: float = 0.8,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row (doc_id, fingerprint, component_id, group) per input row.

    With ``similar_words`` documents are also linked if their sets of shingles of so many words have a
    similarity of at least ``similarity`` (see ``shingle_links``).

    ``component_id`` is the smallest doc_id reachable over links, ``group`` names the component
    itself (its smallest fingerprint).  Null and wordless texts have fingerprint zero and are linked
    like any other.  Rows without an id take part but never give a component its id: a component of
    such rows only has component_id null.  Rows that repeat an id are documents of their own.  Other
    columns are ignored; an empty table gives no row.
    """
    fps = stored(fingerprints(docs, words=words, similar_words=similar_words, doc_id=doc_id, text=text), "fingerprints")
    shape = [F.min_by(c, "doc_id").alias(c) for c in ("n", "sketch") if similar_words]
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *shape), "nodes")
    roots = stored(connected_components(near_links(nodes, distance=distance)), "roots")
    placed = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        *nodes.columns, F.coalesce("root", "fp").alias("group")
    )
    if similar_words:
        placed = stored(placed, "placed")
        links = similar_links(
            docs, placed, similarity=similarity, hashes_of=lambda t: distinct_hashes(t, similar_words),
            fingerprint_of=lambda t: text_fingerprint(t, words), doc_id=doc_id, text=text,
        )
        joined = stored(connected_components(links), "roots").select(F.col("node").alias("group"), "root")
        placed = placed.join(joined, "group", "left").select("fp", "first_id", F.coalesce("root", "group").alias("group"))
    ids = placed.groupBy("group").agg(F.min("first_id").alias("component_id"))
    by_fp = placed.join(ids, "group").select("fp", "group", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group"
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, **options: float) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows that repeat that id, or where no row of a component has an id, the one with the smallest
    text stays.  All columns are kept, whatever their names; null and empty texts are one component,
    and an empty table stays empty.
    """
    names, own = docs.columns, apart("_id", docs.columns)
    found = stored(simhash_components(docs, doc_id=doc_id, text=text, words=words, **options), "components")
    per_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first")
    )
    firsts = stored(per_id.where("first").select(F.col("doc_id").alias(own), "n"), "firsts")
    ours = F.col(f"`{doc_id}`").cast("long")
    # the list of ids grows with the documents, so that it is merged, never sent out, at any size
    plain = docs.join(firsts.where("n = 1").hint("merge"), ours == F.col(own), "left_semi")
    # ids on several rows, and rows without one, are told apart by their fingerprints
    odd = docs.join(firsts.where("n > 1"), ours == F.col(own), "left_semi").union(docs.where(ours.isNull()))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    odd = odd.select(row.alias("row"), ours.alias("_id"), F.col(f"`{text}`").alias("_t"), fingerprint_column(F.col(f"`{text}`"), words).alias("fingerprint"))
    where = found.select("fingerprint", "group", "component_id").distinct()
    best = odd.join(where, "fingerprint").where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(
        F.min_by("row", F.struct("_t", F.xxhash64("row"))).alias("row")
    )
    return plain.union(best.select("row.*"))
