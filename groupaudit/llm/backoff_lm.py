"""Stupid-backoff scores of documents under the corpus's own n-gram model.

An n-gram counts as seen if it occurs ``least`` times: one occurrence in the corpus is the scored one.
A word scores count(n-gram) / count(n-gram without the word) for the longest n-gram that is seen, times
``alpha`` for every step down from ``order``; the last step is count(word) / words of the corpus.

Documents are dealt into blocks of bounded size.  A block asks once for each of its distinct n-grams:
their 64-bit hashes, sorted, go to the parts of the hash range, which add up the blocks' counts and answer
in the order of the question, so that neither documents nor hashes travel back.  Log scores are whole
millionths, so that sums do not depend on their order.

All documents count and all are scored: tables and shuffles grow with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.session import ship_package

MILLION = 1_000_000
BLOCK_WORDS, PART_WORDS, LEAST_PARTS = 1_000_000, 2_000_000, 16  # words of a block, and of the corpus for each part of the hashes


def words(text: Column) -> Column:
    """Lower-cased runs without ASCII white space; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\x0B]+", -1)
    return F.filter(parts, lambda w: w != "")


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: the zeros of small numbers lie together for the compression of shuffles."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _whole(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, which maps 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(block: pa.Table, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of each word's place in its document, and for k up to ``order`` the hash of the k words that end at each such place.

    Hashes of length k are of the words whose place is k - 1 or more.
    """
    lists = block["h"].combine_chunks()
    h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    grams, last = [h], h
    for k in range(2, order + 1):
        whole = np.zeros_like(h)
        whole[1:] = _mixed(_mixed(last[:-1] + np.uint64(k)) + h[1:])
        last = whole
        grams.append(whole[place >= k - 1])
    return place, grams


def _asked(block: pa.Table, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Places as of ``_grams``; for each length the distinct hashes in order, where each word's is among them, and how often each occurs."""
    place, grams = _grams(block, order)
    return place, [np.unique(g, return_inverse=True, return_counts=True) for g in grams]


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the hashes ends."""
    edges = [(i << 64) // parts for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, np.uint64)), [len(hashes)]])


def backoff_scores(
    docs: DataFrame, *, order: int = 2, alpha: float = 0.4, least: int = 2, doc_id: str = "doc_id", text: str = "text",
    block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS,
) -> DataFrame:
    """One row (doc_id, n_words, log_score) per doc_id; log_score is the sum in millionths.

    A word is scored by the longest n-gram of at most ``order`` words that ends with it and is seen;
    every shorter length costs a factor ``alpha``, also where the document has no longer one.
    Rows that repeat an id, and rows without one, are one document each (id null for the latter).
    Null and wordless texts have 0 words and score 0.  Other columns are ignored.
    N-grams are told apart by 64-bit hashes.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    ship_package(docs.sparkSession)
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = given.agg(F.coalesce(F.sum(F.size(words(F.col("text")))), F.lit(0))).first()[0]
    blocks, parts = -(-total // block_words) or 1, max(LEAST_PARTS, -(-total // part_words))
    step = round(math.log(alpha) * MILLION)
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    # texts are dealt, and hashed where they arrive: they are shorter than the hashes of their words
    dealt = given.withColumn("block", number).repartition(blocks, "block")
    hashed = dealt.select("block", "doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))

    def ask(block: pa.Table) -> pa.Table:
        rows = []
        for k, (hashes, _, n) in enumerate(_asked(block, order)[1]):
            cuts = _cuts(hashes, parts)
            for part, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if lo < hi:
                    steps = np.diff(hashes[lo:hi], prepend=np.uint64(0))
                    rows.append((block["block"][0].as_py(), k, part, _planes(steps), _planes(n[lo:hi].astype(np.uint32))))
        return pa.table(dict(zip(asked.names, map(list, zip(*rows)))) if rows else {c: [] for c in asked.names}, asked)

    def answer(part: pa.Table) -> pa.Table:
        """Counts of all blocks added up, for each block in the order of its hashes; 0 for whole n-grams that are not seen."""
        steps = [_whole(raw, np.uint64) for raw in part["hashes"].to_pylist()]
        n = np.concatenate([_whole(raw, np.uint32) for raw in part["n"].to_pylist()])
        _, at = np.unique(np.concatenate([np.cumsum(s) for s in steps]), return_inverse=True)
        found = np.bincount(at, weights=n).astype(np.int64)[at]  # whole numbers below 2 ** 53 are exact
        if part["k"][0].as_py() == order - 1:
            found[found < least] = 0
        ends = np.cumsum([len(s) for s in steps])
        blobs = [_planes(found[hi - len(s) : hi]) for s, hi in zip(steps, ends.tolist())]
        return pa.table({"block": part["block"], "k": part["k"], "part": part["part"], "n": blobs}, answered)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):
            return block.schema.empty_table().select(["doc_id"]).append_column("k", pa.array([], pa.int64())).append_column("s", pa.array([], pa.int64()))
        place, own = _asked(block, order)
        told = sorted(zip(answers["k"].to_pylist(), answers["part"].to_pylist(), answers["n"].to_pylist()))
        counts = []
        for k, (_, at, _) in enumerate(own):
            found = [_whole(n, np.int64) for j, _, n in told if j == k]
            count = np.zeros(len(place), np.int64)
            count[place >= k] = np.concatenate(found)[at] if found else 0
            counts.append(count)
        s = np.zeros(len(place), np.int64)
        if len(place):
            s = np.rint(np.log(counts[0] / float(max(1, total))) * MILLION).astype(np.int64) + (order - 1) * step
        for k in range(2, order + 1):
            seen = np.flatnonzero((place >= k - 1) & (counts[k - 1] >= least))
            s[seen] = np.rint(np.log(counts[k - 1][seen] / counts[k - 2][seen - 1]) * MILLION).astype(np.int64) + (order - k) * step
        size = block["h"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        end, upto = np.cumsum(size), np.concatenate([[0], np.cumsum(s)])
        return pa.table({"doc_id": block["doc_id"], "k": size, "s": upto[end] - upto[end - size]})

    asked = pa.schema([("block", pa.int32()), ("k", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("n", pa.binary())])
    answered = pa.schema([("block", pa.int32()), ("k", pa.int32()), ("part", pa.int32()), ("n", pa.binary())])
    questions = hashed.groupBy("block").applyInArrow(ask, "block int, k int, part int, hashes binary, n binary")
    answers = questions.groupBy("k", "part").applyInArrow(answer, "block int, k int, part int, n binary")
    scored = hashed.groupBy("block").cogroup(answers.groupBy("block"))
    each = scored.applyInArrow(score, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, k long, s long")
    return each.groupBy("doc_id").agg(F.sum("k").cast("long").alias("n_words"), F.sum("s").alias("log_score"))
