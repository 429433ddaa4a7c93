"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Items are cut into entries of at most ``entry_words`` words.  A posting's impact is its BM25 weight
over the entry's score against itself, so that 1 is a full match and one threshold serves all
entries.  Passages are windows of five such lengths over whole documents that overlap by one, so that
any run of an entry's length lies in a passage; each distinct word of a passage is a query term.  For a passage,

1. the largest impacts of its terms are added up: below the threshold it can match no entry;
2. the largest impacts in each block of entries are added up: blocks below it are skipped;
3. the remaining blocks' postings are scored in full, and every entry at the threshold is retrieved.

Retrieved items are verified against the document by runs of five words.  Where question and answer
are given, both must be there.  Where the last sentence only stands for an answer, the runs of the
whole item are enough, and so are the question's alone if it is the longer part and has ``ALONE`` words.
The index is built by joins and goes out in shards of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import apart, small_batches, stored

K1, B = 1.2, 0.75
BLOCK = 16  # entries of a block
PASSAGE = 5  # words of a passage, in entry lengths
ALONE = 13  # words of a text that is evidence by itself; fewer are met by chance
SHARD_WORDS = 2_000_000  # words of the items of one shard, the size bound of what is broadcast
HITS = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>>"
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence answers what stands before it; a single sentence is both."""
    parts = [p for p in _SENTENCE.split(text.strip()) if _WORD.search(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def runs(ws: Sequence[str], n: int) -> set[tuple[str, ...]]:
    """Runs of n words, or the whole sequence if it is shorter."""
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the given half-open ranges, one after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """Postings of one shard in term order; within a term in entry order, block by block."""

    def __init__(self, postings: pd.DataFrame, items: pd.DataFrame, shingle: int):
        entries = postings[["row", "seg"]].drop_duplicates().sort_values(["row", "seg"])
        number = {k: i for i, k in enumerate(entries.itertuples(index=False, name=None))}
        p = postings.assign(entry=[number[k] for k in zip(postings["row"], postings["seg"])]).sort_values(["term", "entry"])
        self.entry, self.impact = p["entry"].to_numpy(np.int64), p["impact"].to_numpy(np.float64)
        terms, start = np.unique(p["term"].to_numpy(dtype=str), return_index=True)
        self.terms, self.start = {t: i for i, t in enumerate(terms)}, np.append(start, len(p))
        self.top = np.append(np.maximum.reduceat(self.impact, start) if len(p) else [], 0.0)  # last: words outside
        block = self.entry // BLOCK
        new = np.ones(len(p), bool)
        new[1:] = (block[1:] != block[:-1]) | (p["term"].to_numpy()[1:] != p["term"].to_numpy()[:-1])
        self.block_start = np.append(np.flatnonzero(new), len(p))
        self.block, self.block_top = block[new], np.maximum.reduceat(self.impact, np.flatnonzero(new)) if len(p) else self.impact
        self.term_block = np.searchsorted(self.block_start, self.start)
        rows = {r.row: (r.item_id, r.question, r.answer) for r in items.itertuples()}
        self.owner = [row for row, _ in entries.itertuples(index=False, name=None)]
        self.items = {r: (i, runs(words(q), shingle), runs(words(a), shingle)) for r, (i, q, a) in rows.items()}
        split = items[items["guessed"]] if "guessed" in items else items
        parted = [(r.row, words(r.question), words(r.answer)) for r in split.itertuples() if r.question != r.answer]
        self.split = {r: (runs(q + a, shingle), len(q) >= max(ALONE, len(a))) for r, q, a in parted}

    def retrieve(self, terms: np.ndarray, threshold: float) -> dict[int, float]:
        """Entries with a score at the threshold for distinct terms, by block-max WAND."""
        at = ranges(self.term_block[terms], self.term_block[terms + 1])
        bound = np.bincount(self.block[at], weights=self.block_top[at])
        at = at[bound[self.block[at]] >= threshold]
        if not len(at):
            return {}
        posts = ranges(self.block_start[at], self.block_start[at + 1])
        score = np.bincount(self.entry[posts], weights=self.impact[posts])
        return {int(e): float(score[e]) for e in np.flatnonzero(score >= threshold)}

    def hits(self, text: str | None, span: int, threshold: float, overlap: float, shingle: int) -> list[dict]:
        ws = words(text)
        if not ws or not self.terms:
            return []
        ids = np.fromiter(map(self.terms.get, ws, repeat(len(self.terms))), np.int64, len(ws))
        total = np.concatenate([[0.0], np.cumsum(self.top[ids])])
        los = np.arange(0, max(1, len(ws) - span), PASSAGE * span - span)
        his = np.minimum(len(ws), los + PASSAGE * span)
        eps = threshold - 1e-9
        found: dict[int, float] = {}
        for i in np.flatnonzero(total[his] - total[los] >= eps):
            terms = np.unique(ids[los[i] : his[i]])
            terms = terms[terms < len(self.terms)]
            if self.top[terms].sum() >= eps:
                for e, s in self.retrieve(terms, eps).items():
                    found[self.owner[e]] = max(found.get(self.owner[e], 0.0), s)
        out = []
        if found:
            there: dict[int, set] = {}
            for row, score in sorted(found.items()):
                item, question, answer = self.items[row]
                share = []
                whole, alone = self.split.get(row, (set(), False))
                for part in (question, answer, whole):
                    n = len(next(iter(part), ()))
                    there.setdefault(n, runs(ws, n) if n else set())
                    share.append(len(part & there[n]) / len(part) if part else 1.0)
                if min(share[:2]) >= overlap or whole and share[2] >= overlap or alone and share[0] >= overlap:
                    out.append({"item_id": item, "score": min(1.0, score), "question_overlap": share[0], "answer_overlap": share[1]})
        return sorted(out, key=lambda h: (h["item_id"] is None, h["item_id"]))


def _postings(entries: DataFrame) -> DataFrame:
    """(shard, row, seg, term, impact) of entries (shard, row, seg, ws)."""
    tf = entries.select("shard", "row", "seg", F.size("ws").alias("dl"), F.explode("ws").alias("term"))
    tf = tf.groupBy("shard", "row", "seg", "dl", "term").agg(F.count("*").alias("tf"))
    n, mean = entries.agg(F.count("*"), F.avg(F.size("ws"))).first()
    idf = tf.groupBy("term").agg(F.log(1 + (F.lit(float(n)) - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / float(mean or 1)))
    weighted = tf.join(idf, "term").withColumn("w", weight)
    own = weighted.groupBy("row", "seg").agg(F.sum("w").alias("self"))
    return weighted.join(own, ["row", "seg"]).select("shard", "row", "seg", "term", (F.col("w") / F.col("self")).alias("impact"))


def _looker(shared: Broadcast, *options: float) -> Callable[[pd.Series], pd.Series]:
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.hits(t, *options) for t in texts], dtype=object)

    return look


def contamination(
    docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, overlap: float = 0.8, shingle: int = 5,
    entry_words: int = 64, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    question: str | None = None, answer: str | None = None,
) -> Column:
    """A column for ``docs``: the items that a text contains, sorted, as ``HITS``; empty if none.

    ``question`` and ``answer`` name columns of ``items`` if it has them, and both must share
    ``overlap`` of their runs.  Else an item's last sentence is split off as its answer, and a document
    contains the item as well if it shares ``overlap`` of the whole item's runs, or of those before a
    last sentence that is the shorter part, if these are ``ALONE`` words.  Items without a word match nothing; repeated items and documents each count;
    a null or empty text contains nothing; an empty table of items gives empty lists.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    q, a = (F.col(question) if question else F.lit(None).cast("string")), (F.col(answer) if answer else F.lit(None).cast("string"))

    @F.pandas_udf("question string, answer string, guessed boolean, segs array<array<string>>, n int")
    def parse(texts: pd.Series, qs: pd.Series, as_: pd.Series) -> pd.DataFrame:
        out = []
        for t, own_q, own_a in zip(texts, qs, as_):
            t = t or " ".join(x for x in (own_q, own_a) if x)
            guess = question_and_answer(t)
            ws = words(t)
            segs = [ws[i : i + entry_words] for i in range(0, len(ws), entry_words)]
            out.append((own_q or guess[0], own_a or guess[1], not (own_q and own_a), segs, len(ws)))
        return pd.DataFrame(out, columns=["question", "answer", "guessed", "segs", "n"])

    parsed = items.select(
        F.col(item_id).cast("long").alias("item_id"), parse(F.col(item_text), q, a).alias("p"), F.monotonically_increasing_id().alias("row")
    ).where("p.n > 0").select("item_id", "row", "p.*")
    kept = stored(parsed, "items")
    shards = -(-(kept.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS)
    sharded = kept.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(1, shards))))
    postings = stored(_postings(sharded.select("shard", "row", F.posexplode("segs").alias("seg", "ws"))), "postings")
    columns = []
    for s in range(shards):
        own = postings.where(F.col("shard") == s).select("row", "seg", "term", "impact").toPandas()
        index = Index(own, sharded.where(F.col("shard") == s).select("row", "item_id", "question", "answer", "guessed").toPandas(), shingle)
        shared = spark.sparkContext.broadcast(index)

        # not to be repeated by a filter that is moved below the projection
        look = F.pandas_udf(_looker(shared, entry_words, threshold, overlap, shingle), HITS).asNondeterministic()
        columns.append(look(F.col(text)))
    return F.concat(*columns) if columns else F.array().cast(HITS)


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row (doc_id, item_id, score, question_overlap, answer_overlap) per item that a document contains."""
    hits = contamination(docs, items, **options)
    return docs.select(F.col(doc_id).alias("doc_id"), hits.alias("h")).select("doc_id", F.inline("h"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns kept, whatever their names.

    Null and empty texts contain nothing and stay; rows that repeat each other share their fate.
    """
    names, own = [F.col(f"`{c}`") for c in docs.columns], apart("_contained_items", docs.columns)
    flagged = docs.select(*names, contamination(docs, items, **options).alias(own))
    return flagged.where(F.size(own) == 0).select(*names)
