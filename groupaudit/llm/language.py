"""Language of whole documents from a byte-level recurrent network.

The network is fitted on all words of all labelled documents; it then labels every position of every
word of every document, and a document's probabilities are the mean over its letter positions.  The
network starts anew at each word, so a worker reads each distinct word once and remembers its sum.

A softmax names a label for any text, so that a rejection needs more: held-out labelled documents tell
how sure the network is of clean texts, and which share of their letter triples it has not learned.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.byte_gru import ByteGRU, windows
from groupaudit.llm.common import apart, small_batches, stored

MEMORY_WORDS, LONG_WORD = 500_000, 64  # remembered words of one worker, and their length
UNKNOWN = "und"
PRIOR = 30  # letters of an ordinary text that every text is given before it is judged: a few words tell little
ENOUGH, TAIL = 20, 0.01  # held-out documents from which a bound is drawn, and the quantile it is drawn from
RARE = 200_000  # a triple is learned if it is one of so many of its label at least
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def triples(word: str) -> list[str]:
    """A triple for every letter of a word, case aside: it and its neighbours, a blank at either end."""
    return [f" {run} "[i : i + 3] for run in _LETTERS.findall(word.lower()) for i in range(len(run))]


def labelled_texts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    return labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def window_counts(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w, n): how often each window of a word occurs in all documents of a label."""
    small_batches(labelled.sparkSession)

    def flushed(count: dict[str, Counter[str]]) -> Iterator[pa.RecordBatch]:
        """A task's counts so far, emptied; the shuffle adds up what comes twice."""
        while count:
            g, words = count.popitem()
            for rows in batched(words.items(), 100_000):
                cut = [(w, n) for word, n in rows for w in windows(word)]
                w, n = zip(*cut)
                yield pa.record_batch({"lang": pa.array([g] * len(w)), "w": pa.array(w, pa.binary()), "size": pa.array(n, pa.int64())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, Counter[str]] = {}
        for batch in batches:
            for g, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                count.setdefault(g, Counter()).update(t.split())
            if sum(map(len, count.values())) > MEMORY_WORDS:
                yield from flushed(count)
        yield from flushed(count)

    rows = labelled_texts(labelled, text, lang).mapInArrow(cut, "lang string, w binary, size long")
    return stored(rows.groupBy("lang", "w").agg(F.sum("size").alias("n")), "windows")


def learned_triples(counted: DataFrame, labels: list[str]) -> dict[str, np.ndarray]:
    """The letter triples that are one of ``RARE`` of their label at least, so at most as many: for each, its labels."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: Counter[tuple[str, str]] = Counter()
            for g, w, n in zip(pdf["lang"], pdf["w"], pdf["n"].tolist()):
                for t in triples(bytes(w).decode("utf-8", "ignore")):
                    count[g, t] += n
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["lang", "t", "n"])

    each = stored(counted.mapInPandas(cut, "lang string, t string, n long").groupBy("lang", "t").agg(F.sum("n").alias("n")), "triples")
    totals = each.groupBy("lang").agg(F.sum("n").alias("total"))
    out: dict[str, np.ndarray] = {}
    for g, t in each.join(totals, "lang").where(F.col("n") * RARE >= F.col("total")).select("lang", "t").toPandas().itertuples(index=False):
        out.setdefault(t, np.zeros(len(labels), bool))[labels.index(g)] = True
    return out


def _put(into: np.ndarray, at: int, rows: np.ndarray) -> np.ndarray:
    """``into`` with ``rows`` from position ``at`` on; it grows by doubling."""
    if at + len(rows) > len(into):
        into = np.concatenate([into[:at], np.zeros((max(at + len(rows), 2 * len(into)) - at, *into.shape[1:]), into.dtype)])
    into[at : at + len(rows)] = rows
    return into


class _Reader:
    """Sums of words on one worker."""

    def __init__(self, model: ByteGRU, learned: dict[str, np.ndarray]):
        self.model, self.learned = model, learned
        self.forget()

    def keep(self, most: int) -> None:
        """Forget all words but those that came in several batches, of which ``most`` at most, those of most batches first."""
        known, place = list(self.at), np.fromiter(self.at.values(), np.int64, len(self.at))
        often = np.argsort(-self.batches[place], kind="stable")[: min(most, int((self.batches[place] > 1).sum()))]
        for name in ("batches", "sums", "counts", *(("known", "triples") if self.learned else ())):
            setattr(self, name, getattr(self, name)[place[often]])
        self.at, self.used = {known[i]: j for j, i in enumerate(often.tolist())}, len(often)

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.used, self.batches = 0, np.zeros(0, np.int32)
        self.sums, self.counts = np.zeros((0, len(self.model.labels)), np.float32), np.zeros(0, np.int64)
        self.known, self.triples = np.zeros((0, len(self.model.labels)), np.int64), np.zeros(0, np.int64)

    def familiar(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter triples of each word that each label has learned, and all of them."""
        none, at = np.zeros(len(self.model.labels), bool), [triples(w) for w in new]
        n = np.array([len(a) for a in at], np.int64)
        flat = [self.learned.get(t, none) for a in at for t in a]
        total = np.concatenate([np.zeros((1, len(none)), np.int64), np.cumsum(np.array(flat, np.int64).reshape(len(flat), len(none)), axis=0)])
        end = np.cumsum(n)
        return total[end] - total[end - n], n

    def read(self, texts: list[str]) -> list[tuple[str, float, int, int, int]]:
        """Label, its probability, letter positions, letter triples, and triples that the label has not learned."""
        words = [t.split() for t in texts]
        # each distinct word of the batch is looked up once
        coded = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        token, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.at]
        if len(self.at) + len(new) > MEMORY_WORDS:
            self.keep(MEMORY_WORDS // 2)
            new = [w for w in distinct if w not in self.at]
        cut = [windows(w) for w in new]
        sums, counts = self.model.pooled([w for c in cut for w in c])
        start = np.concatenate([[0], np.cumsum([len(c) for c in cut])[:-1]]).astype(np.int64)
        if len(new):
            sums, counts = np.add.reduceat(sums, start, axis=0), np.add.reduceat(counts, start)
        n = self.used
        self.used += len(new)
        self.sums, self.counts = _put(self.sums, n, sums), _put(self.counts, n, counts)
        self.batches = _put(self.batches, n, np.zeros(len(new), np.int32))
        if self.learned:
            known, n_triples = self.familiar(new)
            self.known, self.triples = _put(self.known, n, known), _put(self.triples, n, n_triples)
        self.at.update(zip(new, range(n, self.used)))
        place = np.fromiter(map(self.at.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        self.batches[place] += 1
        size = np.array([len(ws) for ws in words], np.int64)
        end = np.cumsum(size)
        own_sums, own_counts = self.sums[place].astype(np.float64), self.counts[place]
        if self.learned:
            own_known, own_triples = self.known[place], self.triples[place]
        out = []
        for t, lo, hi in zip(texts, (end - size).tolist(), end.tolist()):
            i = token[lo:hi]
            letters = int(own_counts[i].sum())
            if not letters or not self.model.labels or not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0, 0, 0, 0))
                continue
            p = own_sums[i].sum(axis=0) / letters
            best = int(p.argmax())
            n_all = int(own_triples[i].sum()) if self.learned else 0
            n_new = n_all - int(own_known[i, best].sum()) if self.learned else 0
            out.append((self.model.labels[best], float(min(1.0, p[best])), letters, n_all, n_new))
        for w in new:
            if len(w) > LONG_WORD:
                del self.at[w]
        return out


_WORKER: dict[str, _Reader] = {}


LABEL = "lang_pred string, score double, letters long, triples long, new long"


def _label(docs: DataFrame, model: ByteGRU, text: str, learned: dict[str, np.ndarray] | None = None) -> Column:
    small_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast((model, learned or {})), uuid.uuid4().hex

    def label(texts: pd.Series) -> pd.DataFrame:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = _Reader(*shared.value)
        return pd.DataFrame(_WORKER[key].read([t or "" for t in texts]), columns=["lang_pred", "score", "letters", "triples", "new"])

    # not to be repeated by a filter that is moved below the projection
    return F.pandas_udf(label, LABEL).asNondeterministic()(F.col(f"`{text}`"))


def identify(
    docs: DataFrame, model: ByteGRU, *, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted label and its probability added, whole texts, no shuffle.

    A null text, and one without a letter, is ``und`` with score 0.  Columns that have one of
    ``names`` are replaced.  Ids play no part; repeated rows stay.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    labelled = docs.select(*rest, _label(docs, model, text).alias("_label"))
    return labelled.select(*rest, F.col("_label.lang_pred").alias(names[0]), F.col("_label.score").alias(names[1]))


def fit(
    labelled: DataFrame, *, items_per_label: int = 8_000, rounds: int = 4, label_limit: int = 200, text: str = "text", lang: str = "lang",
    with_triples: bool = True,
) -> tuple[ByteGRU, dict[str, np.ndarray]]:
    """The network fitted on all windows of all labelled rows, and their triples if asked for; without such rows it knows no label.

    A window is an item once, and more often in proportion to the square root of how often it occurs, so that
    rare words are learned as well.  Windows are dealt by hash into shards of about ``items_per_label`` items
    a label.  In a round tasks pass over the items of every ``rounds``-th shard (of all shards, while there are
    fewer) from the last mean of the shards' states, so that each shard has its turn; the states are added up in
    Spark, so that the driver has a few vectors of the network's size.
    """
    counted = window_counts(labelled, text=text, lang=lang)
    of = counted.groupBy("lang").agg(F.count("*").alias("windows"), F.sum(F.sqrt("n")).alias("roots"))
    found = sorted(of.limit(label_limit + 1).collect())
    if len(found) > label_limit:
        raise ValueError(f"more than {label_limit} labels")
    labels = [r["lang"] for r in found]
    model = ByteGRU(labels)
    if not labels:
        return model, {}
    shards = -(-sum(r["windows"] for r in found) // (items_per_label * len(labels)))
    per_root = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], items_per_label * shards / r["roots"])])
    times = F.greatest(F.lit(1), F.round(F.sqrt("n") * F.element_at(per_root, F.col("lang")))).cast("int")
    placed = counted.select(F.pmod(F.xxhash64("w"), F.lit(shards)).alias("shard"), "lang", "w", times.alias("times"))
    placed, state = stored(placed, "items"), None
    turns = min(rounds, shards)
    for r in range(rounds):
        state = _round(placed.where(F.col("shard") % turns == r % turns), labels, state, r, rounds, 2 * -(-shards // turns))
    model.load(state)
    return model, learned_triples(counted, labels) if with_triples else {}


def _round(placed: DataFrame, labels: list[str], state: np.ndarray | None, epoch: int, epochs: int, width: int) -> np.ndarray:
    shared = placed.sparkSession.sparkContext.broadcast(state)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "w"])
        at = np.repeat(np.arange(len(pdf)), pdf["times"])
        items, y = pdf["w"].map(bytes).to_numpy()[at], pdf["lang"].map(labels.index).to_numpy(np.int64)[at]
        after = ByteGRU(labels).learn(items, y, shared.value, epoch=epoch, epochs=epochs)
        return pd.DataFrame({"part": [int(pdf["shard"].iloc[0]) % 16], "weight": [float(len(at))], "state": [(after * len(at)).tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in pdf["state"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "weight": [pdf["weight"].sum()], "state": [total.tobytes()]})

    schema = "part int, weight double, state binary"
    dealt = placed.repartition(width, "shard")  # a number that is given keeps small shards in tasks of their own
    sums = dealt.groupBy("shard").applyInPandas(learn, schema).groupBy("part").applyInPandas(added, schema).orderBy("part").collect()
    return sum(np.frombuffer(r["state"]) for r in sums) / sum(r["weight"] for r in sums)


def calibrate(
    clean: DataFrame, model: ByteGRU, learned: dict[str, np.ndarray], *, text: str = "text", lang: str = "lang"
) -> dict[str, tuple[float, float, float, float]]:
    """Per label: usual score and least score, usual share of new triples and largest share.

    ``clean`` are labelled rows that the network has not seen, all of which are read.  Scores and shares are those
    of ``judged``.  The least score lies halfway from chance to the score that all but a hundredth of the
    rows reach; the largest share lies a quarter of the way from the share that all but a hundredth
    keep to the share of a text in which nothing is learned.  A label with fewer than ``ENOUGH`` rows
    takes the bounds of all rows together; where these are too few as well there are none.
    """
    rows = labelled_texts(clean, text, lang)
    rows = rows.select("lang", _label(rows, model, "text", learned).alias("l")).where(F.col("l.lang_pred") == F.col("lang"))
    found = stored(rows.select("l.*"), "held_out")  # five numbers a row
    exact = lambda x, q: F.percentile_approx(x, q, 1_000_000)  # noqa: E731 - a sketch that adds up, of all rows
    usual = found.rollup("lang_pred").agg(
        F.count("*").alias("n"), exact("score", 0.5).alias("score"), (F.sum("new") / F.greatest(F.lit(1), F.sum("triples"))).alias("share")
    )
    usual = {r["lang_pred"]: r for r in usual.where(F.col("n") >= ENOUGH).collect()}  # a row per label
    if None not in usual:
        return {}
    out, chance = {}, 1 / len(model.labels)
    own = [g for g in model.labels if g in usual]
    both = found.select("*", F.lit(None).cast("string").alias("_g")).union(found.where(F.col("lang_pred").isin(own)).select("*", F.col("lang_pred").alias("_g")))
    of = F.create_map(*[x for g, r in usual.items() for x in (F.lit(g or UNKNOWN), F.array(F.lit(r["score"]), F.lit(r["share"])))])
    mid = F.element_at(of, F.coalesce("_g", F.lit(UNKNOWN)))
    tails = both.groupBy("_g").agg(
        exact((F.col("score") * F.col("letters") + PRIOR * mid[0]) / (F.col("letters") + PRIOR), TAIL).alias("low"),
        exact((F.col("new") + PRIOR * mid[1]) / (F.col("triples") + PRIOR), 1 - TAIL).alias("high"),
    )
    bounds = {
        r["_g"]: (usual[r["_g"]]["score"], chance + (r["low"] - chance) / 2, usual[r["_g"]]["share"], r["high"] + (1 - r["high"]) / 4)
        for r in tails.collect()
    }
    for g in model.labels:
        out[g] = bounds.get(g, bounds[None])
    return out


def judged(label: Column, bounds: dict[str, tuple[float, float, float, float]]) -> Column:
    """Whether a label's score and share of new triples, ``PRIOR`` usual letters added, keep its bounds."""
    if not bounds:
        return F.lit(True)
    of = F.create_map(*[x for g, b in bounds.items() for x in (F.lit(g), F.array(*map(F.lit, b)))])
    b = F.try_element_at(of, label["lang_pred"])
    score = (label["score"] * label["letters"] + PRIOR * b[0]) / (label["letters"] + PRIOR)
    share = (label["new"] + PRIOR * b[2]) / (label["triples"] + PRIOR)
    return F.coalesce((score >= b[1]) & (share <= b[3]), F.lit(True))


def language_id(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learned from rows that are not held out.

    Held out is crc32 of the id as text divisible by 5.  Rows without an id or label are not learned
    from; a row without an id is not held out.
    """
    known = docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id))
    model, _ = fit(known, text=text, lang=lang, with_triples=False)
    return identify(docs.drop("held_out").withColumn("held_out", held_out(doc_id)), model, text=text)


def keep_identified(
    docs: DataFrame, *, least: float = 0.2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``docs`` without rows of no learned language; columns kept, whatever their names.

    These are ``und``, a probability below ``least``, and what ``judged`` tells from the held-out
    labelled documents: a network that is less sure, or more letter triples that it has not learned,
    than in clean texts of that label.
    """
    names, own = [F.col(f"`{c}`") for c in docs.columns], apart("_label", docs.columns)
    given, columns = docs.where(F.col(doc_id).isNotNull()), {"text": text, "lang": lang}
    model, learned = fit(given.where(~held_out(doc_id)), **columns)
    bounds = calibrate(given.where(held_out(doc_id)), model, learned, **columns)
    found = docs.select(*names, _label(docs, model, text, learned).alias(own))
    label = F.col(own)
    sure = (label["lang_pred"] != UNKNOWN) & (label["score"] >= least)
    return found.where(sure & judged(label, bounds)).select(*names)
