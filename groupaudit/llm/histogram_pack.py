"""Packing by the histogram of lengths, shortest pack first.

1. Tasks encode whole texts.  Ids beyond the capacity are cut off in full sequences; what is left of
   a document is one piece.  Pieces are numbered within (task, length), and a table of counts turns
   that into a rank within each length.
2. The histogram is packed, longest lengths first: a length goes to the packs that are shortest so
   far, if it fits them; what fits nowhere opens packs.  A packing pattern is a list of lengths with a
   count of packs; placing pieces splits or extends patterns and updates their counts.
3. As documents may be cut, the packs that are left over the least possible number of full sequences,
   the shortest ones, are dissolved: their pieces, end to end, fill the gaps of the kept patterns,
   again by counts.  What then remains is less than one sequence; it is laid out in sequences whose
   lengths are powers of two, which need no padding either.
4. The patterns are joined back to the pieces by (length, rank): tasks look them up in a table that is
   bounded by the capacity, whatever the number of documents.

Only the histogram and the patterns, at most two per length and one group of gaps per pattern, pass
the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupaudit.llm.common import small_batches, stored
from groupaudit.llm.unit_encoder import UnitEncoder, ids_crc32, worker_encoder

PIECES = "doc_id string, start long, length int, doc_tokens long, ids_crc32 long, ids binary, task int, nth long"
PLACED = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Item(NamedTuple):
    """A piece of a pattern: pack number s holds the piece of this length with rank s + shift."""

    length: int
    shift: int
    offset: int
    before: _Item | None


class _Packs(NamedTuple):
    """Packs first .. first + n - 1 of one pattern, with ``gap`` ids free in each."""

    gap: int
    first: int
    n: int
    last: _Item | None


def shortest_pack_first(counts: dict[int, int], capacity: int) -> list[_Packs]:
    """Patterns with their packs, fullest first, for ``counts`` pieces of each length up to ``capacity``."""
    by_gap: dict[int, list[_Packs]] = defaultdict(list)
    widest = opened = 0
    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[x]
        while left:
            while widest and not by_gap[widest]:
                widest -= 1
            if widest >= x:
                packs = by_gap[widest].pop()
                n = min(left, packs.n)
                if n < packs.n:
                    by_gap[widest].append(packs._replace(first=packs.first + n, n=packs.n - n))
                item = _Item(x, rank - packs.first, capacity - widest, packs.last)
                by_gap[widest - x].append(_Packs(widest - x, packs.first, n, item))
                rank, left = rank + n, left - n
                continue
            per = min(capacity // x, left)  # pieces that open a pack together
            n, item = left // per, None
            for k in range(per):
                item = _Item(x, rank + k * n - opened, k * x, item)
            by_gap[capacity - per * x].append(_Packs(capacity - per * x, opened, n, item))
            widest = max(widest, capacity - per * x)
            rank, left, opened = rank + per * n, left - per * n, opened + n
    return [p for gap in sorted(by_gap) for p in by_gap[gap]]


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs, slots) that place every piece.

    A run (length, rank, sequence, offset, stream, width): the piece of rank + i goes to ``sequence`` + i
    at ``offset``; if ``sequence`` is -1, its pack is dissolved and the piece begins at
    ``stream`` + i * ``width`` of the stream of dissolved ids.  A slot group (stream, size, sequence,
    offset): its i-th slot takes the ``size`` ids from ``stream`` + i * ``size`` on, to ``sequence`` + i
    at ``offset``.
    """
    keep, rest = divmod(sum(x * n for x, n in counts.items()), capacity)
    patterns = shortest_pack_first(counts, capacity)
    runs, slots, filled, stream = [], [], 0, 0
    number = sum(p.n for p in patterns)
    for packs in patterns:
        kept = min(keep, packs.n)
        keep -= kept
        if kept and packs.gap:
            slots.append((filled, packs.gap, packs.first, capacity - packs.gap))
            filled += kept * packs.gap
        width, item = capacity - packs.gap, packs.last
        while item:
            rank = packs.first + item.shift
            if kept:
                runs.append((item.length, rank, packs.first, item.offset, 0, 0))
            if kept < packs.n:
                runs.append((item.length, rank + kept, -1, 0, stream + item.offset, width))
            item = item.before
        stream += (packs.n - kept) * width
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            slots.append((filled, 1 << bit, number, 0))
            filled, number = filled + (1 << bit), number + 1
    if filled != stream:
        raise AssertionError("gaps and dissolved pieces differ")
    return (
        np.array(sorted(runs) or np.zeros((0, 6)), dtype=np.int64),
        np.array(slots or np.zeros((0, 4)), dtype=np.int64),
    )


def place(lengths: np.ndarray, ranks: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, stream) of pieces: one of sequence and stream, the place in the stream, is -1."""
    keys = (runs[:, 0] << 44) | runs[:, 1]
    _, first, sequence, offset, stream, width = runs[np.searchsorted(keys, (lengths << 44) | ranks, side="right") - 1].T
    i, whole = ranks - first, sequence >= 0
    return np.where(whole, sequence + i, -1), offset, np.where(whole, -1, stream + i * width)


def slot_parts(at: int, length: int, slots: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Parts (from, to, sequence, offset) of the ``length`` ids that begin at place ``at`` of the stream."""
    parts, done = [], 0
    group = int(np.searchsorted(slots[:, 0], at, side="right")) - 1
    while done < length:
        begin, size, sequence, offset = slots[group].tolist()
        slot, inside = divmod(at + done - begin, size)
        take = min(length - done, size - inside)
        parts.append((done, done + take, sequence + slot, offset + inside))
        done += take
        group += group + 1 < len(slots) and at + done >= slots[group + 1, 0]
    return parts


def _id_type(encoder: UnitEncoder, end_id: int) -> np.dtype:
    return encoder.dtype if end_id <= np.iinfo(encoder.dtype).max else np.dtype("<u4")


def encoded_pieces(docs: DataFrame, *, path: str, end_id: int, capacity: int, doc_id: str, text: str) -> DataFrame:
    """Full sequences cut off every whole text, and its rest with the ids that may still be cut."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, seen = worker_encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        wide = _id_type(encoder, end_id)
        end = np.array([end_id], wide)
        for pdf in batches:
            rows = []
            for own, t in zip(pdf["id"], pdf["text"]):
                ids = np.concatenate([np.frombuffer(encoder.encode_one(t), encoder.dtype).astype(wide, copy=False), end])
                for lo in range(0, len(ids), capacity):
                    part = ids[lo : lo + capacity]
                    n = len(part)
                    body = None if n == capacity else part.tobytes()
                    rows.append((own, lo, n, len(ids), ids_crc32(part), body, task, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "task", "nth"])

    return docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(cut, PIECES)


def histogram_pack(
    docs: DataFrame, *, path: str, end_id: int = 1, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    Every id of every document, closed by ``end_id``, lies in one piece.  Sequences hold ``capacity``
    ids, but for those of the last ``n mod capacity`` ids of all, whose lengths are powers of two.
    A null text counts as empty (one piece, the end id).  Null ids and repeated rows are packed like
    any other row; ties between pieces of one length are settled by task and place.  Other columns are
    ignored.  An empty table gives no row.
    """
    spark = docs.sparkSession
    pieces = stored(encoded_pieces(docs, path=path, end_id=end_id, capacity=capacity, doc_id=doc_id, text=text), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = stored(per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, slots = pack_histogram(counts, capacity)
    shared = spark.sparkContext.broadcast((runs, slots))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, slots = shared.value
        wide = _id_type(worker_encoder(path), end_id)
        for pdf in batches:
            sequence, offset, stream = place(pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64), runs)
            pdf["sequence_id"], pdf["offset"] = sequence, offset
            yield pdf.loc[sequence >= 0, names]
            rows = []
            for k in np.flatnonzero(sequence < 0).tolist():
                piece = pdf.iloc[k]
                ids = np.frombuffer(piece["ids"], wide)
                for lo, hi, s, o in slot_parts(int(stream[k]), len(ids), slots):
                    rows.append((piece["doc_id"], piece["start"] + lo, hi - lo, ids_crc32(ids[lo:hi]), piece["doc_tokens"], s, o))
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ranked = pieces.join(ranks.select("task", "length", "before"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    # only pieces of dissolved packs are cut: few ids leave the JVM
    cut: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, rank, sequence, _, _, _ in runs.tolist():
        if sequence < 0:
            above = runs[(runs[:, 0] == length) & (runs[:, 1] > rank), 1]
            cut[length].append((rank, int(above.min()) if len(above) else counts[length]))
    rows = spark.createDataFrame(list(cut.items()), "length int, cut array<struct<lo: long, hi: long>>")
    dissolved = F.exists("cut", lambda c: (F.col("rank") >= c["lo"]) & (F.col("rank") < c["hi"]))
    ranked = ranked.join(rows, "length", "left").select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids_crc32", F.when(dissolved, F.col("ids")).alias("ids"), "rank"
    )
    return ranked.mapInPandas(assign, PLACED).withColumn("doc_id", F.col("doc_id").cast("long"))
