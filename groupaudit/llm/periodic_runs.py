"""Periodic runs in the words of texts, found by block convolution.

A run is a stretch of consecutive words with smallest period q, at least ``shortest`` words and
``repeats`` periods long, that no neighbouring word extends.  A task does this for the whole texts of
a batch, laid end to end, the longest first:

1. Words become numbers by their first place in the text.
2. At scale B = 1, 2, 4, ... the texts long enough for a period of B are cut into blocks of B words.
   For each block, sum((block - window)^2) over the B windows that begin B to 2B - 1 words later is
   computed by a number-theoretic transform modulo 7 * 2^20 + 1: squares by prefix sums, products by
   transforms of size 2B.  A window is two blocks, so its transform is a sum of two block transforms;
   one transform per block and one back do.  Transforms are products with small exact matrices.
3. Sums of zero are the block's occurrences.  While B times the square of the greatest number stays
   below the modulus the sum is the integer itself; beyond, zero modulo a prime is necessary, and the
   words themselves decide in step 4.
4. A run of period B <= q < 2B holds two neighbouring blocks that both recur at distance q.  Such
   distances seed extensions: words q apart are compared to both sides until they differ.  Seeds inside
   a run whose period divides their distance are its own repetition and are passed over.

Blocks stop growing at ``most_block`` words; longer periods take several windows a block.  No text is
cut, and every document is a row of its own, so that nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import small_batches

PRIME, GENERATOR, ORDER = 7 * 2**20 + 1, 3, 20  # 2^ORDER divides PRIME - 1
DENSE = 128  # sums of so many products below PRIME^2 are exact in a double
CHUNK = 1 << 17  # words transformed at once
RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME in place, for integers below 2^53; zero may come out as PRIME."""
    q = np.floor(x * (1 / PRIME))
    q *= PRIME
    x -= q
    return x


@cache
def _powers(size: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(size, dtype=np.int64)
    done = 1
    while done < size:  # doubling
        out[done : 2 * done] = out[:done] * pow(root, done, PRIME) % PRIME
        done *= 2
    return out


@cache
def _matrix(size: int, inverse: bool) -> np.ndarray:
    i = np.arange(size)
    return _powers(size, inverse)[np.outer(i, i) % size].astype(np.float64)


@cache
def _twiddle(rows: int, columns: int, inverse: bool) -> np.ndarray:
    size = rows * columns
    return _powers(size, inverse)[np.outer(np.arange(rows), np.arange(columns)) % size].astype(np.float64)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of every row, not divided by its length."""
    many, size = x.shape
    if size <= DENSE:
        return _mod(x @ _matrix(size, inverse))
    rows = 64
    columns = size // rows
    inner = _mod(_matrix(rows, inverse) @ x.reshape(many, rows, columns))
    inner *= _twiddle(rows, columns, inverse)
    outer = transform(_mod(inner).reshape(many * rows, columns), inverse).reshape(many, rows, columns)
    return outer.transpose(0, 2, 1).reshape(many, size)


def recurrences(words: np.ndarray, block: int, blocks_away: int) -> np.ndarray:
    """Sorted j * block + i for all blocks j that recur block * blocks_away + i words later, i < block."""
    n, size = len(words), 2 * block
    count = n // block
    words = words % PRIME
    squares = np.concatenate([[0], np.cumsum(words**2 % PRIME)])
    scale = pow(size, PRIME - 2, PRIME)
    sign = np.where(np.arange(size) % 2, -1.0, 1.0)
    back = np.concatenate([[0], np.arange(size - 1, 0, -1)])
    found, step = [], max(1, CHUNK // block)

    def blocks(lo: int, hi: int) -> np.ndarray:
        """Transforms of blocks lo .. hi - 1, each followed by as many zeros; none where the words end."""
        part = words[lo * block : hi * block]
        flat = np.zeros((hi - lo) * block)
        flat[: len(part)] = part
        x = flat.reshape(hi - lo, block)
        if size <= DENSE:
            return _mod(x @ _matrix(size, False)[:block])
        padded = np.zeros((hi - lo, size))
        padded[:, :block] = x
        return transform(padded)

    for lo in range(0, max(0, count - blocks_away), step):
        hi = min(lo + step, count - blocks_away)
        after = blocks(lo + blocks_away, hi + blocks_away + 1)
        own = blocks(lo, hi)
        products = own[:, back]
        products *= _mod(after[:-1] + after[1:] * sign)
        products = _mod(products)
        if size <= DENSE:
            cross = _mod(products @ _matrix(size, True)[:, :block])
        else:
            cross = transform(products, inverse=True)[:, :block]
        at = np.arange(lo, hi)[:, None] * block + np.arange(block) + block * blocks_away
        ends = np.minimum(at + block, n)
        both = squares[ends] - squares[np.minimum(at, n)]
        both += (squares[(np.arange(lo, hi) + 1) * block] - squares[np.arange(lo, hi) * block])[:, None]
        total = _mod((both % PRIME).astype(np.float64) + (PRIME - _mod(cross * scale)) * 2.0)
        zero = ((total == 0) | (total == PRIME)) & (at + block <= n)
        found.append(np.flatnonzero(zero.ravel()) + lo * block)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _same(words: np.ndarray, at: int, distance: int, low: int, high: int) -> tuple[int, int]:
    """Greatest stretch [s, t) around ``at`` within [low, high) whose words equal those ``distance`` later."""
    t, step = at, 32
    while t < high:
        hi = min(high, t + step)
        differs = words[t:hi] != words[t + distance : hi + distance]
        if differs.any():
            t += int(differs.argmax())
            break
        t, step = hi, 4 * step
    s, step = at, 32
    while s > low and t > at:
        lo = max(low, s - step)
        differs = words[lo:s] != words[lo + distance : s + distance]
        if differs.any():
            s -= int(differs[::-1].argmax())
            break
        s, step = lo, 4 * step
    return s, t


def find_runs(
    words: np.ndarray, lengths: np.ndarray, *, shortest: int = 6, repeats: int = 4, most_block: int = 1 << (ORDER - 1)
) -> np.ndarray:
    """Rows (start, length, period) of all runs in texts that lie end to end in ``words``, longest text first.

    ``repeats`` is at least 4, so that a run holds two whole blocks of its scale and their recurrence.
    """
    if repeats < 4:
        raise ValueError("repeats must be 4 or more")
    ends = np.cumsum(lengths)
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    known: dict[int, list[tuple[int, int]]] = {}
    scale = 1
    while True:
        n = int(lengths[lengths >= max(shortest, repeats * scale)].sum())  # a prefix: the longest come first
        if not n:
            break
        block = min(scale, most_block)
        for away in range(scale // block, 2 * (scale // block)):
            hits = recurrences(words[:n], block, away)
            pairs = hits[np.isin(hits + block, hits, assume_unique=True)]
            begin, distance = pairs // block * block, pairs % block + block * away
            whole = text_of[begin] == text_of[begin + block + distance - 1]
            begin, distance = begin[whole], distance[whole]
            for period, stretches in known.items():
                if not len(begin):
                    break
                known_at = np.array(sorted(stretches))
                i = np.searchsorted(known_at[:, 0], begin, side="right") - 1
                inside = (i >= 0) & (known_at[i, 1] >= begin + block + distance) & (distance % period == 0)
                begin, distance = begin[~inside], distance[~inside]
            order = np.lexsort((begin, distance))
            begin, distance = begin[order], distance[order]
            firsts = np.flatnonzero(np.diff(distance, prepend=-1))
            for lo, hi in zip(firsts, [*firsts[1:], len(distance)]):
                q, i = int(distance[lo]), int(lo)
                while i < hi:
                    at = int(begin[i])
                    text = text_of[at]
                    s, t = _same(words, at, q, int(ends[text] - lengths[text]), int(ends[text]) - q)
                    if t >= at + block and t + q - s >= max(shortest, repeats * q):
                        known.setdefault(q, []).append((s, t + q))
                    i += max(1, int(np.searchsorted(begin[i:hi], t)))
        scale *= 2
    rows = [(s, e - s, q) for q, stretches in known.items() for s, e in stretches]
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])) or np.zeros((0, 3)), dtype=np.int64)


def text_runs(texts: list[bytes | None], **limits: int) -> list[tuple[list[bytes], np.ndarray]]:
    """(words, runs by start and period) of every text."""
    words = [(t or b"").split() for t in texts]  # bytes are split at ASCII white space only
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    lengths = np.array([len(words[i]) for i in order], dtype=np.int64)
    numbers = []
    for i in order:
        of = {w: k for k, w in enumerate(dict.fromkeys(words[i]))}
        numbers.append(np.fromiter(map(of.__getitem__, words[i]), dtype=np.int64, count=len(words[i])))
    runs = find_runs(np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64), lengths, **limits)
    begins = np.cumsum(lengths) - lengths
    cuts = np.searchsorted(runs[:, 0], np.append(begins, lengths.sum())) if len(order) else np.zeros(1, dtype=np.int64)
    out: list = [None] * len(words)
    for k, i in enumerate(order):
        own = runs[cuts[k] : cuts[k + 1]] - [begins[k], 0, 0]
        out[i] = (words[i], own)
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs.tolist():
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str | Column = "text", shortest: int = 6, repeats: int = 4) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one per row of ``docs``.

    ``runs`` has (start, length, period) in words from 0, by start, then period; ``collapsed`` is the text
    with one period left of every run and single spaces.  A null, empty or blank text has no words, no
    run and an empty collapsed text.  Null ids and repeated rows are treated like any other row.  Other
    columns are ignored.  An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    own = docs.schema[doc_id].dataType.simpleString()
    body = F.col(f"`{text}`") if isinstance(text, str) else text

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_runs(batch.column(1).to_pylist(), shortest=shortest, repeats=repeats)
            offsets = np.cumsum([0, *(len(r) for _, r in found)])
            rows = np.concatenate([r for _, r in found]) if found else np.zeros((0, 3), dtype=np.int64)
            fields = [pa.array(rows[:, k], pa.int64()) for k in range(3)]
            structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w, _ in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                    pa.array([collapse(w, r) for w, r in found], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.cast("binary").alias("text"))
    return rows.mapInArrow(find, f"doc_id {own}, {RUNS}")
