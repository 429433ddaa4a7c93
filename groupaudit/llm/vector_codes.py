"""Product codes of vectors: integer k-means per part with adaptive distance bounds.

Vectors become integers and are cut into equal parts; every part position has a codebook.  A round
assigns each part to the nearest entry and moves the entries to the means.  Between rounds a part keeps
its entry with an upper bound on its distance, its ``b`` next closest entries with a lower bound each,
in order, and one outer bound below the distance of all others:

1. Before a round the bounds are shifted by how far entries have moved.
2. If the upper bound stays below the first lower bound, the part keeps its entry and nothing is
   computed.  Else the first lower bound that lies above tells which entries can be nearest; only these
   are compared, in whole numbers, ties to the lower index.  If none lies above, all entries are.
3. ``b`` starts at a quarter of the entries; after a round it shrinks, down to an eighth, to what all
   but one part in a hundred needed.

Bounds are rounded outwards, so they never decide what whole numbers would decide otherwise.  A round
maps the stored table of parts and bounds to the next one; sums of entries are corrected by the parts
that changed, added up per task, then by entry.  Nothing is shuffled but these sums, whose number
depends on parts and entries alone; they and the codebooks pass the driver.  Earlier states are deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import discard, stored

GATHER = 1 << 20  # components of the vectors looked at together
BOUNDS = "code binary, old binary, near binary, bound binary, used binary"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def part_slices(width: int, parts: int) -> list[slice]:
    return [slice(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances (n, m) of rows to entries (m, w), or to entries of their own (n, m, w)."""
    gap = x[:, None, :] - entries
    return np.einsum("nmw,nmw->nm", gap, gap)


def search_all(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, near, bound) from the distances to all entries; bound is (upper, b lower ones, outer)."""
    d = squared(x, entries)
    order = np.argsort(d, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
    bound = np.full((len(x), b + 2), np.inf, dtype=np.float32)
    bound[:, 0] = _up(root[:, 0])
    rest = _down(root[:, 1 : b + 2])
    bound[:, 1 : 1 + rest.shape[1]] = rest
    return order[:, 0].astype(np.uint8), order[:, 1 : b + 1].astype(np.uint8), bound


def shifted(code: np.ndarray, near: np.ndarray, bound: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Bounds after entries moved by at most ``moved``; lower bounds in order again."""
    out = np.empty_like(bound)
    out[:, 0] = _up(bound[:, 0].astype(np.float64) + moved[code])
    out[:, 1:-1] = _down(bound[:, 1:-1].astype(np.float64) - moved[near])
    out[:, -1] = _down(bound[:, -1].astype(np.float64) - moved.max())
    return _ordered(out)


def _ordered(bound: np.ndarray) -> np.ndarray:
    bound[:, 1:] = np.minimum.accumulate(bound[:, :0:-1], axis=1)[:, ::-1]
    return bound


def assign(
    x: np.ndarray, entries: np.ndarray, code: np.ndarray, near: np.ndarray, bound: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, near, bound, used): bounds decide where they can; ``used`` counts the lower bounds passed."""
    b = near.shape[1]
    code, near, bound = code.copy(), near.copy(), bound.copy()
    used = (bound[:, :1] >= bound[:, 1:]).sum(axis=1).astype(np.uint8)  # lower bounds are in order
    for z in range(1, b + 1):
        rows = np.flatnonzero(used == z)
        if not len(rows):
            continue
        among = np.sort(np.column_stack([code[rows], near[rows, :z]]), axis=1)
        d = squared(x[rows], entries[among])
        order = np.argsort(d, axis=1, kind="stable")
        among, root = np.take_along_axis(among, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        code[rows], near[rows, :z] = among[:, 0], among[:, 1:]
        bound[rows, 0] = _up(root[:, 0])
        bound[rows, 1 : z + 1] = _down(root[:, 1:])
    rows = np.flatnonzero(used == b + 1)
    if len(rows):
        code[rows], near[rows], bound[rows] = search_all(x[rows], entries, b)
    return code, near, _ordered(bound), used


def _matrix(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    """Rows of a binary column of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1)
    each = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(each)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _gathered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches: numpy works on whole columns."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(map(len, some)) * max(1, width) >= GATHER:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some = []
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def kept_vectors(df: DataFrame, *, vec_id: str, embedding: str, label: str | None, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) as integers, and their width: that of the vector with the smallest id."""
    e = F.col(f"`{embedding}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    own = F.col(f"`{label}`") if label else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), own.alias("label"), e.alias("e")).where(e.isNotNull() & finite)
    first = rows.select("vec_id", F.size("e").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").first()
    width = first["n"] if first else 0
    most = min(math.isqrt(2**61 // max(1, -(-width // parts))), 2**31 - 1)
    fits = F.forall("e", lambda x: F.abs(x.cast("double")) * scale < float(most))
    whole = F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return stored(rows.where((F.size("e") == width) & fits).select("vec_id", "label", whole.alias("v")), "vectors"), width


def first_entries(rows: DataFrame, entries: int) -> np.ndarray:
    """Vectors of the smallest ids; of repeated ids, the smallest vector."""
    ids = [r[0] for r in rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    least = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    if not least:  # no row has an id
        least = rows.select("v").orderBy("v").limit(1).collect()
    return np.array([r["v"] for r in least], dtype=np.int64)


def vector_codes(
    df: DataFrame,
    *,
    scale: int = 4096,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str | None = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error, label_error), one per kept vector, and the codebooks.

    ``code`` is a byte per part, ``error`` the squared distances to its entries, ``label_error`` the sum
    of errors over equal labels, null ones together.  Codebook k is the slice k of the second result,
    (entries, width), cut like the vectors; parts are equal if their number divides the width.

    Vectors that are null or hold null or non-finite components take no part, nor do those of another
    length than the smallest id's vector, nor those with components so large that squared distances pass
    62 bits.  Repeated rows and rows without an id are encoded like any other; an id gives one first
    entry, null ids none (if there are only such, the smallest vector is the one entry).  Fewer ids than
    ``entries`` give fewer entries.  Other columns are ignored.  An empty table gives no row and empty
    codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: at most 256 entries")
    rows, width = kept_vectors(df, vec_id=vec_id, embedding=embedding, label=label, scale=scale, parts=parts)
    books = first_entries(rows, entries)
    if not len(books):
        out = rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return out.withColumn("label_error", F.col("error")), np.zeros((0, width), dtype=np.int64)
    slices, many = part_slices(width, parts), len(books)
    least = min(max(1, entries // 8), many - 1)
    b = min(max(1, entries // 4), many - 1)
    plain = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, v array<int>"
    state, sums, counts = None, np.zeros((many, width), dtype=object), np.zeros((parts, many), dtype=object)
    moved = np.zeros((parts, many))
    for _ in range(rounds):
        following = stored(_next_state(state if state is not None else rows, books, moved, state is None, width, slices, b, plain), "codes")
        if state is not None:
            discard(state)
        state = following
        passed = _add_changes(state, width, slices, many, sums, counts)
        new = books.copy()
        for k, s in enumerate(slices):
            for e in np.flatnonzero(counts[k]):
                new[e, s] = [int(x) // int(counts[k, e]) for x in sums[e, s]]
        moved = np.array([np.sqrt(((new[:, s] - books[:, s]) ** 2).sum(axis=1).astype(np.float64)) for s in slices])
        moved = np.nextafter(moved, np.inf) * (moved > 0)
        books = new
        needed = [z for z in range(b + 1) if sum(n for u, n in passed.items() if u > z) * 100 <= sum(passed.values())]
        shrunk = max(least, min(b, needed[0] if needed else b))
        state, b = _narrowed(state, parts, b, shrunk), shrunk
    source = state if state is not None else rows
    final = _next_state(source, books, moved, state is None, width, slices, b, plain, errors=True)
    coded = stored(final.select("vec_id", "label", "code", "error"), "coded")
    if state is not None:
        discard(state)
    discard(rows)
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(total, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


def _narrowed(state: DataFrame, parts: int, b: int, to: int) -> DataFrame:
    """Lists cut to ``to`` entries: the next lower bound becomes the outer one, as bounds are in order."""
    if to == b:
        return state

    def cut(column: str, each: int, size: int, kept: int) -> Column:
        pieces = [F.substring(column, k * each * size + 1, kept * size) for k in range(parts)]
        return F.concat(*pieces).alias(column)

    return state.select("vec_id", "label", "v", "code", "old", cut("near", b, 1, to), cut("bound", b + 2, 4, to + 2), "used")


def _next_state(
    state: DataFrame, books: np.ndarray, moved: np.ndarray, first: bool, width: int, slices: list[slice], b: int, plain: str, errors: bool = False
) -> DataFrame:
    parts = len(slices)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, width):
            n, v = len(batch), _vectors(batch.column("v"), width)
            code = np.zeros((n, parts), np.uint8) if first else _matrix(batch.column("code"), "u1", parts)
            new, used = np.empty((n, parts), np.uint8), np.full((n, parts), b + 1, np.uint8)
            nears, bounds = np.empty((n, parts, b), np.uint8), np.empty((n, parts, b + 2), np.float32)
            if not first:
                near, bound = _matrix(batch.column("near"), "u1", parts, b), _matrix(batch.column("bound"), "<f4", parts, b + 2)
            for k, s in enumerate(slices):
                x, own = v[:, s], books[:, s]
                if first:
                    new[:, k], nears[:, k], bounds[:, k] = search_all(x, own, b)
                else:
                    at = shifted(code[:, k], near[:, k], bound[:, k], moved[k])
                    new[:, k], nears[:, k], bounds[:, k], used[:, k] = assign(x, own, code[:, k], near[:, k], at)
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("v"), _binary(new)]
            if errors:
                error = np.zeros(n, np.int64)
                for k, s in enumerate(slices):
                    error += ((v[:, s] - books[new[:, k], s]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(error)], ["vec_id", "label", "v", "code", "error"])
                continue
            old = pa.nulls(n, pa.binary()) if first else batch.column("code")
            columns += [old, _binary(nears), _binary(bounds), _binary(used)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "code", "old", "near", "bound", "used"])

    return state.mapInArrow(step, f"{plain}, code binary, error long" if errors else f"{plain}, {BOUNDS}")


def _add_changes(
    state: DataFrame, width: int, slices: list[slice], many: int, sums: np.ndarray, counts: np.ndarray
) -> dict[int, int]:
    """Correct the entries' sums and counts by the parts that changed; returns how often ``used`` was what."""
    parts = len(slices)

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((many, width), np.int64), np.zeros((parts, many), np.int64)
        passed = np.zeros(257, np.int64)
        for batch in _gathered(batches, width):
            v, code = _vectors(batch.column("v"), width), _matrix(batch.column("code"), "u1", parts)
            passed += np.bincount(_matrix(batch.column("used"), "u1", parts).ravel(), minlength=257)
            fresh = batch.column("old").null_count > 0
            old = None if fresh else _matrix(batch.column("old"), "u1", parts)
            for k, s in enumerate(slices):
                rows = slice(None) if fresh else np.flatnonzero(code[:, k] != old[:, k])
                np.add.at(total[:, s], code[rows, k], v[rows, s])
                number[k] += np.bincount(code[rows, k], minlength=many)
                if not fresh:
                    np.subtract.at(total[:, s], old[rows, k], v[rows, s])
                    number[k] -= np.bincount(old[rows, k], minlength=many)
        for kind, values in enumerate((total, number, passed.reshape(1, -1))):
            at = np.flatnonzero(values.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(values.ravel()[at])], ["kind", "at", "n"]
            )

    parts_of = state.select("v", "code", "old", "used").mapInArrow(changes, "kind int, at int, n long")
    passed: dict[int, int] = {}
    for r in parts_of.groupBy("kind", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        if r["kind"] == 2:
            passed[r["at"]] = int(r["n"])
        else:
            (sums, counts)[r["kind"]].ravel()[r["at"]] += int(r["n"])  # both are contiguous: ravel is a view
    return passed
