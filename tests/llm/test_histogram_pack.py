"""Packing by the histogram: patterns, cuts and whole documents."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groupaudit.llm import queries
from groupaudit.llm.histogram_pack import histogram_pack, pack_histogram, place, shortest_pack_first, slot_parts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTE)
ODD = [
    (5, "one two,  three.\n\nfour", "x"), (None, "no id", "x"), (3, None, "x"), (3, "", "x"), (2, "it's <|endoftext|> here", "x"),
    (5, "one two,  three.\n\nfour", "y"), (-7, "word " * 30_000, "x"), (1 << 40, "é" * 5000, "x"),
]


def one_by_one(counts, capacity):
    """Shortest pack first over single pieces: a pack's sum, or new packs where nothing fits."""
    packs = []
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            fits = [i for i, p in enumerate(packs) if sum(p) + x <= capacity]
            if fits:
                best = min(fits, key=lambda i: sum(packs[i]))
                packs[best].append(x)
                left -= 1
            else:
                per = min(capacity // x, left)
                packs += [[x] * per for _ in range(left // per)]
                left %= per
    return Counter(tuple(sorted(p)) for p in packs)


def patterns_of(counts, capacity):
    found = Counter()
    for p in shortest_pack_first(counts, capacity):
        lengths, item = [], p.last
        while item:
            lengths.append(item.length)
            item = item.before
        assert sum(lengths) == capacity - p.gap
        found[tuple(sorted(lengths))] += p.n
    return found


HISTOGRAM = st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25)


@settings(max_examples=200, deadline=None)
@given(HISTOGRAM)
def test_pattern_sums_are_those_of_single_pieces(counts):
    def sums(patterns):
        return Counter({t: 0 for t in ()}) + sum((Counter({sum(p): n}) for p, n in patterns.items()), Counter())

    assert sums(patterns_of(counts, 40)) == sums(one_by_one(counts, 40))


@settings(max_examples=300, deadline=None)
@given(HISTOGRAM)
def test_every_id_is_placed_once_and_nothing_is_padded(counts):
    runs, slots = pack_histogram(counts, 40)
    used = {}
    for x, n in counts.items():
        for sequence, offset, stream in zip(*place(np.full(n, x), np.arange(n), runs)):
            parts = [(0, x, sequence, offset)] if sequence >= 0 else slot_parts(int(stream), x, slots)
            assert [p[0] for p in parts] + [x] == [0, *(p[1] for p in parts)]
            for lo, hi, sequence, offset in parts:
                used.setdefault(sequence, []).append((offset, hi - lo))
    totals = []
    for s in used.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        totals.append(at)
    short = [t for t in totals if t != 40]
    assert all(t & (t - 1) == 0 for t in short) and len(set(short)) == len(short) and sum(short) < 40


@pytest.mark.parametrize("factor", [1, 30, 900])
def test_patterns_do_not_grow_with_the_documents(factor):
    counts = {x: int(n) * factor for x, n in enumerate(np.random.default_rng(5).integers(0, 60, 257)) if x and n}
    runs, slots = pack_histogram(counts, 256)
    assert len(shortest_pack_first(counts, 256)) <= 2 * 256 and len(runs) < 256 * 16 and len(slots) < 256 * 2


def check(got, docs, capacity, end):
    encoded = Counter()
    for d, t in docs:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        encoded[(d, ids.tobytes())] += 1
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = Counter()
    for (d, ids), n in encoded.items():
        want[(d, len(ids) // 4)] += n
    for (d, n), have in pieces.items():
        starts = sorted(have)
        assert sum(x for _, x, _ in have) == n * want.pop((d, n))
        bodies = [ids for (own, ids), _ in encoded.items() if own == d and len(ids) == 4 * n]
        for start, x, crc in starts:
            assert any(zlib.crc32(b[4 * start : 4 * (start + x)]) == crc for b in bodies)
    assert not want
    for s in sequences.values():
        at = 0
        for offset, x in sorted(s):
            assert offset == at
            at += x
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op11_shortest_pack_first"](spark, sf).collect()
    check(got, docs, 2048, 1)
    starts = {}
    for r in got:
        starts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for s in starts.values():  # ids are unique here: pieces follow each other
        at = 0
        for start, x in sorted(s):
            assert start == at
            at += x


@pytest.mark.parametrize("end", [1, 70_000])
def test_odd_rows(spark, end):
    df = spark.createDataFrame(ODD, "doc_id long, text string, task string")  # the name of an inner column
    check(histogram_pack(df, path=BYTE, capacity=64, end_id=end).collect(), [(d, t) for d, t, _ in ODD], 64, end)
    assert histogram_pack(df.where("false"), path=BYTE).count() == 0
