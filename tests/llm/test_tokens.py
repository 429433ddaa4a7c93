"""Token files, packing and token counts against the tokenizers library."""

import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groupaudit.llm import queries
from groupaudit.llm.best_fit import best_fit_pack, best_fit_runs
from groupaudit.llm.elias_fano import EliasFano, TokenFile, read_token_files, write_token_files
from groupaudit.llm.token_counts import count_text, token_counts, whole_tokens
from groupaudit.llm.unit_encoder import worker_encoder

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
WHOLE = whole_tokens(BYTE)
TEXTS = st.text(alphabet="abTHé \n\t.,'s3-<|>$ßİ ́あ😀\x1c\x00", max_size=40) | st.text(max_size=30)
ODD = [
    (5, "one two,  three.\n\nfour", "x"), (None, "no id", "x"), (3, None, "x"), (3, "", "x"), (2, "it's <|endoftext|> here", "x"),
    (5, "one two,  three.\n\nfour", "y"), (-7, "word " * 30_000, "x"), (1 << 40, "é" * 5000, "x"),
]
SCHEMA = "doc_id long, text string, id string"


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_units_give_the_librarys_ids(text):
    for path in (BYTE, WORD):
        encoder = worker_encoder(path)
        assert np.frombuffer(encoder.encode_one(text), encoder.dtype).tolist() == ids(path, text)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(text):
    assert count_text(text, BYTE, WHOLE) == len(ids(BYTE, text))


def test_whole_tokens_are_proven():
    assert len(WHOLE) > 40_000 and " the" in WHOLE and "\n" in WHOLE
    some = sorted(WHOLE)[::500]
    assert all(len(ids(BYTE, s)) == 1 for s in some)


def test_count_query_and_odd_rows(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_token_counts"](spark, sf).collect():
        n = len(ids(BYTE, docs[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 1024, len((docs[r["doc_id"]] or "").encode()))
    df = spark.createDataFrame(ODD, SCHEMA)
    got = token_counts(df, path=BYTE).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(ids(BYTE, t)) for _, t, _ in ODD)
    assert token_counts(df.where("false"), path=BYTE).count() == 0
    assert token_counts(df, path=PIECE).where("n_tokens = 0").count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=600) | st.lists(st.integers(0, 50), max_size=600))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    f, _ = EliasFano.from_bytes(EliasFano.encode(values).to_bytes(), 0)
    assert f.values(0, len(values)).tolist() == values
    for i in range(0, len(values), 37):
        assert f[i] == values[i] and f.values(i, min(len(values), i + 5)).tolist() == values[i : i + 5]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 3000, 100_000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 / len(values) < 14.5  # 11 + 2 bits and the samples


def expected_files(docs, end):
    out, start = [], 0
    for d, t in docs:
        i = np.array([*ids(BYTE, t), end], "<u4")
        out.append((d, start, len(i), zlib.crc32(i)))
        start += len(i)
    return out


def test_file_query_matches_the_library(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((tuple(r) for r in queries.QUERIES["op4_token_files"](spark, sf).collect()), key=lambda r: r[1])
    assert got == expected_files(docs, 2)


def test_files_of_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame(ODD, SCHEMA)
    manifest = write_token_files(df, path=BYTE, end_id=70_000, folder=folder)  # needs 32 bits
    docs = sorted(((d, t) for d, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    got = sorted((tuple(r) for r in read_token_files(manifest, folder).collect()), key=lambda r: r[1])
    assert got == expected_files(docs, 70_000)
    first = min(manifest.collect(), key=lambda r: (r["run"], r["part"]))
    own, start, tokens = TokenFile(folder, first["file"]).doc(0)
    assert (own, start, tokens.tolist()) == (None, 0, [*ids(BYTE, "no id"), 70_000])
    empty = write_token_files(df.where("false"), path=BYTE, end_id=2, folder=folder)
    assert empty.count() == 0 and read_token_files(empty, folder).count() == 0


def check_packing(got, docs, capacity):
    want = {}
    for d, t in docs:
        i = np.array([*ids(WORD, t), 0], "<u4")
        for p in range(0, len(i), capacity):
            part = i[p : p + capacity]
            want.setdefault((d, p // capacity, p, len(part), zlib.crc32(part)), []).append(1)
    have = {}
    for r in got:
        have.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
    assert have == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in got) / capacity


def test_packing_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, bound = check_packing(queries.QUERIES["op8_best_fit_packing"](spark, sf).collect(), docs, 2048)
    assert used <= bound + 1 + 0.01 * bound


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    check_packing(best_fit_pack(df, path=WORD, capacity=64).collect(), [(d, t) for d, t, _ in ODD], 64)
    assert best_fit_pack(df.where("false"), path=WORD).count() == 0


@pytest.mark.parametrize("factor", [1, 40])
def test_runs_do_not_grow_with_the_documents(factor):
    rng = np.random.default_rng(5)
    counts = {x: int(n) * factor for x, n in enumerate(rng.integers(0, 60, 129)) if x and n}
    runs = best_fit_runs(counts, 128)
    assert {x: sum(r[2] for r in runs if r[0] == x) for x in counts} == counts
    assert len(runs) < 128 * 12
    used = max(first + -(-n // per) for _, _, n, first, per, _ in runs)
    gaps = []  # one piece at a time, the largest first, each into the smallest gap that holds it
    opened = 0
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(gaps, x)
        opened += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else 128
        bisect.insort(gaps, gap - x)
    assert used <= opened
