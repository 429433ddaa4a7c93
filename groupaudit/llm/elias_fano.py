"""Token-id files whose document boundaries and ids are Elias-Fano sequences.

One file holds the documents of one ascending run of document ids::

    ids       all ids of all documents, 16 or 32 bits each, little-endian
    footer    two Elias-Fano sequences: document ids, and boundaries (0, end of doc 1, ...)
    trailer   footer length, number of null document ids, id width, magic

A sequence of n values up to u keeps the low log2(u / n) bits of each value packed, and the high
bits as a unary bit string: about 2 + log2(u / n) bits a value.  A sample of every 256th one bit is
the select structure: value i is found from its sample by looking at a few bytes.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupaudit.llm.common import small_batches, stored
from groupaudit.llm.unit_encoder import ids_crc32, worker_encoder
from groupaudit.session import scratch_path

MAGIC = b"EFTOKEN1"
SAMPLE = 256
HEAD = struct.Struct("<qqBQQI")  # n, base, low bits, bytes of low part, bytes of high part, samples
TRAILER = struct.Struct("<QQB8s")
FILE_DOCS, FILE_IDS = 65_536, 32_000_000  # a file is closed at either


class EliasFano:
    """A non-decreasing sequence of longs."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: Sequence[int]) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        base = int(values[0])
        v = np.asarray(values, dtype=np.int64).view(np.uint64) - np.array(base, dtype=np.int64).view(np.uint64)
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1) if int(v[-1]) >= n else 0
        bits = np.unpackbits(v.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - low_bits :]
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        high[ones] = 1
        return cls(n, base, low_bits, np.packbits(bits), np.packbits(high), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = HEAD.pack(self.n, self.base, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, base, low_bits, n_low, n_high, n_samples = HEAD.unpack_from(raw, at)
        at += HEAD.size
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(raw, "<u4", n_samples, at + n_low + n_high)
        return cls(n, base, low_bits, low, high, samples), at + n_low + n_high + 4 * n_samples

    def _select(self, i: int) -> int:
        """Position of the i-th one bit: from its sample onwards, some bytes at a time."""
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64])
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if rest < len(ones):
                return byte * 8 + int(ones[rest])
            rest, byte, skip = rest - len(ones), byte + 64, 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        lo, w = i * self.low_bits, self.low_bits
        bits = np.unpackbits(self.low[lo // 8 : (lo + w + 7) // 8])[lo % 8 : lo % 8 + w]
        low = int("".join(map(str, bits)) or "0", 2)
        out = self.base + (((self._select(i) - i) << w) | low)
        return out - (1 << 64) if out >= 1 << 63 else out

    def values(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1 as longs."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        w, first, last = self.low_bits, self._select(lo), self._select(hi - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : last // 8 + 1])) + first // 8 * 8
        ones = ones[(ones >= first) & (ones <= last)]
        start = lo * w
        bits = np.unpackbits(self.low[start // 8 : (hi * w + 7) // 8])[start % 8 : start % 8 + (hi - lo) * w].reshape(hi - lo, w)
        wide = np.zeros((hi - lo, 64), dtype=np.uint8)
        wide[:, 64 - w :] = bits
        low = np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
        v = ((ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(w)) | low
        return (v + np.array(self.base, dtype=np.int64).view(np.uint64)).view(np.int64)


class _File:
    """One file being written; ids go straight to storage, boundaries wait for the footer."""

    def __init__(self, folder: str, dtype: np.dtype):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.eft"  # a lost attempt leaves a file that no manifest names
        self.out = self.store.open_output_stream(f"{root}/{self.name}")
        self.width, self.ids, self.ends, self.nulls, self.n = dtype.itemsize, [], [0], 0, 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.ends.append(self.ends[-1] + len(raw) // self.width)
        self.n += 1
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        footer = EliasFano.encode(self.ids).to_bytes() + EliasFano.encode(self.ends).to_bytes()
        self.out.write(footer)
        self.out.write(TRAILER.pack(len(footer), self.nulls, self.width, MAGIC))
        self.out.close()
        return self.name, self.n, self.ends[-1]


class TokenFile:
    """A written file: random access to any document."""

    def __init__(self, folder: str, name: str):
        store, root = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        n_footer, self.nulls, width, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        raw = self.file.read_at(n_footer, size - TRAILER.size - n_footer)
        self.doc_ids, at = EliasFano.from_bytes(raw, 0)
        self.ends, _ = EliasFano.from_bytes(raw, at)
        self.dtype = np.dtype(f"<u{width}")

    def __len__(self) -> int:
        return self.ends.n - 1

    def doc(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """Id, start and token ids of document i of this file."""
        lo, hi, w = self.ends[i], self.ends[i + 1], self.dtype.itemsize
        own = self.doc_ids[i - self.nulls] if i >= self.nulls else None
        return own, lo, np.frombuffer(self.file.read_at((hi - lo) * w, lo * w), self.dtype)

    def blocks(self, rows: int = 1024) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """Ids, boundaries and concatenated token ids of ``rows`` documents at a time."""
        w = self.dtype.itemsize
        for lo in range(0, len(self), rows):
            hi = min(len(self), lo + rows)
            ends = self.ends.values(lo, hi + 1)
            ids: list[int | None] = [None] * max(0, min(hi, self.nulls) - lo)
            ids += self.doc_ids.values(max(0, lo - self.nulls), max(0, hi - self.nulls)).tolist()
            raw = self.file.read_at(int(ends[-1] - ends[0]) * w, int(ends[0]) * w)
            yield ids, ends, np.frombuffer(raw, self.dtype)


def write_token_files(
    docs: DataFrame, *, path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts, append ``end_id``, write files in ascending id order below ``folder``.

    Returns the manifest, stored: (file, run, part, n_docs, n_ids), one row per file; (run, part)
    ascends with the ids.  A null text counts as empty; null ids come first; rows that repeat an id
    stay, in order of their text; other columns are ignored.  An empty table gives no file.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(path)
        wide = encoder.dtype if end_id < 1 << (8 * encoder.dtype.itemsize) else np.dtype("<u4")
        end = np.array([end_id], wide).tobytes()
        run, part, out, done = TaskContext.get().partitionId(), 0, None, []
        for pdf in batches:
            for own, t in zip(pdf["id"], pdf["text"]):
                if out is None:
                    out = _File(folder, wide)
                raw = encoder.encode_one(t)
                raw = raw if wide == encoder.dtype else np.frombuffer(raw, encoder.dtype).astype(wide).tobytes()
                out.add(None if own is None or own != own else int(own), raw + end)
                if out.n >= FILE_DOCS or out.ends[-1] >= FILE_IDS:
                    done.append((run, part, *out.close()))
                    out, part = None, part + 1
        if out is not None:
            done.append((run, part, *out.close()))
        yield pd.DataFrame(done, columns=["run", "part", "file", "n_docs", "n_ids"])

    # ids travel as text: a nullable long would reach pandas as a float
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("text"))
        .repartitionByRange("k")
        .sortWithinPartitions("k", "text")
        .select(F.col("k").cast("string").alias("id"), "text")
    )
    return stored(ordered.mapInPandas(write, "run int, part int, file string, n_docs long, n_ids long"), "token-files")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32)."""
    spark = manifest.sparkSession
    before = Window.orderBy("run", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row per file

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, base in zip(pdf["file"], pdf["base"]):
                for own, ends, ids in TokenFile(folder, name).blocks():
                    local = ends - ends[0]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(own, dtype="Int64"),
                            "start": ends[:-1] + base,
                            "n_tokens": np.diff(ends),
                            "ids_crc32": [ids_crc32(ids[a:b]) for a, b in zip(local[:-1], local[1:])],
                        }
                    )

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(width, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(spark: SparkSession, docs: DataFrame, *, path: str, end_id: int) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    folder = scratch_path(spark, "eft")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_token_files(write_token_files(docs, path=path, end_id=end_id, folder=folder), folder)
