"""Binary recordings to PCM, a slice of an Arrow batch at a time."""

from __future__ import annotations

import hashlib
import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupaudit.functions.arrays import quality_flag

TARGET_RATE = 16_000
SLICE_BYTES = 1 << 20  # files decoded at once: their samples take several times as much
DECODED = (
    "name string, orig_format string, orig_sample_rate int, n_samples int, duration_s double, "
    "pcm array<float>, sha256 string, src_sha256 string, reason string"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}
_ARROW = pa.schema([(c, _TYPES[t]) for c, t in (f.split() for f in DECODED.split(", "))])


class DecodeError(ValueError):
    pass


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1) of a 16-bit PCM file."""
    try:
        with wave.open(io.BytesIO(raw)) as f:
            channels, width, rate = f.getnchannels(), f.getsampwidth(), f.getframerate()
            data = f.readframes(f.getnframes())
    except (wave.Error, EOFError) as e:
        raise DecodeError("not a RIFF/WAVE file" if raw[:4] != b"RIFF" else f"unreadable file: {e}") from e
    if width != 2:
        raise DecodeError(f"{8 * width} bits a sample; 16 are read")
    frames = np.frombuffer(data, "<i2", len(data) // (2 * channels) * channels).reshape(-1, channels)
    return rate, (frames.mean(axis=1) / 32768.0).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """Rational-ratio resampling with a windowed-sinc low-pass, evaluated per output phase."""
    if rate == target:
        return x.astype(np.float32)
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    cutoff = 1.0 / max(up, down)
    taps = cutoff * np.sinc(cutoff * t) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n_out = -(-len(x) * up // down)
    pos = np.arange(n_out, dtype=np.int64) * down  # position on the upsampled grid
    out = np.zeros(n_out)
    for phase in range(up):
        sel = np.nonzero(pos % up == phase)[0]
        base = pos[sel] // up
        acc = np.zeros(len(sel))
        # taps that meet an input sample at this phase: t = phase (mod up)
        for o in np.nonzero(t % up == phase)[0]:
            idx = base - (t[o] - phase) // up
            ok = (idx >= 0) & (idx < len(x))
            acc[ok] += taps[o] * x[idx[ok]]
        out[sel] = acc
    return out.astype(np.float32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most SLICE_BYTES of content, one file at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["content"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(ends):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decoded rows slice by slice: of a whole batch only the files are held, never the samples."""
    for batch in _slices(batches):
        rows = []
        for name, content in zip(batch["name"].to_pylist(), batch["content"]):
            raw = content.as_py()
            row = {"name": name, "orig_format": "wav", "src_sha256": hashlib.sha256(raw).hexdigest()}
            try:
                row["orig_sample_rate"], x = decode_wav(raw)
                y = resample(x, row["orig_sample_rate"])
                row |= {"n_samples": len(y), "duration_s": round(len(y) / TARGET_RATE, 4), "pcm": y, "sha256": hashlib.sha256(y.tobytes()).hexdigest()}
            except DecodeError as e:
                row["reason"] = str(e)
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def decode(files: DataFrame) -> DataFrame:
    """``name, content`` to decoded recordings; a failure keeps its row and a reason.

    A signal that can be read but not used has its reason from ``quality_flag`` and no samples.
    """
    read = files.select("name", "content").mapInArrow(_decode, DECODED)
    reason = F.coalesce("reason", F.when(F.col("pcm").isNotNull(), quality_flag("pcm", TARGET_RATE)))
    return read.withColumn("reason", reason).withColumn("pcm", F.when(F.col("reason").isNull(), F.col("pcm")))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
