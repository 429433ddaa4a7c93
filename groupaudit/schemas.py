"""Fixed table contracts."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the recording manifest.
MANIFEST_REQUIRED = [
    "path", "corpus", "speaker_id", "session_id", "label",
    "sex", "age", "duration_s", "orig_format", "sha256",
]
MANIFEST_EXTRA = [
    "pathology", "task", "speaker_id_provenance", "orig_sample_rate", "src_sha256",
]

_NUMERIC = {
    "age": T.IntegerType(),
    "duration_s": T.DoubleType(),
    "orig_sample_rate": T.IntegerType(),
}

MANIFEST = T.StructType(
    [T.StructField(c, _NUMERIC.get(c, T.StringType())) for c in MANIFEST_REQUIRED + MANIFEST_EXTRA]
)

# Columns a manifest must carry before any stage may read it.
MANIFEST_CONTRACT = ("path", "speaker_id", "label")
