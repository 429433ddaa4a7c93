"""Raw recordings and metadata to a manifest with rejects: one plan, every input ends in one sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupaudit.functions import scalars as s
from groupaudit.operators import joins as j
from groupaudit.schemas import MANIFEST
from groupaudit.sources import audio


def ingest(files: DataFrame, metadata: DataFrame, *, corpus: str, provenance: str = "participant") -> DataFrame:
    """Manifest rows plus a nullable ``reason``.

    ``files`` has name and content; ``metadata`` has session, speaker, archive, pathology, sex,
    born and recorded, first row per session wins.  Files that cannot be attributed are rejected
    before any sample is decoded.
    """
    session, task, unnamed = s.session_and_task(s.stem("name"))
    named = files.select("name", "content", session.alias("session"), task.alias("task"), unnamed.alias("_early"))
    meta = j.first_per_key(metadata, key=["session"], order=["recorded", "speaker"])
    joined = j.enrich_with_reasons(named, meta, key="session", group="speaker", reason=F.col("_early"))
    decoded = audio.decode(joined.where("reason IS NULL")).select(
        "name", "orig_format", "orig_sample_rate", "duration_s", "sha256", "src_sha256", F.col("reason").alias("_bad")
    )
    rows = joined.drop("content").join(decoded, "name", "left")
    healthy = F.col("archive") == "healthy"
    columns = {
        "path": F.concat(F.lit(f"{corpus}/"), s.stem("name"), F.lit(".wav")),
        "corpus": F.lit(corpus),
        "speaker_id": s.namespaced(corpus, "speaker"),
        "session_id": s.namespaced(f"{corpus}_sess", "session"),
        "label": F.when(healthy, "healthy").when(~healthy, "pathological"),
        "sex": s.recode("sex", s.SEX_CODES),
        "age": s.age_floor(s.as_date("born"), s.as_date("recorded")),
        "pathology": s.blank_when(F.coalesce("pathology", "archive"), healthy),
        "speaker_id_provenance": F.lit(provenance),
    }
    reason = F.coalesce("reason", "_bad")
    return rows.select(
        "name", *[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in MANIFEST.fields], reason.alias("reason")
    )
