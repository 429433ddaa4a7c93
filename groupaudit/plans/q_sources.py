"""Queries over sources and sinks.

Files these queries read are written by Spark from the driver tables into the shared folder.
"""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupaudit.functions import hashing as h
from groupaudit.plans import fixtures as fx
from groupaudit.plans.ingest import ingest
from groupaudit.plans.registry import query
from groupaudit.session import scratch_path
from groupaudit.sources import audio, manifest, tables
from groupaudit.streaming import incremental

_MANIFEST = """m AS (SELECT 'wav/' || event_type || '/' || event_id || '-' || user_id || '.wav' AS path, event_type AS corpus,
    'u_' || user_id AS speaker_id, CASE WHEN user_id % 3 = 0 THEN 'healthy' ELSE 'pathological' END AS label FROM events)"""


def event_manifest(spark, d):
    e = fx.table(spark, d, "events")
    return e.select(
        F.format_string("wav/%s/%d-%d.wav", "event_type", "event_id", "user_id").alias("path"),
        F.col("event_type").alias("corpus"),
        F.concat(F.lit("u_"), "user_id").alias("speaker_id"),
        F.when(F.col("user_id") % 3 == 0, "healthy").otherwise("pathological").alias("label"),
    )


@query(
    "s01_manifest_scan",
    f"""WITH {_MANIFEST} SELECT *, '/data/' || path AS abs_path, regexp_extract(path, '([^/]*)\\.wav$', 1) AS recording_id FROM m""",
)
def s01(spark, d):
    return manifest.load_manifest(event_manifest(spark, d), root="/data")


_OUTCOMES = """o AS (SELECT event_type AS corpus, 'u_' || user_id AS speaker_id, 's_' || (event_id // 4) AS session_id,
    CASE WHEN user_id % 3 = 0 THEN 'healthy' ELSE 'pathological' END AS label, value AS duration_s,
    CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'recording_proxy' ELSE 'participant' END AS speaker_id_provenance,
    sha256(CAST(value AS VARCHAR)) AS sha256,
    CASE WHEN event_id % 10 = 0 THEN 'absent from metadata -> no speaker_id' WHEN value < 5 THEN 'too short' END AS reason FROM events)"""


def outcomes(spark, d):
    e = fx.table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("corpus"),
        F.concat(F.lit("u_"), "user_id").alias("speaker_id"),
        F.concat(F.lit("s_"), F.floor(F.col("event_id") / 4)).alias("session_id"),
        F.when(F.col("user_id") % 3 == 0, "healthy").otherwise("pathological").alias("label"),
        F.col("value").alias("duration_s"),
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), "recording_proxy")
        .otherwise("participant")
        .alias("speaker_id_provenance"),
        F.sha2(F.col("value").cast("string"), 256).alias("sha256"),
        F.when(F.col("event_id") % 10 == 0, "absent from metadata -> no speaker_id")
        .when(F.col("value") < 5, "too short")
        .alias("reason"),
    )


@query(
    "s02_accept_reject",
    f"""WITH {_OUTCOMES} SELECT corpus, count(*) AS found, count(*) FILTER (reason IS NULL) AS decoded,
      count(*) FILTER (reason IS NOT NULL) AS failed, count(*) FILTER (reason LIKE '%speaker_id%') AS no_group_key FROM o GROUP BY 1""",
)
def s02(spark, d):
    """Both sinks are written from one frame and read back for the conservation count."""
    path = scratch_path(spark, "outcomes")
    manifest.write_outcomes(outcomes(spark, d), path)
    ok = spark.read.parquet(f"{path}/manifest").select("corpus").withColumn("reason", F.lit(None).cast("string"))
    bad = spark.read.parquet(f"{path}/failures").select("corpus", "reason")
    return manifest.conservation(ok.unionByName(bad), "corpus")


def _json_map(col: str) -> str:
    return f"""(SELECT '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' FROM
      (SELECT {col} AS k, count(*) AS n FROM o i WHERE i.reason IS NULL AND i.corpus = g.corpus GROUP BY 1))"""


@query(
    "s03_corpus_summary",
    f"""WITH {_OUTCOMES}, g AS (SELECT corpus, count(*) AS found, count(*) FILTER (reason IS NULL) AS decoded,
        count(*) FILTER (reason IS NOT NULL) AS failed, count(*) FILTER (reason LIKE '%speaker_id%') AS no_group_key,
        round(sum(duration_s) FILTER (reason IS NULL), 2) AS total_duration_s,
        count(DISTINCT speaker_id) FILTER (reason IS NULL) AS n_speakers, count(DISTINCT session_id) FILTER (reason IS NULL) AS n_sessions,
        bool_and(speaker_id_provenance = 'participant') FILTER (reason IS NULL) AS disjoint_possible,
        count(*) FILTER (reason IS NULL) - count(DISTINCT duration_s) FILTER (reason IS NULL) AS duplicate_sha256 FROM o GROUP BY 1)
    SELECT *, {_json_map('label')} AS label_counts, {_json_map('speaker_id_provenance')} AS provenance_counts FROM g""",
)
def s03(spark, d):
    return manifest.corpus_summary(outcomes(spark, d))


@query(
    "s04_csv_union",
    """SELECT 'nation' AS _archive, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, NULL::VARCHAR AS s_nationkey FROM nation
    UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name, NULL, NULL FROM region
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier""",
)
def s04(spark, d):
    path = scratch_path(spark, "csv")
    frames = {
        "nation": (",", [F.col("n_nationkey").alias("key"), F.col("n_name").alias(" name"), F.col("n_regionkey")]),
        "region": (";", [F.col("r_regionkey").alias("key"), F.concat(F.lit(" "), "r_name").alias("name")]),
        "supplier": (";", [F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey")]),
    }
    for name, (sep, cols) in frames.items():
        fx.table(spark, d, name).select(*cols).write.option("header", True).option("sep", sep).option(
            "ignoreLeadingWhiteSpace", False
        ).csv(f"{path}/{name}")
    out = tables.read_csv_union(spark, [f"{path}/{n}" for n in frames], archive=r"/([^/]*)/[^/]*$")
    return out.select("_archive", "key", "name", "n_regionkey", "s_nationkey")


@F.pandas_udf(T.BinaryType())
def _zip_document(doc_id: pd.Series, lang: pd.Series, text: pd.Series) -> pd.Series:
    out = []
    for i, g, t in zip(doc_id, lang, text):
        if i % 10 == 0:
            out.append(b"broken")
            continue
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("overview.csv", g)
            for k, line in enumerate(t.split("\n")):
                z.writestr(f"{i}-{g}/p{k}.wav", line)
        out.append(buf.getvalue())
    return pd.Series(out)


@query(
    "s05_archive_inventory",
    """WITH t AS (SELECT doc_id, lang, text, doc_id % 10 = 0 AS broken, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id || '.zip' AS archive, CASE WHEN NOT broken THEN CAST(strlen(lang) + strlen(text) - (len(lines) - 1) AS BIGINT) END AS n_bytes,
           CASE WHEN broken THEN 0 ELSE len(lines) + 1 END AS n_members, CASE WHEN broken THEN 0 ELSE len(lines) END AS n_media,
           CASE WHEN broken THEN 0 ELSE 1 END::BIGINT AS n_groups, NOT broken AS has_overview, broken AS failed FROM t""",
)
def s05(spark, d):
    docs = fx.table(spark, d, "documents")
    archives = docs.select(
        F.concat("doc_id", F.lit(".zip")).alias("archive"), _zip_document("doc_id", "lang", "text").alias("content")
    )
    inv = tables.archive_inventory(tables.archive_members(archives), ["wav", "nsp"])
    return inv.withColumn("failed", F.col("reason").isNotNull()).drop("reason")


@query(
    "s05_archive_files",
    """WITH t AS (SELECT 'b' || CAST(floor(doc_id / 50) AS BIGINT) || '.zip' AS archive, doc_id, lang, coalesce(text, '') AS text FROM documents)
    SELECT archive, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(*) AS n_members, count(*) FILTER (doc_id % 3 <> 0) AS n_media,
           count(DISTINCT doc_id) AS n_groups, false AS has_overview, NULL::VARCHAR AS reason FROM t GROUP BY archive""",
)
def s05_files(spark, d):
    docs = fx.table(spark, d, "documents")
    path = scratch_path(spark, "archives")
    members = docs.select(
        F.concat(F.lit("b"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit(".zip")).alias("archive"),
        F.concat("doc_id", F.lit("-"), "lang", F.lit("/a."), F.when(F.col("doc_id") % 3 != 0, "wav").otherwise("txt")).alias("member"),
        F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    )
    tables.write_archives(members, path).agg(F.sum("n_members")).collect()
    return tables.archive_inventory(tables.archive_members(tables.read_archives(spark, path)), ["wav", "nsp"])


@query(
    "s06_integrity",
    """SELECT 'p' || page_id AS name, CASE WHEN page_id % 10 = 9 THEN 'unexpected' WHEN page_id % 10 = 0 THEN 'missing' WHEN page_id % 10 = 1 THEN 'wrong_size'
       WHEN page_id % 10 = 2 THEN 'size_only' WHEN page_id % 10 = 3 AND html <> upper(html) THEN 'md5_mismatch' ELSE 'complete_verified' END AS status FROM pages""",
)
def s06(spark, d):
    p = fx.table(spark, d, "pages")
    k = F.col("page_id") % 10
    name = F.concat(F.lit("p"), "page_id").alias("name")
    listing = p.where(k != 9).select(
        name, F.octet_length("html").cast("bigint").alias("size"), F.when(k != 2, F.md5("html")).alias("md5")
    )
    body = F.when(k == 3, _flip_first("html")).when(k == 1, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    present = p.where(k != 0).select(name, F.octet_length(body).cast("bigint").alias("size"), F.md5(body).alias("md5"))
    return tables.integrity(listing, present)


def _flip_first(c: str):
    return F.overlay(c, F.lit("?"), 1, 1)


_RUNS = """r AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)"""


@query(
    "s07_artifact_ledger",
    f"""WITH {_RUNS} SELECT CASE WHEN user_id % 2 = 0 THEN 'benchmark' ELSE 'hypothesis' END AS kind, 'u_' || user_id AS corpus,
      CAST(n % 12 AS INTEGER) AS n_repeats, CAST(k AS INTEGER) AS n_folds, n AS n_recordings, k AS n_speakers,
      CASE WHEN user_id % 2 = 1 AND user_id % 5 = 0 THEN 'CONTROL' WHEN n % 12 >= 8 THEN 'EVALUATION' ELSE 'SCREENING' END AS tier,
      round(m, 4) AS headline, round(lo, 4) AS bar, round(m - lo, 4) AS delta, round(lo, 4) AS delta_lo, round(hi, 4) AS delta_hi,
      CASE WHEN user_id % 2 = 1 THEN 'CLAIM SUPPORTED' WHEN lo < 1 THEN 'NOT CLEARED' ELSE 'CLEARED' END AS verdict FROM r""",
)
def s07(spark, d):
    path = scratch_path(spark, "artifacts")
    runs = fx.table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("event_type").alias("k"),
        F.round(F.avg("value"), 4).alias("m"),
        F.round(F.min("value"), 4).alias("lo"),
        F.round(F.max("value"), 4).alias("hi"),
        F.round(F.avg("value") - F.min("value"), 4).alias("delta"),
    )
    corpus = F.concat(F.lit("u_"), "user_id").alias("corpus")
    repeats, folds = (F.col("n") % 12).cast("int"), F.col("k").cast("int")
    even = runs.where("user_id % 2 = 0").select(
        F.struct(corpus, repeats.alias("n_repeats"), folds.alias("n_folds")).alias("config"),
        F.struct(F.col("n").alias("n_recordings"), F.col("k").alias("n_speakers")).alias("dataset"),
        F.col("m").alias("headline"),
        F.col("lo").alias("bar"),
        F.struct("delta", "lo", "hi").alias("delta"),
        F.create_map(F.lit("logreg"), F.when(F.col("lo") < 1, "NOT CLEARED").otherwise("CLEARED_CONFOUND_BAR")).alias("verdicts"),
    )
    odd = runs.where("user_id % 2 = 1").select(
        corpus,
        repeats.alias("repeats"),
        folds.alias("folds"),
        F.col("n").alias("n_recordings"),
        F.col("k").alias("n_speakers"),
        (F.col("user_id") % 5 == 0).alias("shuffle_control"),
        F.col("m").alias("headline"),
        F.col("lo").alias("bar"),
        "delta",
        F.array("lo", "hi").alias("delta_ci95"),
        F.lit("CLAIM SUPPORTED").alias("verdict"),
    )
    even.write.json(f"{path}/bench")
    odd.write.json(f"{path}/study")
    ledger = tables.ledger_rows(
        tables.read_artifacts(spark, f"{path}/bench", tables.BENCH_ARTIFACT, lines=True),
        tables.read_artifacts(spark, f"{path}/study", tables.STUDY_ARTIFACT, lines=True),
    )
    return ledger.drop("artifact", "modified")


_CONFIG = """'{"corpus":"' || c_mktsegment || '","n_folds":5,"n_repeats":' || (c_custkey % 12) || ',"seed":0}'"""


@query(
    "s08_artifact_sink",
    f"""SELECT c_custkey, {_CONFIG} AS config_json, substr(sha256({_CONFIG}), 1, 16) AS config_hash FROM customer""",
)
def s08(spark, d):
    path = scratch_path(spark, "sink")
    c = fx.table(spark, d, "customer")
    out = tables.with_config_hash(
        c.select("c_custkey", "c_mktsegment"),
        {"n_repeats": F.col("c_custkey") % 12, "corpus": F.col("c_mktsegment"), "seed": F.lit(0), "n_folds": F.lit(5)},
    )
    tables.write_artifacts(out.drop("c_mktsegment"), path)
    return spark.read.schema("c_custkey bigint, config_json string, config_hash string").json(path)


@query(
    "s09_registry_tallies",
    """WITH ds AS (SELECT r_name AS family, CASE n_nationkey % 4 WHEN 0 THEN 'EVALUATION' WHEN 1 THEN 'SCREENING' WHEN 2 THEN 'BLOCKED' ELSE 'NEVER' END AS claim,
        n_nationkey % 7 = 0 AS new FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT 'claim' AS kind, claim AS value, count(*) AS n, count(*) FILTER (new) AS n_new FROM ds GROUP BY 2
    UNION ALL SELECT 'family', family, count(*), count(*) FILTER (new) FROM ds GROUP BY 2""",
)
def s09(spark, d):
    path = scratch_path(spark, "registry")
    claims = F.array(*[F.lit(v) for v in ("EVALUATION", "SCREENING", "BLOCKED", "NEVER")])
    n = fx.table(spark, d, "nation").withColumn("claim", F.element_at(claims, F.col("n_nationkey") % 4 + 1))
    ds = F.struct(F.col("n_name").alias("name"), "claim", F.lit("open").alias("access_tier"), (F.col("n_nationkey") % 7 == 0).alias("new"))
    fam = n.join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fam.groupBy(F.col("r_name").alias("id"), F.col("r_name").alias("name")).agg(F.collect_list(ds).alias("datasets")).write.json(path)
    return tables.registry_tallies(tables.registry_datasets(spark.read.schema(tables.REGISTRY).json(path)))


@query(
    "s10_incremental_extract",
    """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, 4::BIGINT AS first_batches, 0::BIGINT AS second_batches, 0::BIGINT AS n_remaining
    FROM events GROUP BY 1""",
)
def s10(spark, d):
    """Two runs over the same folder: the second finds nothing new."""
    base = scratch_path(spark, "incremental")
    events = fx.table(spark, d, "events")
    events.repartition(4).write.parquet(f"{base}/in")
    run = lambda: incremental.extract_new(
        spark,
        source=f"{base}/in",
        schema=events.schema,
        out=f"{base}/out",
        checkpoint=f"{base}/log",
        transform=lambda df: df.select("event_id", "event_type", "value"),
        files_per_batch=1,
    )
    first, second = run(), run()
    out = spark.read.parquet(f"{base}/out")
    left = incremental.remaining(events.select("event_id"), out, "event_id").agg(F.count("*")).scalar()
    return out.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.sum("value"), 2).alias("total"),
        F.lit(first).cast("bigint").alias("first_batches"),
        F.lit(second).cast("bigint").alias("second_batches"),
        left.alias("n_remaining"),
    )


@query(
    "s11_content_hash",
    f"""WITH {fx.FEATURES}, t AS (SELECT cls, sha256(concat_ws('|', recording_id, speaker_id, y)) AS digest FROM features),
      f AS ({h.order_free_digest_sql('t', 'digest', ['cls'])})
    SELECT cls, n_rows, substr(sha256(fingerprint || chr(10) || '{{"backbone":"given","max_seconds":30,"pooling":"mean"}}'), 1, 16) AS content_hash FROM f""",
)
def s11(spark, d):
    f = fx.features(spark, d).select("cls", F.sha2(F.concat_ws("|", "recording_id", "speaker_id", "y"), 256).alias("digest"))
    return tables.content_hash(f, digest="digest", policy={"pooling": "mean", "backbone": "given", "max_seconds": 30}, by=["cls"])


WAV_ROWS = 256  # recordings written at once


def _wav_of(vec_id: int, v) -> bytes:
    """A vector repeated to a 16-bit recording; every tenth is cut short, every tenth silent."""
    pcm = np.tile(np.clip(np.asarray(v, dtype=float) * 32767, -32768, 32767).astype("<i2"), 40)
    pcm = pcm[:400] if vec_id % 10 == 1 else pcm * (0 if vec_id % 10 == 2 else 1)
    data = pcm.astype("<i2").tobytes()
    rate = 50_000 if vec_id % 2 else 16_000
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body if vec_id % 10 != 3 else b"noise"


def _wav_files(vectors):
    """``name, content`` of ``name, vec_id, embedding``; files leave in small batches."""

    def write(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), WAV_ROWS):
                part = pdf.iloc[lo : lo + WAV_ROWS]
                yield pd.DataFrame({"name": part["name"], "content": [_wav_of(*f) for f in zip(part["vec_id"], part["embedding"])]})

    return vectors.select("name", "vec_id", "embedding").mapInPandas(write, "name string, content binary")


@query(
    "s12_audio_ingest",
    """WITH k AS (SELECT vec_id, CASE WHEN vec_id % 10 = 1 THEN 400 ELSE 64 * 40 END AS n, vec_id % 2 = 1 AS odd FROM embeddings)
    SELECT 'v' || vec_id AS name, CASE WHEN vec_id % 10 <> 3 THEN CASE WHEN odd THEN 50000 ELSE 16000 END END AS orig_sample_rate,
           CASE WHEN vec_id % 10 <> 3 THEN CAST(CASE WHEN odd THEN ceil(n * 8 / 25) ELSE n END AS INTEGER) END AS n_samples,
           CASE vec_id % 10 WHEN 1 THEN 'too short (0.008s)' WHEN 2 THEN 'digital silence' WHEN 3 THEN 'not a RIFF/WAVE file'
                ELSE CASE WHEN odd THEN 'too short (0.051s)' END END AS reason FROM k""",
)
def s12(spark, d):
    files = _wav_files(fx.table(spark, d, "embeddings").withColumn("name", F.concat(F.lit("v"), "vec_id")))
    return audio.decode(files).select("name", "orig_sample_rate", "n_samples", "reason")


_INGEST = """v AS (SELECT vec_id, label, 1000 + vec_id AS session, CASE WHEN vec_id % 17 = 0 THEN 'x' ELSE '' END || (1000 + vec_id) || '-a_h.wav' AS name FROM embeddings),
  m AS (SELECT 1000 + vec_id AS session, CASE WHEN vec_id % 23 = 0 THEN NULL ELSE label * 100 + vec_id % 6 END AS speaker, vec_id % 3 = 0 AS healthy, vec_id % 2 = 0 AS w FROM embeddings WHERE vec_id % 19 <> 0)"""


@query(
    "s12_ingest_to_manifest",
    f"""WITH {_INGEST} SELECT name, 'syn_' || speaker AS speaker_id, CASE WHEN healthy THEN 'healthy' WHEN NOT healthy THEN 'pathological' END AS label,
      CASE WHEN w THEN 'F' WHEN NOT w THEN 'M' ELSE '' END AS sex, CASE WHEN m.session IS NOT NULL THEN 40 END::INTEGER AS age,
      CASE WHEN vec_id % 17 = 0 THEN 'no session number before the first hyphen of the name' WHEN m.session IS NULL THEN 'absent from metadata -> no speaker_id'
           WHEN speaker IS NULL THEN 'null speaker_id' WHEN vec_id % 10 = 1 THEN 'too short (0.008s)' WHEN vec_id % 10 = 2 THEN 'digital silence'
           WHEN vec_id % 10 = 3 THEN 'not a RIFF/WAVE file' WHEN vec_id % 2 = 1 THEN 'too short (0.051s)' END AS reason
    FROM v LEFT JOIN m ON v.session = m.session AND vec_id % 17 <> 0""",
)
def s12_ingest(spark, d):
    """Vectors as recordings joined with session metadata: accepted rows and every kind of reject."""
    e = fx.table(spark, d, "embeddings")
    name = F.concat(F.when(F.col("vec_id") % 17 == 0, "x").otherwise(""), F.col("vec_id") + 1000, F.lit("-a_h.wav"))
    files = _wav_files(e.withColumn("name", name))
    meta = e.where("vec_id % 19 <> 0").select(
        (F.col("vec_id") + 1000).alias("session"),
        F.when(F.col("vec_id") % 23 != 0, F.col("label") * 100 + F.col("vec_id") % 6).alias("speaker"),
        F.when(F.col("vec_id") % 3 == 0, "healthy").otherwise("Polyp").alias("archive"),
        F.lit(None).cast("string").alias("pathology"),
        F.when(F.col("vec_id") % 2 == 0, "w").otherwise("m").alias("sex"),
        F.lit("1960-03-01").alias("born"),
        F.lit("2000-09-01").alias("recorded"),
    )
    return ingest(files, meta, corpus="syn").select("name", "speaker_id", "label", "sex", "age", "reason")
