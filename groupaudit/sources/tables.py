"""File-level sources: mixed CSV, archives, integrity, registries, artifacts, feature tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupaudit.functions.arrays import all_finite
from groupaudit.functions.hashing import canonical_json, order_free_digest, short_sha256
from groupaudit.functions.scalars import MEMBER_GROUP_PATTERN
from groupaudit.sources.ranged import first_line, opened, write_whole


# --- CSV with changing columns and delimiters ---------------------------------


FILE_STEM = r"([^/]*?)(?:\.[^./]*)?$"


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "header": pdf["path"].map(first_line)})


def read_csv_union(
    spark: SparkSession, paths: Sequence[str], delimiters: Sequence[str] = (";", ","), archive: str = FILE_STEM
) -> DataFrame:
    """Many CSV files with their own columns and delimiter, unioned by name.

    Of every file only the first block is read to know its header.
    The header line decides the delimiter (the one that occurs most); files that share a
    header are read by one scan.  Names and values are trimmed; ``_archive`` is cut from the path.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path")
    groups: dict[tuple[str, str], list[str]] = {}
    for row in files.mapInPandas(_headers, "path string, header string").where("header <> ''").toLocalIterator():  # headers only
        sep = max(delimiters, key=row["header"].count)
        groups.setdefault((sep, row["header"]), []).append(row["path"])
    out = None
    for (sep, _), files in sorted(groups.items()):
        raw = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(files)
        cols = [F.trim(F.col(f"`{c}`")).alias(c.replace("﻿", "").strip()) for c in raw.columns]
        part = raw.select(*cols, F.regexp_extract("_metadata.file_path", archive, 1).alias("_archive"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no CSV files")
    return out


# --- archives ------------------------------------------------------------------

MEMBERS = "archive string, member string, extension string, group_key string, n_bytes long, reason string"


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group = re.compile(MEMBER_GROUP_PATTERN)
    for pdf in batches:
        rows = []
        inputs = zip(pdf["archive"], pdf["content"].map(io.BytesIO) if "content" in pdf else pdf["path"].map(opened))
        for name, file in inputs:
            try:
                with file, zipfile.ZipFile(file) as z:  # reads the directory at the end, no member
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        last = info.filename.rsplit("/", 1)[-1]
                        ext = last.rsplit(".", 1)[-1].lower() if "." in last else ""
                        hit = group.search(info.filename)
                        rows.append((name, info.filename, ext, hit and hit.group(1), info.file_size, None))
            except (zipfile.BadZipFile, pa.ArrowInvalid) as e:  # the latter for a file shorter than a directory's end
                rows.append((name, None, None, None, None, f"unreadable archive: {e}"))
        yield pd.DataFrame(rows, columns=["archive", "member", "extension", "group_key", "n_bytes", "reason"])


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per member of each archive, unreadable ones with a reason.

    ``archives`` has ``archive`` and either ``path``, of which tasks read the end only, or ``content``.
    """
    source = "path" if "path" in archives.columns else "content"
    return archives.select("archive", source).mapInPandas(_list_members, MEMBERS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path) of the archives below a path; the files themselves are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("archive"), "path")


def write_archives(members: DataFrame, path: str) -> DataFrame:
    """Pack (archive, member, content) into one file of each archive below a path; returns (archive, n_members).

    Members stand in order of their names.  A task holds one archive; a file appears under its name only when it
    is whole, so that a task can be run again.  The result must be consumed once.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["archive"].iloc[0]
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for member, content in sorted(zip(pdf["member"], pdf["content"])):
                z.writestr(zipfile.ZipInfo(member), content)
        write_whole(f"{path}/{name}", buf.getvalue())
        return pd.DataFrame({"archive": [name], "n_members": [len(pdf)]})

    return members.select("archive", "member", "content").groupBy("archive").applyInPandas(pack, "archive string, n_members long")


def archive_inventory(members: DataFrame, media: Sequence[str]) -> DataFrame:
    """Per archive: bytes, members, media members, distinct groups, overview flag."""
    return members.groupBy("archive").agg(
        F.sum("n_bytes").alias("n_bytes"),
        F.count("member").alias("n_members"),
        F.count_if(F.col("extension").isin(list(media))).alias("n_media"),
        F.count_distinct("group_key").alias("n_groups"),
        F.bool_or(F.coalesce(F.lower("member").contains("overview"), F.lit(False))).alias("has_overview"),
        F.max("reason").alias("reason"),
    )


# --- integrity -----------------------------------------------------------------


def present_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and MD5 of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5")
    )


def integrity(listing: DataFrame, present: DataFrame) -> DataFrame:
    """Outcome of every listed or present file: size first, checksum when one is published."""
    a = listing.select("name", F.col("size").alias("_size"), F.col("md5").alias("_md5"), F.lit(True).alias("_listed"))
    b = present.select("name", "size", "md5", F.lit(True).alias("_present"))
    status = (
        F.when(F.col("_listed").isNull(), "unexpected")
        .when(F.col("_present").isNull(), "missing")
        .when(F.col("size") != F.col("_size"), "wrong_size")
        .when(F.col("_md5").isNull(), "size_only")
        .when(F.col("md5") != F.col("_md5"), "md5_mismatch")
        .otherwise("complete_verified")
    )
    return a.join(b, "name", "full").select("name", status.alias("status"))


# --- artifacts -----------------------------------------------------------------

# Fields each artifact kind carries.
BENCH_ARTIFACT = (
    "kind string, config struct<corpus:string, n_repeats:int, n_folds:int>, "
    "dataset struct<n_recordings:long, n_speakers:long>, best_head string, "
    "headline double, bar double, bar_name string, "
    "delta struct<delta:double, lo:double, hi:double>, verdicts map<string,string>, config_hash string"
)
STUDY_ARTIFACT = (
    "kind string, corpus string, repeats int, folds int, n_recordings long, n_speakers long, "
    "shuffle_control boolean, headline double, bar double, delta double, delta_ci95 array<double>, verdict string"
)

LEDGER = (
    "artifact", "kind", "corpus", "n_repeats", "n_folds", "n_recordings", "n_speakers",
    "tier", "headline", "bar", "delta", "delta_lo", "delta_hi", "verdict",
)


def read_artifacts(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """JSON artifacts of one kind under a fixed schema, with file name and time."""
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return raw.select(
        "*",
        F.col("_metadata.file_name").alias("artifact"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def ledger_rows(bench: DataFrame | None = None, study: DataFrame | None = None) -> DataFrame:
    """Artifacts of several kinds as one row shape."""
    from groupaudit.functions.scalars import evidence_tier

    parts = []
    extra = lambda df: [c for c in ("modified", "key") if c in df.columns]
    if bench is not None:
        n = F.col("config.n_repeats")
        blocked = F.exists(F.map_values("verdicts"), lambda v: v.contains("NOT"))
        parts.append(
            bench.select(
                "artifact", F.lit("benchmark").alias("kind"), "config.corpus", n.alias("n_repeats"),
                "config.n_folds", "dataset.n_recordings", "dataset.n_speakers", evidence_tier(n).alias("tier"),
                "headline", "bar", "delta.delta", F.col("delta.lo").alias("delta_lo"), F.col("delta.hi").alias("delta_hi"),
                F.when(blocked, "NOT CLEARED").otherwise("CLEARED").alias("verdict"), *extra(bench),
            )
        )
    if study is not None:
        n = F.coalesce(F.col("repeats"), F.lit(0))
        parts.append(
            study.select(
                "artifact", F.lit("hypothesis").alias("kind"), "corpus", n.alias("n_repeats"),
                F.col("folds").alias("n_folds"), "n_recordings", "n_speakers",
                evidence_tier(n, F.coalesce("shuffle_control", F.lit(False))).alias("tier"),
                "headline", "bar", "delta", F.get("delta_ci95", F.lit(0)).alias("delta_lo"),
                F.get("delta_ci95", F.lit(1)).alias("delta_hi"), "verdict", *extra(study),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_config_hash(df: DataFrame, config: Mapping[str, Column]) -> DataFrame:
    """Adds the canonical config text and the first 16 digits of its SHA-256."""
    text = canonical_json(list(config.items()))
    return df.withColumn("config_json", text).withColumn("config_hash", short_sha256(text))


def write_artifacts(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


# --- nested registry -----------------------------------------------------------

REGISTRY = (
    "id string, name string, datasets array<struct<name:string, claim:string, access_tier:string, new:boolean>>"
)


def registry_datasets(families: DataFrame) -> DataFrame:
    return families.select(F.col("id").alias("family"), F.explode("datasets").alias("_d")).select("family", "_d.*")


def registry_tallies(datasets: DataFrame) -> DataFrame:
    """Datasets per claim tier and per family, and how many are new."""
    is_new = F.count_if(F.coalesce("new", F.lit(False))).alias("n_new")
    parts = [
        datasets.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("n"), is_new)
        for kind, c in (("claim", "claim"), ("family", "family"))
    ]
    return parts[0].unionByName(parts[1])


# --- content-addressed feature table -------------------------------------------


def content_hash(df: DataFrame, *, digest: str, policy: Mapping[str, str | int], by: Sequence[str] = ()) -> DataFrame:
    """Key of a feature table: digest of its sources joined with the extraction policy."""
    policy_text = canonical_json([(k, F.lit(v)) for k, v in policy.items()])
    fp = order_free_digest(df, digest, by)
    return fp.select(
        *by, "n_rows", short_sha256(F.concat_ws("\n", "fingerprint", policy_text)).alias("content_hash")
    )


def write_features(features: DataFrame, path: str, key: str) -> bool:
    """Append a partition ``content_hash=key`` unless it exists; False when reused."""
    if "speaker_id" not in features.columns:
        raise ValueError("feature table has no speaker_id: splits by group are impossible")
    spark = features.sparkSession
    target = f"{path}/content_hash={key}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return False
    features.write.mode("overwrite").parquet(target)
    return True


def load_features(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Features of one key by partition pruning, checked before use."""
    df = spark.read.parquet(path).where(F.col("content_hash") == key)
    if "speaker_id" not in df.columns:
        raise ValueError("feature table has no speaker_id: splits by group are impossible")
    if "features" in df.columns and not df.where(~all_finite("features")).isEmpty():
        raise ValueError("feature table holds missing or non-finite values")
    return df
