"""Manifest scan, accept/reject sinks and corpus summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupaudit.functions.scalars import absolute, stem
from groupaudit.schemas import MANIFEST, MANIFEST_CONTRACT


def check_contract(df: DataFrame, required=MANIFEST_CONTRACT) -> DataFrame:
    """Refuse a table without the required columns or without rows."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"manifest lacks required columns {missing}")
    if df.isEmpty():
        raise ValueError("manifest is empty")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest from CSV (all columns typed explicitly) or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        header = spark.read.option("header", True).csv(path).columns
        missing = sorted(set(MANIFEST_CONTRACT) - set(header))
        if missing:
            raise ValueError(f"manifest lacks required columns {missing}")
        fields = {f.name: f.dataType for f in MANIFEST.fields}
        raw = spark.read.option("header", True).csv(path)
        return raw.select(*[F.col(c).try_cast(fields[c]) .alias(c) if c in fields else F.col(c) for c in header])
    return spark.read.parquet(path)


def load_manifest(df: DataFrame, *, root: str) -> DataFrame:
    """Contract check, then absolute path and recording id."""
    check_contract(df)
    return df.withColumn("abs_path", absolute("path", root)).withColumn("recording_id", stem("path"))


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, failure rows) of one frame with a nullable ``reason``."""
    return outcomes.where("reason IS NULL").drop("reason"), outcomes.where("reason IS NOT NULL")


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    """Both sinks from one materialised frame, so the source is decoded once."""
    from groupaudit.session import materialise

    done = materialise(outcomes)
    accepted, rejected = split_outcomes(done)
    accepted.write.mode("overwrite").partitionBy("corpus").parquet(f"{path}/manifest")
    rejected.write.mode("overwrite").parquet(f"{path}/failures")


def conservation(outcomes: DataFrame, by: str) -> DataFrame:
    """found = decoded + failed per corpus, with the reasons counted."""
    return outcomes.groupBy(by).agg(
        F.count("*").alias("found"),
        F.count_if(F.col("reason").isNull()).alias("decoded"),
        F.count_if(F.col("reason").isNotNull()).alias("failed"),
        F.count_if(F.col("reason").contains("speaker_id")).alias("no_group_key"),
    )


def _count_map(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """JSON object of value -> count per corpus, over pre-aggregated counts."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("_n"))
    entry = F.struct(F.col(value).cast("string").alias("k"), F.col("_n").alias("v"))
    return counts.groupBy(by).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias(out)
    )


def corpus_summary(outcomes: DataFrame, *, by: str = "corpus") -> DataFrame:
    """One row per corpus over accepted units plus reject counts."""
    ok = outcomes.where("reason IS NULL")
    base = conservation(outcomes, by)
    stats = ok.groupBy(by).agg(
        F.round(F.sum("duration_s"), 2).alias("total_duration_s"),
        F.count_distinct("speaker_id").alias("n_speakers"),
        F.count_distinct("session_id").alias("n_sessions"),
        F.bool_and(F.col("speaker_id_provenance") == "participant").alias("disjoint_possible"),
        (F.count("sha256") - F.count_distinct("sha256")).alias("duplicate_sha256"),
    )
    return (
        base.join(stats, by, "left")
        .join(_count_map(ok, by, "label", "label_counts"), by, "left")
        .join(_count_map(ok, by, "speaker_id_provenance", "provenance_counts"), by, "left")
    )
