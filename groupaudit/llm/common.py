"""Shared by the operators: table access, batch size, shared-folder tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from groupaudit.session import scratch_path

BATCH_ROWS = 256  # documents of one Arrow batch: with very long texts still some tens of MB


def apart(name: str, columns: Sequence[str]) -> str:
    """``name``, or a longer one if a column is called so already (names do not differ by case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are counted in rows; whole texts need fewer rows than the default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing will read again."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once below the shared folder and read back: lineage is cut, columns can be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
