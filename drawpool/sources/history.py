"""History sinks (A5-A7): per-round tables partitioned by ``iter``.

Writes use dynamic partition overwrite, so re-running a round replaces that
round's partition and nothing else: the update is idempotent, and a job
restarted after losing executors rewrites the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_iter(df: DataFrame, path: str, partition_cols=("iter",)) -> None:
    """Overwrite only the partitions present in ``df`` (per-write option, no
    session-wide setting is touched)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder exists (Hadoop FS, works for any shared FS)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_iter(spark: SparkSession, path: str, iter_: int, **parts) -> DataFrame:
    """One round's partition (plus optional sub-partitions such as
    ``split="corpus"``), listing only that folder; partition columns are kept
    through ``basePath``."""
    sub = "/".join([f"iter={iter_}"] + [f"{k}={v}" for k, v in parts.items()])
    return spark.read.option("basePath", path).parquet(f"{path}/{sub}")
