"""Session helpers: recommended settings and the shared state folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators are written for.  AQE re-plans joins at runtime
# (broadcast only what turned out small, split skewed partitions) and
# coalesces the many small shuffle partitions of K-row tables.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def cluster_conf(input_bytes: int, total_cores: int, target_partition_mb: int = 512) -> dict:
    """Partition sizing for a large cluster.

    Scans: ``maxPartitionBytes`` of ~512 MB keeps the task count of a 100 TB
    read near 200k instead of ~800k at the 128 MB default, while a task's
    input still fits executor memory with room for decompression.  Shuffles:
    start from enough partitions that each holds ~256 MB of the input volume
    (at least 3 waves of all cores) and let AQE coalesce toward the advisory
    size; skewed partitions above 5x the median are split by AQE skew join."""
    mb = 1024 * 1024
    target = max(64, int(target_partition_mb)) * mb
    shuffle = max(3 * total_cores, input_bytes // (256 * mb))
    return {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        **RECOMMENDED_CONF,
    }


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "drawpool", extra: dict | None = None) -> SparkSession:
    """A session for tests and local runs.  On a cluster, pass the
    cluster's own session to the operators instead."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster names it; we only pick our own when it is unset, which
    happens in local tests.  Every piece of round state is written below it,
    so lost executors never lose lineage we depend on.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # one machine only: the setting is static, so use the context's own
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="drawpool-ckpt-"))
    return sc.getCheckpointDir()


def state_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "drawpool", *parts])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed: its
    place goes on their path, as in local runs from another folder."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def materialize(df, name: str):
    """Write ``df`` below the shared folder and read it back: the lineage ends
    there, and every reader sees the same rows."""
    path = state_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_run_id() -> str:
    return f"run-{os.getpid()}-{uuid.uuid4().hex[:10]}"
