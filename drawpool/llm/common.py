"""Shared pieces of the operators: written tables, bounded bitmaps, input columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawpool.session import ensure_checkpoint_dir

#: Bits of a membership bitmap; 2 MB whatever the data size.
BITMAP_BITS = 1 << 24
#: Bits that Spark's bitmap functions put in one bucket (fixed by Spark).
BUCKET_BITS = 32768

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed: its
    place goes on their path, as in local runs from another folder.  Where the
    session sets no bound of its own, a worker's batch ends after 4 MB, so that
    rows of long texts don't add up; one row is never divided."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, so a lost executor repeats only the stage at hand."""
    importable(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits over the low bits of a BIGINT hash column.

    The driver gets ``bits / 8`` bytes at most, however many keys there are;
    a full bitmap lets every row pass, and the exact join after it decides."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = (keys.where(F.col(column).isNotNull())
            .groupBy(F.bitmap_bucket_number(slot).alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect())
    out = np.zeros(bits // 8 + BUCKET_BITS // 8, np.uint8)
    for r in rows:
        # bucket b > 0 holds slots (b-1)*32768 + 1 ... b*32768; bucket 0 holds slot 0
        lo = int(r["b"]) * (BUCKET_BITS // 8)
        m = np.frombuffer(r["m"], np.uint8)
        out[lo:lo + len(m)] |= m
    return out


def in_bitmap(marks: np.ndarray, hashes: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which of the int64 ``hashes`` may be among the keys of ``bitmap``."""
    slot = (hashes.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    bucket = (slot > 0) * (1 + (slot - 1) // BUCKET_BITS)
    at = np.where(slot > 0, (slot - 1) % BUCKET_BITS, 0)
    return (marks[bucket * (BUCKET_BITS // 8) + at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1


def row_ids(start: int, n: int) -> np.ndarray:
    """Ids of rows ``start ...`` of this task's partition, unique over partitions.
    They are stable once the table that holds them is written."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return (np.int64(ctx.partitionId() if ctx else 0) << 40) + np.arange(start, start + n, dtype=np.int64)


def _trim():
    """The C library's call that gives free heap pages back, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Return this process's unused memory to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable) -> Callable:
    """``run`` (batches to batches) in a worker that gives unused memory back
    after each batch: Spark keeps workers for the tasks and stages that follow."""
    def out(batches):
        for b in run(batches):
            yield b
            del b
            give_back()
    return out


def batches_of(columns: dict[str, pa.Array | np.ndarray], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (columns[f.name] for f in schema)]
    arrays = [(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(f.type) for a, f in zip(arrays, schema)]
    n = len(arrays[0])
    for lo in range(0, n, size):
        yield pa.RecordBatch.from_arrays([a.slice(lo, size) for a in arrays], schema=schema)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """A list array from flat values and n+1 bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
