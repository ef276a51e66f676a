"""Annotation ledger fed by Structured Streaming.

New annotation files (idx, label, ts, seq, annotator) arrive in a folder;
``start_ledger_feed`` appends each micro-batch to the ledger table with
``foreachBatch``.  Every batch is written to its own ``batch_id`` partition
with dynamic overwrite, so a batch replayed after a failure rewrites the same
rows (exactly-once into the ledger).  The latest-label job (C6) stays a
batch job over the ledger; nothing per-id is kept in streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import latest_annotation
from ..sources.history import write_iter

LEDGER_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("annotator", T.LongType()),
])


def annotation_stream(spark: SparkSession, folder: str, schema: T.StructType = LEDGER_SCHEMA,
                      glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over parquet files of annotations."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def start_ledger_feed(stream: DataFrame, ledger_path: str, checkpoint: str, available_now: bool = True):
    """Append every micro-batch to the ledger; returns the StreamingQuery."""
    def append(batch: DataFrame, batch_id: int) -> None:
        write_iter(batch.withColumn("batch_id", F.lit(batch_id)), ledger_path, ("batch_id",))

    w = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_from_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """C6 over the streamed ledger."""
    return latest_annotation(spark.read.parquet(ledger_path).drop("batch_id"))
