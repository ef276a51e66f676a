"""Current label and prediction of every id as keyed streaming state (C6, K5),
and evaluation kept up to date by retraction (D3-D8, A5).

Annotations and predictions arrive as events in any order, late or repeated.
The state of an id is its latest annotation, by (ts, seq), and its latest
prediction, by round; an event that is not newer changes nothing.  What a feed
changed goes on as rows (old label, new label, old prediction, new
prediction), and those become signed counts of the confusion table: minus one
in the old cell, plus one in the new.  Metrics after a revision are sums of
these counts; scored rows and the ledger are never read again, so a feed costs
the buckets that it touches.

Events of one id are reduced to the newest where they are read, before the
exchange, so an id with a third of all events is no task's burden.  The state is
kept by buckets of ids, each with one value and one frame of changes a batch:
what Spark spends on a key is paid for a bucket, not for an id.  Each
micro-batch writes its own ``batch_id`` partition with dynamic overwrite: one
that is replayed after a failure writes the same rows again, and a restarted
query goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..session import importable
from ..sources.history import write_iter

EVENT_SCHEMA = "idx bigint, kind string, value string, major bigint, minor bigint"
#: Groups of ids that the state is kept by.  A checkpoint holds this number: another one needs a new folder.
BUCKETS = 1 << 10
#: An event without a time is older than any.
NEVER = -1 << 62
_READ = "known boolean, idx bigint, kind string, value string, major bigint, minor bigint"
_ARROW = pa.schema([("known", pa.bool_()), ("idx", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("major", pa.int64()), ("minor", pa.int64())])
#: A JSON list of [id, label, ts, seq, has_label, pred, round, has_pred], one for each id of the bucket.
STATE_SCHEMA = "ids string"
CHANGE_SCHEMA = "idx bigint, old_label string, new_label string, had_label boolean, has_label boolean, old_pred string, new_pred string, had_pred boolean, has_pred boolean"
_CHANGES = ["idx", "old_label", "new_label", "had_label", "has_label", "old_pred", "new_pred", "had_pred", "has_pred"]
_NEW = (None, None, None, False, None, None, False)


def annotation_events(ledger: DataFrame) -> DataFrame:
    """Events of a ledger (idx, label, ts, seq)."""
    return ledger.select(F.col("idx").cast("bigint").alias("idx"), F.lit("label").alias("kind"), F.col("label").cast("string").alias("value"),
                         F.unix_micros(F.col("ts").cast("timestamp")).alias("major"), F.col("seq").cast("bigint").alias("minor"))


def prediction_events(scored: DataFrame, round_: int) -> DataFrame:
    """Events of a round's scored rows (idx, pred)."""
    return scored.select(F.col("idx").cast("bigint").alias("idx"), F.lit("pred").alias("kind"), F.col("pred").cast("string").alias("value"),
                         F.lit(round_).cast("bigint").alias("major"), F.lit(0).cast("bigint").alias("minor"))


def feed(events: DataFrame, folder: str) -> None:
    """Add event files to the folder of a stream."""
    events.write.mode("append").parquet(folder)


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest event of each (id, kind) of a batch of rows."""
    for b in batches:
        rows = b.to_pandas().sort_values(["major", "minor"], kind="stable")
        yield pa.RecordBatch.from_pandas(rows.drop_duplicates(["known", "idx", "kind"], keep="last"), schema=_ARROW, preserve_index=False)


def _update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The ids of a bucket: one state and one frame of changes for all of them."""
    old = {i: tuple(now) for i, *now in json.loads(state.get[0])} if state.exists else {}
    new = {}
    for frame in frames:
        for known, i, kind, value, major, minor in zip(*(frame[c].tolist() for c in _ARROW.names)):
            i = i if known else None
            now = new.get(i) or old.get(i, _NEW)
            if kind == "label" and (not now[3] or (major, minor) > now[1:3]):
                new[i] = (None if pd.isna(value) else value, major, minor, True, *now[4:])
            elif kind == "pred" and (not now[6] or major > now[5]):
                new[i] = (*now[:4], None if pd.isna(value) else value, major, True)
    if not new:
        return
    state.update((json.dumps([(i, *now) for i, now in (old | new).items()]),))
    rows = [(i, was[0], now[0], was[3], now[3], was[4], now[4], was[6], now[6]) for i, now in new.items()
            if (was := old.get(i, _NEW))[0] != now[0] or was[3] != now[3] or was[4] != now[4] or was[6] != now[6]]
    if rows:
        out = pd.DataFrame(rows, columns=_CHANGES, dtype=object)
        yield out.assign(idx=pd.array([r[0] for r in rows], "Int64"))


def changes(events: DataFrame) -> DataFrame:
    """The changes that a stream of events makes to the state."""
    whole = events.select(F.col("idx").isNotNull().alias("known"), F.coalesce("idx", F.lit(0).cast("bigint")).alias("idx"), "kind", "value",
                          *(F.coalesce(c, F.lit(NEVER).cast("bigint")).alias(c) for c in ("major", "minor")))   # without nulls no number becomes a double
    dealt = whole.mapInArrow(_newest, _READ).withColumn("bucket", F.pmod(F.xxhash64("known", "idx"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(_update, CHANGE_SCHEMA, STATE_SCHEMA, "update", "NoTimeout")


def signed_cells(change: DataFrame) -> DataFrame:
    """(gold, pred, n): minus one for the cell that an id leaves, plus one for
    the cell that it enters.  An id without a label or a prediction has none."""
    cell = lambda at, label, pred, n: F.when(at, F.struct(F.col(label).alias("gold"), F.col(pred).alias("pred"), F.lit(n).alias("n")))
    both = F.array_compact(F.array(cell(F.col("had_label") & F.col("had_pred"), "old_label", "old_pred", -1),
                                   cell(F.col("has_label") & F.col("has_pred"), "new_label", "new_pred", 1)))
    return change.select(F.explode(both).alias("c")).groupBy("c.gold", "c.pred").agg(F.sum("c.n").alias("n")).where("n <> 0")


class LabelState:
    """State kept below ``base``: ``events`` (the folder that is read),
    ``changes`` and ``cells`` by batch, and the stream's checkpoint."""

    def __init__(self, spark: SparkSession, base: str, max_files_per_trigger: int | None = None):
        importable(spark)
        self.spark, self.base, self.max_files = spark, base, max_files_per_trigger

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def add(self, events: DataFrame) -> None:
        feed(events, self.path("events"))

    def advance(self) -> None:
        """Take in what was added since the last call, also after a restart."""
        def write(batch: DataFrame, batch_id: int) -> None:
            # both writes overwrite this batch's partition: the change rows first, then their counts from the written rows
            write_iter(batch.withColumn("batch_id", F.lit(batch_id)), self.path("changes"), ("batch_id",))
            mine = self.spark.read.schema(f"{CHANGE_SCHEMA}, batch_id int").parquet(self.path("changes")).where(F.col("batch_id") == batch_id)
            write_iter(signed_cells(mine).withColumn("batch_id", F.lit(batch_id)), self.path("cells"), ("batch_id",))

        reader = self.spark.readStream.schema(EVENT_SCHEMA)
        if self.max_files:
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        query = (changes(reader.parquet(self.path("events"))).writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", self.path("checkpoint")).trigger(availableNow=True).start())
        query.awaitTermination()

    def changes(self) -> DataFrame:
        return self.spark.read.schema(f"{CHANGE_SCHEMA}, batch_id int").parquet(self.path("changes"))

    def latest(self) -> DataFrame:
        """(idx, label): the current label of every id that has one."""
        last = self.changes().where("has_label").groupBy("idx").agg(F.max_by("new_label", "batch_id").alias("label"))
        return last

    def confusion(self) -> DataFrame:
        """(gold, pred, n) of all ids with a label and a prediction now."""
        cells = self.spark.read.schema("gold string, pred string, n bigint, batch_id int").parquet(self.path("cells"))
        return cells.groupBy("gold", "pred").agg(F.sum("n").alias("n")).where("n <> 0")

    def metrics(self, digits: int | None = None) -> DataFrame:
        """The metrics row over the current confusion table."""
        return E.metrics_from_confusion(self.confusion(), digits)
