"""Train-id set, pool upkeep and the annotation ledger (C1-C3, C6, C7,
C10, H2, H3, K2, K5).

Every positional match of the reference is a keyed join here.  The id
tables involved (train ids, drawn ids) grow with the labelling budget, not
with the pool; AQE broadcasts them while they are small and falls back to a
sort-merge join when they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .membership import rows_not_in


def pool_minus(pool: DataFrame, ids: DataFrame, idx: str = "idx", by: str = "join") -> DataFrame:
    """Pool rows whose id is not in ``ids``.  ``by="join"`` is an anti-join,
    which AQE plans as a broadcast while the ids are few; ``"bitmap"`` tests
    the ids in the scan (``membership``), so that the pool is not exchanged
    however many they are."""
    if by == "bitmap":
        return rows_not_in(pool, ids, idx)
    return pool.join(ids.select(idx), on=idx, how="left_anti")


def rows_in(original: DataFrame, ids: DataFrame, idx: str = "idx") -> DataFrame:
    """Original rows whose id is in ``ids`` (semi-join)."""
    return original.join(ids.select(idx), on=idx, how="left_semi")


def latest_annotation(ledger: DataFrame) -> DataFrame:
    """Latest label per id: the label with the greatest (ts, seq).
    ``max_by`` aggregates map-side, so a heavily re-annotated id costs one
    partial row per task."""
    return ledger.groupBy("idx").agg(
        F.max_by("label", F.struct("ts", "seq")).alias("label"),
        F.count(F.lit(1)).alias("n_annotations"),
        F.max("ts").alias("last_ts"))


def with_current_labels(rows: DataFrame, latest: DataFrame | None, label: str = "label_text") -> DataFrame:
    """Replace each row's label by its latest annotation, where there is one."""
    if latest is None:
        return rows
    cur = latest.select("idx", F.col("label").alias("_cur"))
    return (rows.join(cur, on="idx", how="left")
            .withColumn(label, F.coalesce(F.col("_cur"), F.col(label))).drop("_cur"))


def train_rows_current(original: DataFrame, train_ids: DataFrame, latest: DataFrame | None) -> DataFrame:
    """Train table rebuilt from the original rows of all train ids with the
    labels as they are *now* (past annotations may have been revised)."""
    return with_current_labels(rows_in(original, train_ids), latest)


def union_train_ids(prev: DataFrame | None, new: DataFrame) -> DataFrame:
    """Set union of (idx, iter) id tables; an id keeps the round it first
    entered.  Applying the same draw twice changes nothing."""
    u = new if prev is None else prev.select("idx", "iter").unionByName(new.select("idx", "iter"))
    return u.groupBy("idx").agg(F.min("iter").alias("iter"))


def merge_predictions(pool: DataFrame, scored: DataFrame) -> DataFrame:
    """Full pool rows with the latest predictions and scores (inner join)."""
    return pool.join(scored, on="idx", how="inner")


def train_plus_scored(train: DataFrame, scored: DataFrame) -> DataFrame:
    """Bag union of train rows and scored rows; missing columns are null."""
    return (train.withColumn("split", F.lit("train"))
            .unionByName(scored.withColumn("split", F.lit("corpus")), allowMissingColumns=True))
