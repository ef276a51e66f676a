"""Training-corpus pipeline: toxic documents go, then exact copies, near
copies and benchmark leaks; what stays is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of ``documents``.

Rows without a ``doc_id`` can't be named by the later stages' decisions: the
near-duplicate stage keeps them, and decontamination drops them together if
one of them is contaminated.  Rows of a repeated ``doc_id`` share their fate
in these two stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawpool.llm import decontaminate, exact_dedup, language_mixture, near_dedup, packing, queries, toxicity
from drawpool.llm.common import importable, table, written


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone`` (a narrow table of one row an id)."""
    gone = written(gone.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents at or above the toxicity threshold go."""
    usable = ~language_mixture.held_out(F.col("doc_id"), 4, 2)
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), usable))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts the smallest id stays."""
    return exact_dedup.first_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each near-duplicate group stays."""
    return _without(docs, near_dedup.near_dedup(docs).where("doc_id IS NOT NULL AND NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a window of a benchmark item go."""
    return _without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents' pieces in as few sequences as it can."""
    return packing.best_fit_packing(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("packing", pack),
]

#: A learned score decides in the first stage, which SQL cannot express; tests/llm checks the rest against SQL and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
