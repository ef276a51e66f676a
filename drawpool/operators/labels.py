"""Label operators: whitelist filter, label codes, vocabulary, distribution
(B4-B8, B12, D1) and the first-answer label of a Q&A source (B1).

Per-label results have K rows (the label vocabulary), which may be as many as
the answers of an open vocabulary: codes are numbered by ranges, not in one
task.  The pool meets them through an equi-join that AQE turns into a
broadcast when K is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNANSWERABLE
from .ranking import range_ranks

ISIN_MAX = 1000   # longer whitelists become a semi-join


def filter_labels(df: DataFrame, whitelist, label: str = "label_text") -> DataFrame:
    """Keep rows whose label is in ``whitelist`` (a list or a one-column
    DataFrame).  Short lists are an ``IN`` predicate that parquet can push
    down; long ones a left-semi join."""
    if isinstance(whitelist, DataFrame):
        w = whitelist.select(F.col(whitelist.columns[0]).alias(label)).distinct()
        return df.join(w, on=label, how="left_semi")
    values = list(whitelist)
    if len(values) <= ISIN_MAX:
        return df.filter(F.col(label).isin(values))
    spark = df.sparkSession
    w = spark.createDataFrame([(v,) for v in values], [label])
    return df.join(w, on=label, how="left_semi")


def label_codes_first_seen(df: DataFrame, label: str = "label_text", idx: str = "idx") -> DataFrame:
    """(label, code): codes in order of first appearance (by id, then label).
    Any number of labels: they are numbered by ranges."""
    first = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(idx).alias("_first"))
    return range_ranks(first, ["_first", label], "code").select(label, (F.col("code") - 1).alias("code"))


def label_codes_alpha(df: DataFrame, label: str = "label_text") -> DataFrame:
    """(label, code): codes in alphabetical order (label2id), for any number
    of labels."""
    d = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return range_ranks(d, [label], "code").select(label, (F.col("code") - 1).alias("code"))


def attach_codes(df: DataFrame, codes: DataFrame, label: str = "label_text",
                 out: str = "label") -> DataFrame:
    """Per-row code through the K-row code table; null label -> -1."""
    c = codes.select(label, F.col("code").alias(out))
    return df.join(c, on=label, how="left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def label_vocab(df: DataFrame, label: str = "label_text") -> DataFrame:
    """One row: the sorted label vocabulary and its size.  Distinct first,
    so the single-row collect sees K values, not the pool."""
    d = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return d.agg(F.array_sort(F.collect_list(label)).alias("vocab")) \
        .select("vocab", F.size("vocab").cast("long").alias("k"))


def vocab_list(df: DataFrame, label: str = "label_text") -> list[str]:
    """The vocabulary of a closed label set (K strings) for literal
    expressions.  An open vocabulary (answer strings) stays a table:
    ``label_codes_alpha`` numbers it, ``evaluate.class_report`` and
    ``blocked.BlockedCentroids`` take it as one."""
    d = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return list(d.agg(F.array_sort(F.collect_list(label)).alias("v")).first()["v"])


def label_code_map(df: DataFrame, label: str = "label_text") -> DataFrame:
    """One row: map label -> alphabetical code."""
    c = label_codes_alpha(df, label)
    return c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "code")))).alias("label2id"))


def label_distribution(df: DataFrame, label: str = "label_text") -> DataFrame:
    """value_counts(): count per label, nulls dropped, largest first."""
    return (df.filter(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(label)))


def label_length_max(df: DataFrame, label: str = "label_text") -> DataFrame:
    """Longest label in characters."""
    return df.agg(F.max(F.length(label)).cast("long").alias("max_label_chars"))


def first_answer_long(questions: DataFrame, answers: DataFrame, idx: str = "idx") -> DataFrame:
    """label_text = text of the lowest-position answer, 'unanswerable' when a
    question has none.  ``answers`` is long form (idx, pos, text); min_by is a
    partial aggregate, so a question with very many answers is reduced
    map-side rather than collected."""
    first = answers.groupBy(idx).agg(F.min_by("text", "pos").alias("_first"),
                                     F.count(F.lit(1)).alias("_n"))
    j = questions.join(first, on=idx, how="left")
    return j.withColumn("label_text", F.when(F.coalesce(F.col("_n"), F.lit(0)) > 0, F.col("_first"))
                        .otherwise(F.lit(UNANSWERABLE))).drop("_first", "_n")
