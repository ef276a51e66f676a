"""Adaptors from the driver's test tables to the pool contract.

Each adaptor is a projection (plus at most one aggregation or join) over the
parquet tables, so Catalyst prunes columns at the scan and work grows with
the tables.  The same shapes are written as SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_answer, first_word
from .contracts import ColumnRoles, register_pool

# ---- fixed values ----------------------------------------------------------
# Hypothesis dictionary for the language pool (label -> hypothesis), in
# alphabetical label order.  Hypothesis text = five frequent function words.
LANG_HYPOTHESES = {
    "de": "der die und von das",
    "en": "the and of is that",
    "es": "el se los del para",
    "fr": "et le des les est",
}
# Hypothesis dictionary for the quality pool, alphabetical.
QUALITY_HYPOTHESES = {
    "q0_t0": "The text is of low quality and it is not toxic.",
    "q0_t1": "The text is of low quality and it is toxic.",
    "q1_t0": "The text is of high quality and it is not toxic.",
    "q1_t1": "The text is of high quality and it is toxic.",
}
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pool_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> idx, features array<double>, label_text (class as text)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("idx"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("string").alias("label_text"))


def pool_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a labels row -> label_text = q{quality}_t{toxic}."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, on="doc_id", how="inner")
    j = j.withColumn("label_text", F.concat(F.lit("q"), F.col("quality").cast("string"),
                                            F.lit("_t"), F.col("toxic").cast("string")))
    return register_pool(j, ColumnRoles(idx="doc_id"))


def pool_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> label_text = language."""
    return register_pool(table(spark, sf_dir, "documents"), ColumnRoles(idx="doc_id", label="lang"))


def pool_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an answer-generation pool: gold answer = first word."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("idx"), "text")
    return d.withColumn("label_text", first_word("text"))


#: Turn numbers of one conversation that a task orders together.
TURNS = 1000


def neighbours(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text_original, text_preceding, text_following): the
    neighbouring rows of each turn in turn order, whatever numbers are missing.

    A conversation is cut into runs of 1,000 turn numbers, so one that holds a
    third of all turns is ordered by many tasks; the first and last row of a
    run get their neighbours from the runs beside it.  Of rows with the same
    turn number the smaller text comes first."""
    c = turns.select("conv_id", "turn", "text", F.floor(F.col("turn") / TURNS).alias("run"))
    w = Window.partitionBy("conv_id", "run").orderBy("turn", "text")
    near = c.select("*", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"),
                    F.lag(F.lit(1)).over(w).isNull().alias("first"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    order = F.struct("turn", "text")
    runs = c.groupBy("conv_id", "run").agg(F.min_by("text", order).alias("head"), F.max_by("text", order).alias("tail"))
    v = Window.partitionBy("conv_id").orderBy("run")
    runs = runs.select("conv_id", "run", F.lag("tail").over(v).alias("run_before"), F.lead("head").over(v).alias("run_after"))
    out = near.join(runs, (near["conv_id"].eqNullSafe(runs["conv_id"])) & (near["run"].eqNullSafe(runs["run"])))
    return out.select(near["conv_id"], "turn", F.col("text").alias("text_original"),
                      F.when(F.col("first"), F.col("run_before")).otherwise(F.col("before")).alias("text_preceding"),
                      F.when(F.col("last"), F.col("run_after")).otherwise(F.col("after")).alias("text_following"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> each turn with the texts of its neighbours."""
    return neighbours(table(spark, sf_dir, "conversations"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> one Q&A row per conversation.

    question = first user turn, context = last user turn; answers stay in
    long form ``(idx, pos, text)`` (see ``qa_answers``).  Every aggregate is
    a min/max-by with map-side partial aggregation: no conversation's turns
    are collected into one row."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user")
    return (u.groupBy(F.col("conv_id").alias("idx"))
            .agg(F.min_by("text", "turn").alias("question"),
                 F.max_by("text", "turn").alias("context")))


def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each Q&A row in long form: assistant turns."""
    c = table(spark, sf_dir, "conversations")
    return (c.filter(F.col("role") == "assistant")
            .select(F.col("conv_id").alias("idx"), F.col("turn").alias("pos"), "text"))


def qa_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q&A rows with label_text = first answer, else 'unanswerable'."""
    from ..operators.labels import first_answer_long
    return first_answer_long(qa(spark, sf_dir), qa_answers(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an annotation ledger: idx = user, label = event type,
    ts = time, seq = event id (unique, breaks equal timestamps)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("idx"),
                    F.col("event_type").alias("label"), "ts",
                    F.col("event_id").cast("long").alias("seq"),
                    F.lit(0).cast("long").alias("annotator"))


def ledger_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original pool of the ledger ids: first annotation of each id."""
    lg = ledger(spark, sf_dir)
    return (lg.groupBy("idx")
            .agg(F.min_by("label", F.struct("ts", "seq")).alias("label_text"),
                 F.count(F.lit(1)).alias("n_annotations")))


def nested_answers(df: DataFrame, answers: str = "answers") -> DataFrame:
    """Nested source form (A3): label_text from ``answers.text``."""
    return df.withColumn("label_text", first_answer(F.col(answers).getField("text")))
