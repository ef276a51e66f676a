"""Exact deduplication as a stateful stream, in DataFrame operations only.

Digests of normalised texts stream into keyed state on disk (RocksDB, no
expiry) that holds, per digest, the first document's id, the locator of its
content and the number of rows.  Rows that hit a digest already taken are
then checked byte by byte: per digest, the smallest and the largest
normalised text must be the same string (a partial aggregate, so a group that
holds a third of all rows is reduced before it is shuffled).  Digests that
fail the check are grouped again by the text itself.  Texts meet their digest
by the digest, recomputed where they are read: a third of all rows without an
id, or with one id, costs no more than others.  The locator names a row of the
written table of digests; it is kept for users of the state, and no step here
reads a text by it.

Defined cases: null text counts as empty; empty texts are equal to each
other; a repeated ``doc_id`` is a row like any other and shares the fate of
its text; a null ``doc_id`` never stays while its group has an id, and rows
of a group without any id all stay; other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawpool.operators.membership import bitmap, may_be_in

from .common import scratch, written

SPACE = r"[\x20\x09-\x0D]+"
_STATE = "spark.sql.streaming.stateStore."
#: State on disk; files grow with their content, instead of 4 MB set aside for each state partition.
ROCKSDB = {f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           f"{_STATE}rocksdb.allowFAllocate": "false",
           # one bound for all state partitions of an executor
           f"{_STATE}rocksdb.boundedMemoryUsage": "true", f"{_STATE}rocksdb.maxMemoryUsageMB": "128"}


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def dedup_state(spark: SparkSession, arrivals: DataFrame, checkpoint: str) -> None:
    """Feed a stream of (doc_id, locator, digest) into the keyed state kept
    under ``checkpoint``; a later run with the same folder goes on from there."""
    with _rocksdb(spark):
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"))
        query = (arrivals.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
                 .writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as (digest, keep_id, locator, n), one row per digest."""
    state = spark.read.format("statestore").load(checkpoint)
    first, n = (f.name for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{first}`.doc_id").alias("keep_id"),
                        F.col(f"value.`{first}`.locator").alias("locator"), F.col(f"value.`{n}`").alias("group_size"))


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``
    (doc_id, text).  ``digest`` maps the normalised text to the state's key."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    norm = normalised(F.col("text"))
    rows = written(docs.select("doc_id", norm.alias("t")).select(
        "doc_id", F.monotonically_increasing_id().alias("locator"),
        digest(F.col("t")).alias("digest"), sha256(F.col("t")).alias("sha")), "digests")

    state_dir, path = scratch(spark, "dedup-state"), rows.inputFiles()
    if path:
        stream = spark.readStream.schema(rows.schema).parquet(path[0].rpartition("/")[0])
        dedup_state(spark, stream.select("doc_id", "locator", "digest"), state_dir)
        with _rocksdb(spark):
            state = written(read_state(spark, state_dir), "state")
    else:  # no row at all
        state = rows.select("digest", F.col("doc_id").alias("keep_id"), "locator", F.lit(0).cast("bigint").alias("group_size"))

    placed = rows.join(state.drop("locator"), "digest")
    # full bytes on hits: texts whose digest is taken twice, found where they are read; each task reduces a digest's texts first
    hits = state.where("group_size > 1").select("digest")
    texts = docs.select("doc_id", norm.alias("t")).withColumn("digest", digest(F.col("t")))
    unlike = written(texts.where(may_be_in(F.col("digest"), bitmap(hits, "digest"))).groupBy("digest")
                     .agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("digest"), "unlike")
    plain = placed.select("doc_id", "keep_id", "group_size", "sha")
    if not unlike.isEmpty():
        # a digest shared by different texts: its rows are grouped by text
        same = texts.join(unlike, "digest", "left_semi").select("doc_id", "t", sha256(F.col("t")).alias("sha"))
        groups = same.groupBy("t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        exact = same.join(groups, "t").select("doc_id", "keep_id", "group_size", "sha")
        plain = placed.join(unlike, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "sha").unionByName(exact)
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.  Rows that
    share both id and text are one document and leave one row."""
    rows = written(exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "decisions")
    gone = rows.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    marked = docs.withColumn("__sha", F.sha2(normalised(F.col("text").cast("string")).cast("binary"), 256))
    left = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("__sha") == F.col("gone_sha")), "left_anti")
    if not rows.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "__sha"])
    return left.drop("__sha")
