"""File sources of the reference's demos, read by Spark (A2, A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Nested Q&A source: answers is a struct holding an array of answer texts.
QA_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answers", T.StructType([T.StructField("text", T.ArrayType(T.StringType()))])),
])

# Quote source: label plus the translated quote and its neighbours.
QUOTE_SCHEMA = T.StructType([
    T.StructField("label_text", T.StringType()),
    T.StructField("text_preceding_trans", T.StringType()),
    T.StructField("text_original_trans", T.StringType()),
    T.StructField("text_following_trans", T.StringType()),
])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV with quoted multi-line fields.  Spark decompresses gzip,
    bzip2, zstd... by extension; a zip archive is read by ``zipped``, one
    partition for each of its members."""
    if path.endswith(".zip"):
        from .zipped import read_zip_csv
        return read_zip_csv(spark, path, schema, empty_as_null=True)   # as the reader below
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_qa(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Q&A split (JSON lines or parquet) with the nested answers struct."""
    if fmt == "json":
        return spark.read.schema(QA_SCHEMA).json(path)
    return spark.read.parquet(path)
