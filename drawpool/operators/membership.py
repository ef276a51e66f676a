"""Membership of a large set of ids, tested where the rows are read.

The ids become one bitmap over a hash of fixed width, built by Spark's bitmap
functions and handed to the scan as a scalar subquery; rows whose bit is not
set are settled there and never exchanged.  Only rows whose bit is set -- the
members, and a few that share a bit with one -- meet the ids in an exact join.
A bitmap that has filled up lets more rows through to that join; the result
never depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 2 MB, whatever the number of ids.
BITS = 1 << 24
#: Bits of one bucket of Spark's bitmap functions (fixed by Spark).
BUCKET = 32768


def _slot(key: Column, bits: int) -> Column:
    """1 .. bits, so that Spark's buckets are 1 .. bits / BUCKET."""
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1)) + 1


def bitmap(ids: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """One row ``b``: the bitmap's buckets in order (null where none is set).
    Each task sends one bitmap a bucket at most."""
    slot = _slot(F.col(key), bits)
    held = ids.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    every = ids.sparkSession.range(1, bits // BUCKET + 1).select(F.col("id").alias("bucket"), F.lit(None).cast("binary").alias("bits"))
    each = held.unionByName(every).groupBy("bucket").agg(F.max("bits").alias("bits"))
    return each.agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("s")).select(F.transform("s", lambda x: x["bits"]).alias("b"))


def may_be_in(key: Column, held: DataFrame, bits: int = BITS) -> Column:
    """Whether the bit of ``key`` is set in ``held`` (of ``bitmap``)."""
    slot = _slot(key, bits)
    place = F.bitmap_bit_position(slot)
    bucket = F.get(held.scalar(), (F.bitmap_bucket_number(slot) - 1).cast("int"))
    octet = F.conv(F.hex(F.substring(bucket, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(octet / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    return F.coalesce(bit, F.lit(False))


def rows_not_in(rows: DataFrame, ids: DataFrame, idx: str = "idx", bits: int = BITS) -> DataFrame:
    """``rows`` whose id is not in ``ids``; a null id is in no set."""
    ids = ids.select(idx)
    may = may_be_in(F.col(idx), bitmap(ids, idx, bits), bits)
    return rows.where(~may).unionByName(rows.where(may).join(ids, on=idx, how="left_anti"))


def rows_in(rows: DataFrame, ids: DataFrame, idx: str = "idx", bits: int = BITS) -> DataFrame:
    """``rows`` whose id is in ``ids``."""
    ids = ids.select(idx)
    return rows.where(may_be_in(F.col(idx), bitmap(ids, idx, bits), bits)).join(ids, on=idx, how="left_semi")
