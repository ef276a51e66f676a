"""Seeded, partition-independent row order.

``md5(concat_ws(':', seed, key...))`` gives every row a fixed pseudo-random
position that does not depend on partitioning, executor count or retries
(``rand()`` and ``DataFrame.sample`` depend on all three).  The hex digest is
also available in DuckDB, which keeps the oracle exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number of leading hex digits of the digest used as a coarse bucket:
# 4 digits -> 65,536 buckets, a bounded statistics table per group.
BUCKET_HEX_DIGITS = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seeded_hash(seed: int | str, *keys) -> Column:
    """md5 hex of ``seed:key1:key2...``; keys are columns or names."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(h: Column | str) -> Column:
    """Leading hex digits of a digest as an int bucket, order-preserving."""
    return F.conv(F.substring(_c(h), 1, BUCKET_HEX_DIGITS), 16, 10).cast("int")
