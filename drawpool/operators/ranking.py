"""Exact "first n rows per group" without funnelling a group into one task.

Three physical strategies, one result:

* ``window``   -- ``row_number() <= n`` per group.  For a literal n up to
  ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) Catalyst plans a
  ``WindowGroupLimit`` on the map side, so at most n rows per group and map
  partition reach the shuffle, whatever the group size.
* ``topk``     -- global ``orderBy(..).limit(n)``, planned as
  ``TakeOrderedAndProject``: each task keeps n rows.  Only for small n.
* ``bucketed`` -- for large or data-dependent caps.  The caller supplies an
  integer bucket that is monotone in the first order column (hash prefix,
  rounded margin, quantile bucket).  A bounded statistics table
  ``(keys, bucket) -> count`` is aggregated map-side, a running total over it
  says how many rows precede each bucket, buckets entirely inside the cap
  are kept, those entirely beyond are dropped, and ranks are resolved
  exactly with a window partitioned by ``(keys, bucket)`` -- thousands of
  small partitions instead of one per group, so a hot group is spread over
  many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT_MAX = 1000      # literal caps planned as WindowGroupLimit
TOPK_LOCAL_MAX = 10_000     # global top-n small enough for one task
QUANTILE_BUCKETS = 256


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _wide(df: DataFrame, rank_col: str) -> DataFrame:
    """A rank is BIGINT, whichever strategy numbered the rows."""
    return df.withColumn(rank_col, F.col(rank_col).cast("long"))


def rank_first(df: DataFrame, keys: list[str], order: list, cap, *,
               bucket: Column | None = None, rank_col: str = "rank",
               strategy: str = "auto") -> DataFrame:
    """Rows whose 1-based rank inside ``keys`` by ``order`` is <= ``cap``,
    with the rank in ``rank_col``.

    ``cap`` is an int, or the name of a column that is constant per group
    (a data-dependent cap such as "as many negatives as positives").
    ``order`` must be a total order (end it with the unique id)."""
    order_c = _cols(order)
    literal = isinstance(cap, int)
    if strategy == "auto":
        if literal and keys and cap <= GROUP_LIMIT_MAX:
            strategy = "window"
        elif literal and not keys and cap <= TOPK_LOCAL_MAX:
            strategy = "topk"
        else:
            strategy = "bucketed"
    if strategy == "window":
        w = Window.partitionBy(*keys).orderBy(*order_c)
        capc = F.lit(cap) if literal else F.col(cap)
        return _wide(df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= capc), rank_col)
    if strategy == "topk":
        if not literal or keys:
            raise ValueError("topk needs a literal cap and no group keys")
        top = df.orderBy(*order_c).limit(cap)
        # the window below sees at most `cap` rows
        return _wide(top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order_c))), rank_col)
    if strategy != "bucketed":
        raise ValueError(f"unknown strategy {strategy!r}")
    if bucket is None:
        raise ValueError("the bucketed strategy needs a monotone bucket column")
    return _rank_bucketed(df, keys, order_c, cap, bucket, rank_col)


def _rank_bucketed(df, keys, order_c, cap, bucket, rank_col):
    b = df.withColumn("_rk_b", bucket)
    capc = F.lit(cap).cast("long") if isinstance(cap, int) else F.max(F.col(cap)).cast("long")
    stats = b.groupBy(*keys, "_rk_b").agg(F.count(F.lit(1)).alias("_rk_cnt"), capc.alias("_rk_cap"))
    run = (Window.partitionBy(*keys) if keys else Window).orderBy("_rk_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    stats = (stats.withColumn("_rk_before", F.coalesce(F.sum("_rk_cnt").over(run), F.lit(0)))
             .filter(F.col("_rk_before") < F.col("_rk_cap"))
             .select(*keys, "_rk_b", "_rk_before", "_rk_cap"))
    kept = b.join(stats, on=[*keys, "_rk_b"], how="inner")
    w = Window.partitionBy(*keys, "_rk_b").orderBy(*order_c)
    out = (kept.withColumn(rank_col, F.col("_rk_before") + F.row_number().over(w))
           .filter(F.col(rank_col) <= F.col("_rk_cap")))
    return out.drop("_rk_b", "_rk_before", "_rk_cap")


def quantile_bucket(df: DataFrame, col: str, n_buckets: int = QUANTILE_BUCKETS,
                    rel_error: float = 0.001) -> Column:
    """A monotone int bucket for an unbounded double column.

    Split points come from ``approxQuantile`` (n_buckets - 1 doubles reach
    the driver, a fixed small size).  They only balance the buckets; the
    ranking stays exact because boundary buckets are resolved row by row."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = sorted(set(df.approxQuantile(col, probs, rel_error)))
    arr = F.array(*[F.lit(float(s)) for s in splits]) if splits else F.array().cast("array<double>")
    return F.size(F.filter(arr, lambda s: s <= F.col(col))).cast("int")


def range_ranks(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """1-based position of every row in ``order`` (a total order), for any
    number of rows and any type: the rows are range partitioned and sorted,
    each partition counts its own, and the counts of the partitions before it
    are added.  No task sees more than its range; the running sum is over one
    row per partition.  The sorted rows are written once, so their places
    don't change when a task is run again."""
    from ..session import materialize
    order_c = _cols(order)
    placed = df.repartitionByRange(*order_c).sortWithinPartitions(*order_c).withColumn("_mid", F.monotonically_increasing_id())
    placed = materialize(placed, "ranks")
    part = F.shiftright("_mid", 33)   # Spark's id: the partition, then the row's place in 33 bits
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    rows = placed.withColumn("_part", part).join(sizes, on="_part")
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    return rows.withColumn(out, F.col("_before") + place + 1).drop("_part", "_mid", "_before")


def dense_ids(df: DataFrame, order_col: str = "idx", out: str = "new_idx") -> DataFrame:
    """Renumber rows 0..N-1 in ``order_col`` order (a dense id, only when one
    is really needed).  ``order_col`` must be unique."""
    ranked = range_ranks(df, [order_col], out)
    return ranked.withColumn(out, F.col(out) - 1)
