"""Seeded, exact, partition-independent sampling and splitting.

A row's position in a draw is ``md5(seed:idx)`` then ``idx``; draws are exact
in size and membership and do not change with partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, seeded_hash
from .ranking import TOPK_LOCAL_MAX, range_ranks, rank_first

# ---- fixed values: seeds of the reference's demo ---------------------------
SEED = 42            # corpus / pool draws
SEED_TEST = 84       # test draw (seed + seed)
SEED_TRAIN = 126     # seed-train draw (seed + seed + seed)
STRATA_CAP = 30      # rows per label in the stratified draws
SEED_TRAIN_CAP = 10  # rows per label in the seed-train draw
# ---------------------------------------------------------------------------


class SampleTooLarge(ValueError):
    """A strict sample asks for more rows than there are."""


def with_hash(df: DataFrame, seed: int, idx: str = "idx", out: str = "_h") -> DataFrame:
    return df.withColumn(out, seeded_hash(seed, idx))


def uniform_sample(df: DataFrame, n: int, seed: int = SEED, idx: str = "idx",
                   rank_col: str | None = None, strategy: str = "auto", strict: bool = False) -> DataFrame:
    """The n rows with the smallest ``md5(seed:idx)``.  Of fewer than n rows
    all are drawn, or with ``strict`` ``SampleTooLarge`` is raised (which
    counts the rows first)."""
    if strict and (have := df.count()) < n:
        raise SampleTooLarge(f"{n} rows asked for, {have} there")
    h = with_hash(df, seed, idx)
    out = rank_first(h, [], ["_h", idx], n, bucket=hash_bucket("_h"),
                     rank_col=rank_col or "_rank", strategy=strategy)
    out = out.drop("_h")
    return out if rank_col else out.drop("_rank")


def stratified_sample(df: DataFrame, cap: int = STRATA_CAP, seed: int = SEED,
                      label: str = "label_text", idx: str = "idx",
                      rank_col: str | None = None, strategy: str = "auto") -> DataFrame:
    """``min(cap, group size)`` rows per label; null labels are dropped
    (pandas groupby drops null keys)."""
    h = with_hash(df.filter(F.col(label).isNotNull()), seed, idx)
    out = rank_first(h, [label], ["_h", idx], cap, bucket=hash_bucket("_h"),
                     rank_col=rank_col or "_rank", strategy=strategy).drop("_h")
    return out if rank_col else out.drop("_rank")


def seeded_draws(df: DataFrame, draws: dict[str, tuple[int, int]], label: str = "label_text", idx: str = "idx") -> DataFrame:
    """Several stratified draws in one scan: (*columns, draw, rank) of the
    ``cap`` rows with the smallest ``md5(seed:idx)`` of each label, for each
    ``draws[name] = (seed, cap)``.

    Each row is looked at once per draw where it is read; the tasks keep the
    first rows of each (label, draw) before anything is exchanged (caps up to
    ``GROUP_LIMIT_MAX`` are planned as ``WindowGroupLimit``), so what is kept
    can be merged from any number of tasks and has the size of the draws."""
    from .ranking import GROUP_LIMIT_MAX
    most = max(cap for _, cap in draws.values())
    each = F.array(*(F.struct(F.lit(name).alias("draw"), F.lit(cap).alias("cap"), seeded_hash(seed, idx).alias("h")) for name, (seed, cap) in draws.items()))
    rows = df.filter(F.col(label).isNotNull()).select("*", F.explode(each).alias("_d")).select(*df.columns, "_d.*")
    out = rank_first(rows, [label, "draw"], ["h", idx], most, bucket=hash_bucket("h"), rank_col="rank",
                     strategy="window" if most <= GROUP_LIMIT_MAX else "bucketed")
    return out.where(F.col("rank") <= F.col("cap")).drop("cap", "h")


def split_draws(df: DataFrame, cap: int = STRATA_CAP, seed: int = SEED, label: str = "label_text", idx: str = "idx",
                train_cap: int = SEED_TRAIN_CAP) -> DataFrame:
    """(*columns, in_corpus, in_test, in_seed_train): one row for each row
    that is in the corpus draw (seed s), the test draw (2s, without what the
    corpus has) or the seed-train draw (3s; its overlap with the others stays,
    as in the original).  All three come from one scan; which draws hold a row
    is settled among the drawn rows."""
    drawn = seeded_draws(df, {"corpus": (seed, cap), "test": (2 * seed, cap), "seed": (3 * seed, train_cap)}, label, idx)
    names = F.collect_set("draw")
    rest = [c for c in df.columns if c != idx]
    per = drawn.groupBy(idx).agg(names.alias("_in"), *(F.first(c).alias(c) for c in rest))
    has = lambda d: F.array_contains("_in", d)
    return per.select(*df.columns, has("corpus").alias("in_corpus"), (has("test") & ~has("corpus")).alias("in_test"), has("seed").alias("in_seed_train"))


def corpus_test_split(df: DataFrame, cap: int = STRATA_CAP, seed: int = SEED,
                      label: str = "label_text", idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Two stratified draws (seed s and 2s); test loses the corpus rows.  The
    drawn rows of both are written once."""
    from ..session import materialize
    both = materialize(split_draws(df, cap, seed, label, idx).where("in_corpus OR in_test"), "split")
    return tuple(both.where(c).drop("in_corpus", "in_test", "in_seed_train") for c in ("in_corpus", "in_test"))


def seed_train_draw(df: DataFrame, cap: int = SEED_TRAIN_CAP, seed: int = SEED,
                    label: str = "label_text", idx: str = "idx",
                    exclude: list[DataFrame] | None = None) -> DataFrame:
    """Stratified seed-train draw with seed 3s.  The reference leaves the
    overlap with corpus/test in place; ``exclude`` removes it."""
    out = stratified_sample(df, cap, 3 * seed, label, idx)
    for other in exclude or []:
        out = out.join(other.select(idx), on=idx, how="left_anti")
    return out


def shuffle_rank(df: DataFrame, seed: int = SEED, idx: str = "idx",
                 out: str = "shuffle_rank", *, n_max: int) -> DataFrame:
    """Seeded shuffle position (1..n) of the rows of a draw.

    ``n_max`` bounds the number of rows.  Small draws are numbered by one
    window over the n rows; larger ones by ranges, so a big draw is never
    numbered in a single task."""
    if n_max > TOPK_LOCAL_MAX:
        return range_ranks(df.withColumn("_sh", seeded_hash(seed, idx)), ["_sh", idx], out).drop("_sh")
    w = Window.orderBy(seeded_hash(seed, idx), F.col(idx))
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def shuffled(df: DataFrame, seed: int = SEED, idx: str = "idx") -> DataFrame:
    """Seeded order of any size of table (a distributed range sort)."""
    return df.orderBy(seeded_hash(seed, idx), F.col(idx))
