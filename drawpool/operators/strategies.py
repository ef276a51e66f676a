"""Uncertainty draws: minimum certainty and breaking ties.

Both draw the n least certain pool rows, attach the score, and add a seeded
shuffle position so the train order is random rather than by difficulty.
n is the labelling budget of one round; up to ``TOPK_LOCAL_MAX`` the draw
is a ``TakeOrderedAndProject`` (each task keeps n rows), above it a filter by
an exact cutoff (see ``radix``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .radix import before_or_at, cutoffs, number_digits
from .ranking import TOPK_LOCAL_MAX, quantile_bucket, range_ranks, rank_first
from .sampling import SEED, shuffle_rank


class PoolExhausted(RuntimeError):
    """No rows left in the pool to draw from."""


def ensure_not_empty(df: DataFrame, what: str = "pool") -> None:
    if df.isEmpty():
        raise PoolExhausted(f"the {what} has no row left")


def vocab_array(vocab: list[str]):
    if len(set(vocab)) != len(vocab):
        raise ValueError("label vocabulary must be distinct")
    return F.array(*[F.lit(v) for v in vocab])


def sql_string(v: str) -> str:
    """A Spark SQL string literal (backslash and quote escaped)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def vocab_sql(vocab: list[str]) -> str:
    if len(set(vocab)) != len(vocab):
        raise ValueError("label vocabulary must be distinct")
    return "array(" + ", ".join(sql_string(v) for v in vocab) + ")"


def checked_probs(probs: str, k: int):
    """The probability array, or a task error if it is not K long or holds
    NaN/null (NaN would sort as the top value)."""
    p = F.col(probs)
    bad = (F.size(p) != F.lit(k)) | ~S.is_valid_probs(p)
    return F.when(bad, F.raise_error(F.lit(f"probabilities must be {k} finite values"))) \
        .otherwise(p)


def margin_scores(scored: DataFrame, vocab: list[str], probs: str = "probs") -> DataFrame:
    """Per row: 4-digit probabilities, their top-2 margin (re-rounded), the
    predicted label (first maximum of the rounded probabilities).  A row
    whose probabilities are not K finite values fails the task (NaN would
    sort as the top value).  Written as SQL text: one JVM call per step."""
    k = len(vocab)
    voc = vocab_sql(vocab)
    check = (f"CASE WHEN {probs} IS NULL OR size({probs}) != {k} "
             f"OR exists({probs}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) "
             f"THEN raise_error('probabilities must be {k} finite values') ELSE {probs} END")
    m = scored.selectExpr("*", f"transform({check}, x -> round(x, {S.PROB_DIGITS})) AS p4")
    return m.selectExpr(
        "*",
        f"CASE WHEN size(p4) < 2 THEN 0D ELSE round(sort_array(p4, false)[0] - sort_array(p4, false)[1], "
        f"{S.PROB_DIGITS}) END AS margin",
        f"element_at({voc}, cast(array_position(p4, array_max(p4)) AS int)) AS label_text_pred")


def radix_draw(scored: DataFrame, n: int, idx: str = "idx", rank_col: str = "margin_rank", small: int | None = None) -> DataFrame:
    """The n rows with the smallest (margin, id) for a large n, with their rank.

    A histogram of the margins (multiples of 1e-4, so 10,001 values at most)
    says at which margin the draw ends; histograms of 16-bit digits of the ids
    that have this margin narrow it down to one id.  The draw is then a filter
    in the scan, and half of the pool may have one margin: rows that tie are
    counted, never brought together.  The drawn rows alone are sorted, by
    ranges, for their ranks."""
    levels = [F.expr("cast(round(margin * 10000) AS int)"), *number_digits(F.col(idx))]
    one = scored.withColumn("_all", F.lit(0))
    cut = cutoffs(one.select("_all", "margin", idx), "_all", levels, {0: n}, **({} if small is None else {"small": small}))[0]
    return range_ranks(scored.where(before_or_at(levels, cut)), ["margin", idx], rank_col)


def breaking_ties(scored: DataFrame, vocab: list[str], n: int = 20, seed: int = SEED,
                  probs: str = "probs", idx: str = "idx", strategy: str = "auto") -> DataFrame:
    """The n rows with the smallest top-2 margin (ties: smaller id), with
    named 4-digit probabilities, their rescaled version, the prediction and
    a seeded shuffle position."""
    m = margin_scores(scored, vocab, probs)
    if strategy == "radix" or (strategy == "auto" and n > TOPK_LOCAL_MAX):
        drawn = radix_draw(m, n, idx)
    else:
        # margins are multiples of 1e-4 in [0, 1]: the bucket is the margin itself
        bucket = F.expr("cast(round(margin * 10000) AS int)")
        drawn = rank_first(m, [], ["margin", idx], n, bucket=bucket, rank_col="margin_rank",
                           strategy=strategy)
    voc = vocab_sql(vocab)
    drawn = drawn.selectExpr(
        "*", f"map_from_arrays({voc}, p4) AS probs_named",
        f"map_from_arrays({voc}, aggregate(p4, 0D, (a, x) -> a + x, s -> transform(p4, x -> x / s))) "
        "AS probs_scaled")
    return shuffle_rank(drawn, seed, idx, n_max=n)


def min_certainty(scored: DataFrame, n: int = 20, seed: int = SEED, score: str = "score",
                  idx: str = "idx", strategy: str = "auto") -> DataFrame:
    """The n rows with the smallest scalar sequence score (ties: smaller id)."""
    if dict(scored.dtypes).get(score) not in ("double", "float"):
        raise TypeError("min_certainty needs a scalar score column")
    # a null or NaN would sort first or last instead of meaning anything
    scored = scored.withColumn(score, F.expr(
        f"CASE WHEN {score} IS NULL OR isnan({score}) OR abs({score}) = double('infinity') "
        f"THEN raise_error('scores must be finite') ELSE {score} END"))
    bucket = None
    if strategy == "bucketed" or (strategy == "auto" and n > TOPK_LOCAL_MAX):
        bucket = quantile_bucket(scored, score)
    drawn = rank_first(scored, [], [score, idx], n, bucket=bucket, rank_col="score_rank",
                       strategy=strategy)
    return shuffle_rank(drawn, seed, idx, n_max=n)
