"""Score post-processing on ``array<double>`` columns.

Everything is a higher-order SQL function (``transform``, ``aggregate``,
``array_max``...), evaluated per row inside whole-stage codegen.  No Python
runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probabilities are rounded to this many digits before ranking, as the
# reference does when it names them (it creates ties on purpose).
PROB_DIGITS = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def softmax(z) -> Column:
    """Numerically stable softmax over the K logits of a row.

    One ``aggregate``: its initial value (the row maximum) is evaluated
    once, the merge sums exp(x - max), the finish divides -- O(K) per row.
    (A ``transform`` whose lambda calls ``array_max``/a sum would recompute
    them for every element.)"""
    z = _c(z).cast("array<double>")
    init = F.struct(F.array_max(z).alias("m"), F.lit(0.0).alias("s"))
    return F.aggregate(
        z, init,
        lambda acc, x: F.struct(acc["m"].alias("m"), (acc["s"] + F.exp(x - acc["m"])).alias("s")),
        lambda acc: F.transform(z, lambda x: F.exp(x - acc["m"]) / acc["s"]))


def argmax(arr) -> Column:
    """0-based position of the first maximum (first wins on ties)."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def round_probs(p, digits: int = PROB_DIGITS) -> Column:
    return F.transform(_c(p), lambda x: F.round(x, digits))


def top2_margin(p, digits: int = PROB_DIGITS) -> Column:
    """top1 - top2 of a probability array, re-rounded to ``digits`` so that
    binary residue of the subtraction cannot decide ties; 0 when K = 1."""
    s = F.sort_array(_c(p), asc=False)
    return F.when(F.size(s) < 2, F.lit(0.0)).otherwise(
        F.round(F.get(s, 0) - F.get(s, 1), digits))


def label_of_max(p, vocab) -> Column:
    """Label whose (rounded) probability is largest, first wins."""
    return F.element_at(_c(vocab), F.array_position(_c(p), F.array_max(_c(p))).cast("int"))


def named_probs(vocab, p) -> Column:
    """map<label, prob>; the vocabulary must be distinct and size(p) = K."""
    return F.map_from_arrays(_c(vocab), _c(p))


def rescale(p) -> Column:
    """Divide by the row sum so the probabilities sum to 1 (sum computed
    once per row, in the aggregate's finish step)."""
    p = _c(p)
    return F.aggregate(p, F.lit(0.0).cast("double"), lambda acc, x: acc + x,
                       lambda s: F.transform(p, lambda x: x / s))


def entail_prob(z_entail, z_not) -> Column:
    """Column 0 of a 2-way softmax: 1 / (1 + exp(z_not - z_entail))."""
    return 1.0 / (1.0 + F.exp(_c(z_not).cast("double") - _c(z_entail).cast("double")))


def sequence_score(steps, input_len: int, length_penalty: float = 1.0) -> Column:
    """sum(step scores) / (input_len + count(step < 0)) ** length_penalty.

    ``input_len`` is the padded input width (equal for every row); zero steps
    are padding and add nothing to either side."""
    s = _c(steps)
    n_neg = F.size(F.filter(s, lambda x: x < 0))
    return array_sum(s) / F.pow(F.lit(input_len) + n_neg, F.lit(float(length_penalty)))


#: Digits of a sequence score: equal token counts give equal scores whatever
#: the order in which their steps were added.
SCORE_DIGITS = 9


def sequence_score_of(total, n_neg, input_len: int, length_penalty: float = 1.0) -> Column:
    """``sequence_score`` from the sum of the steps and the number of negative ones."""
    return F.round(_c(total) / F.pow(F.lit(input_len) + _c(n_neg), F.lit(float(length_penalty))), SCORE_DIGITS)


def naive_certainty(steps2d) -> Column:
    """Sum over generation steps of the largest logit of each step."""
    return array_sum(F.transform(_c(steps2d), lambda st: F.array_max(st)))


def dot(x, c) -> Column:
    """Dot product of two equally long arrays."""
    return F.aggregate(F.zip_with(_c(x), _c(c), lambda a, b: a * b),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def is_valid_probs(p) -> Column:
    """No NaN and no null: NaN sorts as the top value in array_max."""
    return F.size(F.filter(_c(p), lambda x: F.isnan(x) | x.isNull())) == 0
