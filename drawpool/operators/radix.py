"""Exact cutoffs of "the first n rows" by counting digits, without a sort.

The rows of each group are ordered by a list of digits (small whole numbers,
the most significant first) that end in a unique one.  Counting the rows of
each value of the first digit says in which value the n-th row lies; only the
rows of that value are counted by the next digit, and so on until the value
that holds the n-th row has few rows, which are read off.  What results is a
cutoff per group, so the rows themselves are chosen by a filter in the scan:
nothing but counts is ever exchanged, and rows that tie in the leading digits
never meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that may be ordered in one task to read the cutoff off.
SMALL = 20_000


@dataclass(frozen=True)
class Cutoff:
    """Rows up to ``digits`` are the first n.  Without digits a group has no
    more than n rows, so all of them are."""
    digits: tuple | None = None


def before_or_at(levels: list[Column], cutoff: Cutoff | None) -> Column:
    """Whether a row comes before ``cutoff`` or is the row at it; a group
    without a cutoff keeps nothing."""
    if cutoff is None:
        return F.lit(False)
    out = F.lit(True)
    for c, v in reversed(list(zip(levels, cutoff.digits or ()))):
        out = (c < F.lit(v)) | ((c == F.lit(v)) & out)
    return out


def histogram(rows: DataFrame, group: str, digit: Column) -> DataFrame:
    """(group, digit, n): counted in the scan's tasks first."""
    return rows.groupBy(group, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def boundaries(hist: DataFrame, group: str, caps: dict) -> dict:
    """group -> (digit, rows before it, rows of it) of the value that holds
    row ``caps[group]``, for groups with so many rows.  The running sum is
    over counts, whose number is bounded by groups times digit values."""
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(group))
    at = hist.withColumn("upto", F.sum("n").over(Window.partitionBy(group).orderBy("digit"))).withColumn("cap", cap)
    hit = at.where((F.col("upto") >= F.col("cap")) & (F.col("upto") - F.col("n") < F.col("cap")))
    return {r[group]: (r["digit"], r["upto"] - r["n"], r["n"]) for r in hit.select(group, "digit", "upto", "n").collect()}   # a row a group


def _inside(group: str, levels: list[Column], places: dict) -> Column:
    """Rows whose leading digits are those of ``places`` (group -> digits)."""
    out = F.lit(False)
    for g, digits in places.items():
        part = F.col(group) == F.lit(g)
        for c, v in zip(levels, digits):
            part &= c == F.lit(v)
        out |= part
    return out


def _read_off(rows: DataFrame, group: str, levels: list[Column], places: dict) -> dict:
    """Cutoffs of the groups whose boundary value has few rows."""
    if not places:
        return {}
    names = [f"d{i}" for i in range(len(levels))]
    few = rows.where(_inside(group, levels, {g: d for g, (d, _) in places.items()})).select(group, *(c.alias(n) for n, c in zip(names, levels)))
    go = F.element_at(F.create_map(*(F.lit(x) for g, (_, n) in places.items() for x in (g, n))), F.col(group))
    few = few.withColumn("at", F.row_number().over(Window.partitionBy(group, "d0").orderBy(*names))).where(F.col("at") == go)
    return {r[group]: Cutoff(tuple(r[n] for n in names)) for r in few.collect()}   # a row a group


def cutoffs(rows: DataFrame, group: str, levels: list[Column], caps: dict, first: DataFrame | None = None, small: int = SMALL) -> dict:
    """group -> ``Cutoff`` of its first ``caps[group]`` rows, for each group
    of ``caps`` (bounded, as the groups are labels or hypotheses).

    ``levels`` order the rows of a group; together they must be unique in it.
    ``first`` is the histogram of the first level where the caller has it."""
    out: dict = {g: Cutoff() if n > 0 else None for g, n in caps.items()}
    left = {g: ((), int(n)) for g, n in caps.items() if n > 0}   # digits so far, rows still to go
    for depth, level in enumerate(levels):
        if not left:
            break
        if depth == 0:
            hist = first if first is not None else histogram(rows.where(F.col(group).isin(*left)), group, level)
        else:
            hist = histogram(rows.where(_inside(group, levels, {g: d for g, (d, _) in left.items()})), group, level)
        found = boundaries(hist, group, {g: n for g, (_, n) in left.items()})
        places = {g: ((*left[g][0], digit), left[g][1] - before, n) for g, (digit, before, n) in found.items()}
        if depth + 1 == len(levels):
            return out | {g: Cutoff(d) for g, (d, _, _) in places.items()}
        out |= _read_off(rows, group, levels, {g: (d, go) for g, (d, go, n) in places.items() if n <= small})
        left = {g: (d, go) for g, (d, go, n) in places.items() if n > small}
    return out


#: Bits of a digit of a whole number.
DIGIT_BITS = 16


def number_digits(c: Column, bits: int = DIGIT_BITS) -> list[Column]:
    """Digits of a BIGINT column, the most significant first, in its order."""
    u = c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))   # the sign turned: unsigned order
    mask = F.lit((1 << bits) - 1).cast("bigint")
    return [F.shiftrightunsigned(u, s).bitwiseAND(mask) for s in range(64 - bits, -1, -bits)]


def hex_digits(h: Column, digits: int = 4, n: int = 4) -> list[Column]:
    """The first ``n`` digits of a hex digest, each of ``digits`` hex places,
    then the digest itself."""
    return [F.conv(F.substring(h, 1 + i * digits, digits), 16, 10).cast("int") for i in range(n)] + [h]
