"""NLI formulation: rows x hypotheses.

``hypo_pos`` is defined as the alphabetical rank of the label, so chunk
positions and the alphabetical label vocabulary always agree.  The K
hypotheses are a literal array built from the user's dictionary (driver-side
by nature, K entries); rows are expanded with ``posexplode``-style
``explode`` of that literal, a narrow per-row operation that keeps the input
partitioning -- no join, no cross product with a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.hashing import seeded_hash
from ..session import materialize
from .radix import Cutoff, before_or_at, cutoffs, hex_digits
from .sampling import SEED


def hypotheses(hypo_label_dic: dict[str, str]) -> list[tuple[int, str, str]]:
    """[(hypo_pos, label_text, hypothesis)] in alphabetical label order."""
    labels = sorted(hypo_label_dic)
    if len(labels) != len(set(labels)) or not labels:
        raise ValueError("hypothesis dictionary needs distinct labels")
    return [(i, lab, hypo_label_dic[lab]) for i, lab in enumerate(labels)]


def _hypo_array(hypo_label_dic):
    return F.array(*[F.struct(F.lit(p).alias("hypo_pos"), F.lit(lab).alias("hypo_label"),
                              F.lit(h).alias("hypothesis"))
                     for p, lab, h in hypotheses(hypo_label_dic)])


def _own_hypothesis(hypo_label_dic, label: str):
    m = F.create_map(*[x for lab, h in sorted(hypo_label_dic.items()) for x in (F.lit(lab), F.lit(h))])
    return F.element_at(m, F.col(label)) if hypo_label_dic else F.lit(None)


def nli_testset(df: DataFrame, hypo_label_dic: dict[str, str], on_unknown: str = "error",
                label: str = "label_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row x K hypotheses with label 0 where the hypothesis text equals
    the row's own hypothesis, else 1 (two labels sharing a hypothesis text
    both get 0).  A label outside the dictionary raises (default) or the row
    is dropped (``on_unknown="drop"``)."""
    if on_unknown not in ("error", "drop"):
        raise ValueError("on_unknown must be 'error' or 'drop'")
    own = _own_hypothesis(hypo_label_dic, label)
    base = df.withColumn("_own", own)
    if on_unknown == "drop":
        base = base.filter(F.col("_own").isNotNull())
    else:
        base = base.withColumn("_own", F.when(F.col("_own").isNull(), F.raise_error(
            F.concat(F.lit("label not in hypothesis dictionary: "),
                     F.coalesce(F.col(label), F.lit("null"))))).otherwise(F.col("_own")))
    ex = base.select("idx", *keep, "_own", F.explode(_hypo_array(hypo_label_dic)).alias("h"))
    return ex.select("idx", *keep, F.col("h.hypo_pos").alias("hypo_pos"),
                     F.col("h.hypothesis").alias("hypothesis"),
                     F.when(F.col("h.hypothesis") == F.col("_own"), 0).otherwise(1).alias("label"))


def nli_trainset(train: DataFrame, hypo_label_dic: dict[str, str], seed: int = SEED,
                 label: str = "label_text", keep: tuple[str, ...] = (), order: str = "own", small: int | None = None) -> DataFrame:
    """Entail rows (label 0) for each hypothesis plus a seeded draw without
    replacement of min(n_entail, n_not_entail) not-entail rows (label 1).

    Not-entail is ``NOT (label <=> hypothesis label)``, so null-label rows are
    negatives.  With ``order="own"`` each hypothesis draws by a hash of its own
    (``seed:label:idx``); with ``"shared"`` all draw by one hash (``seed:idx``),
    as one seed for every label does.

    The draw is made of cutoffs, not of ranks.  The rows are counted by label
    and hash prefix; the counts of a hypothesis's negatives are those of all
    rows minus those of its own label, so one histogram says for every
    hypothesis up to which hash its negatives go (``radix.cutoffs`` settles the
    rows of the last prefix).  Then each row is compared with the K cutoffs
    where it is read, and only the pairs that stay are expanded: no negative
    set is built, nothing is exchanged by hypothesis, and a label that holds
    half of the rows costs the same as any other."""
    hyps = hypotheses(hypo_label_dic)
    own = F.element_at(F.create_map(*(F.lit(x) for p, lab, _ in hyps for x in (lab, p))), F.col(label))
    hashes = [seeded_hash(seed, "idx") if order == "shared" else seeded_hash(seed, F.lit(lab), "idx") for _, lab, _ in hyps]
    if order not in ("own", "shared"):
        raise ValueError("order must be 'own' or 'shared'")
    narrow = train.select("idx", F.coalesce(own, F.lit(-1)).alias("_own"))
    counts = materialize(_label_counts(narrow, hashes, order), "label-counts")
    caps = {r["_own"]: r["n"] for r in counts.groupBy("_own").agg(F.sum("n").alias("n")).where("_own >= 0").collect()}   # K rows
    caps = {p: caps.get(p, 0) // (1 if order == "shared" else len(hyps)) for p, _, _ in hyps}
    # (hypothesis, digit, n) of the negatives: all rows minus those of the own label
    pairs = counts if order == "own" else counts.select("_own", "digit", "n", F.explode(F.array(*(F.lit(p) for p, _, _ in hyps))).alias("pos"))
    first = pairs.groupBy("pos", "digit").agg((F.sum("n") - F.coalesce(F.sum(F.when(F.col("_own") == F.col("pos"), F.col("n"))), F.lit(0))).alias("n"))
    # the pairs themselves are looked at only inside a last prefix
    candidates = narrow.select("idx", F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), h.alias("h")) for (p, _, _), h in zip(hyps, hashes)))).alias("c"), "_own") \
        .where(F.col("c.pos") != F.col("_own")).select(F.col("c.pos").alias("pos"), F.col("c.h").alias("h"), "idx")
    cut = cutoffs(candidates, "pos", [*hex_digits(F.col("h")), F.col("idx")], caps, first=first.where("n > 0"), **({} if small is None else {"small": small}))
    kept = F.filter(F.array(*(
        F.struct(F.lit(p).alias("hypo_pos"), F.lit(h).alias("hypothesis"),
                 F.when(F.col("_own") == p, 0).when(before_or_at([x, F.col("idx")], _short(cut[p])), 1).alias("label"))
        for (p, _, h), x in zip(hyps, hashes))), lambda c: c["label"].isNotNull())
    rows = train.select("idx", *keep, F.coalesce(own, F.lit(-1)).alias("_own"))
    return rows.select("idx", *keep, F.explode(kept).alias("c")).select("idx", *keep, "c.hypo_pos", "c.hypothesis", "c.label")


def _short(cut: Cutoff | None) -> Cutoff | None:
    """The digest and the id of a cutoff say it all."""
    return cut and Cutoff(cut.digits and cut.digits[-2:])


def _label_counts(narrow: DataFrame, hashes: list, order: str) -> DataFrame:
    """Rows by (own hypothesis, hash prefix): one count table for all
    hypotheses under a shared hash, one part for each (``pos``) otherwise."""
    if order == "shared":
        return narrow.groupBy("_own", hex_digits(hashes[0])[0].alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    digits = F.array(*(hex_digits(h)[0] for h in hashes))
    return narrow.select("_own", F.posexplode(digits).alias("pos", "digit")).groupBy("_own", "pos", "digit").agg(F.count(F.lit(1)).alias("n"))


def regroup(long_scored: DataFrame, value_cols: list[str], k: int) -> DataFrame:
    """K hypothesis rows per premise -> one row per idx with arrays ordered
    by hypo_pos.  A premise whose positions are not 0 ... K-1 fails the task:
    a place in the array is taken for the hypothesis's position."""
    st = F.struct("hypo_pos", *value_cols)
    g = long_scored.groupBy("idx").agg(F.array_sort(F.collect_list(st)).alias("_rows"))
    whole = F.transform("_rows", lambda r: r["hypo_pos"].cast("int")) == F.sequence(F.lit(0), F.lit(k - 1))
    g = g.withColumn("_rows", F.when(whole, F.col("_rows")).otherwise(
        F.raise_error(F.concat(F.lit(f"not one score for each of {k} hypotheses: idx "), F.col("idx").cast("string")))))
    return g.select("idx", F.size("_rows").alias("n_hypo"),
                    *[F.transform("_rows", _field(c)).alias(c) for c in value_cols])


def _field(name: str):
    # a one-argument lambda: transform() treats two-argument ones as (x, i)
    return lambda r: r[name]


def nli_predict(grouped: DataFrame, select: str = "logits") -> DataFrame:
    """From regrouped (idx, z_entail[], z_not[], label[]) arrays:
    pred_pos = hypothesis with the highest raw entail logit (first wins;
    ``select="softmax"`` uses the entail probability instead), p_entail =
    per-hypothesis 2-way softmax column 0 (not normalised over K), gold_pos =
    position of the 0 label (argmin, first wins)."""
    p = F.zip_with("z_entail", "z_not", lambda a, b: S.entail_prob(a, b))
    g = grouped.withColumn("p_entail", p)
    key = "z_entail" if select == "logits" else "p_entail"
    g = g.withColumn("pred_pos", S.argmax(F.col(key).cast("array<double>")))
    if "label" in grouped.columns:
        g = g.withColumn("gold_pos", (F.array_position("label", F.array_min("label")) - 1).cast("int"))
    return g
