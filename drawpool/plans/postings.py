"""Word-overlap scores against any number of hypotheses, by an inverted index
(I3, J6, D13).

The hypotheses are a table.  A text is scored only against hypotheses that
share a word with it; every other one has the known logit 0.  Long posting
lists are dealt in parts and words of many texts in salts, both from counts,
so neither a frequent word nor a common hypothesis word is one task's work.
Words that no hypothesis has are dropped where the texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import word_tokens
from ..operators.membership import bitmap, may_be_in
from ..session import materialize

#: Hypotheses in a part of a posting list, and texts of a word in one salt.
LIST_PART, WORD_TEXTS = 256, 50_000


class PostingsNLI:
    """``hypotheses``: (hypo_pos, hypothesis), positions 0 .. K-1 of any K."""
    kind = "nli"

    def __init__(self, hypotheses: DataFrame, list_part: int = LIST_PART, word_texts: int = WORD_TEXTS):
        words = hypotheses.select(F.col("hypo_pos").cast("bigint").alias("hypo_pos"), F.explode(F.array_distinct(word_tokens("hypothesis"))).alias("word"))
        self.postings, self.k = materialize(words, "postings"), hypotheses.count()
        self.list_part, self.word_texts = list_part, word_texts

    def shared(self, texts: DataFrame) -> DataFrame:
        """(idx, hypo_pos, z): the number of distinct words that text and
        hypothesis share, for the pairs that share one."""
        known = may_be_in(F.col("word"), bitmap(self.postings, "word"))
        # a word of a text, read twice: counted, then joined
        words = texts.select("idx", F.explode(F.array_distinct(word_tokens("text"))).alias("word")).where(known)
        lists = self.postings.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / self.list_part).cast("int").alias("parts"))
        texts_of = words.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / self.word_texts).cast("int").alias("salts"))
        plan = materialize(lists.join(texts_of, on="word"), "word-plan")   # a row a word of the hypotheses
        part = F.pmod(F.xxhash64("hypo_pos"), F.col("parts"))
        parts = self.postings.join(plan, on="word").groupBy("word", "salts", part.alias("part")).agg(F.collect_list("hypo_pos").alias("list"))
        parts = parts.select("word", "part", "list", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        dealt = words.join(plan, on="word").select("idx", "word", F.pmod(F.xxhash64("idx"), F.col("salts")).cast("int").alias("salt"),
                                                   F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        pairs = dealt.join(parts, on=["word", "salt", "part"]).select("idx", F.explode("list").alias("hypo_pos"))
        return pairs.groupBy("idx", "hypo_pos").agg(F.count(F.lit(1)).alias("z"))

    def predict(self, texts: DataFrame) -> DataFrame:
        """(idx, pred_pos, z_entail, n_shared, margin) of every text: the
        hypothesis with the largest logit (the first of equal ones), how many
        share a word, and the margin of the two largest entail probabilities
        (not-entail logit 1).  Logits are counts of a hypothesis's words, so a
        text has few different ones."""
        by = self.shared(texts).groupBy("idx", "z").agg(F.count(F.lit(1)).alias("n"), F.min("hypo_pos").alias("pos"))
        top = by.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("down"), "n", "pos"))).alias("s"), F.sum("n").alias("n_shared"))
        first = F.get("s", 0)
        best = -first["down"]
        second = F.when(first["n"] > 1, best).otherwise(F.coalesce(-F.get("s", 1)["down"], F.lit(0)))
        top = top.select("idx", first["pos"].alias("pred_pos"), best.alias("z1"), second.alias("z2"), "n_shared")
        all_ = texts.select("idx").join(top, on="idx", how="left")
        z1, z2 = (F.coalesce(c, F.lit(0)).cast("double") for c in ("z1", "z2"))
        p1, p2 = (F.round(S.entail_prob(z, F.lit(1.0)), S.PROB_DIGITS) for z in (z1, z2))
        margin = F.round(p1 - p2, S.PROB_DIGITS) if self.k > 1 else F.lit(0.0)
        return all_.select("idx", F.coalesce("pred_pos", F.lit(0)).cast("bigint").alias("pred_pos"), z1.alias("z_entail"),
                           F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"), margin.alias("margin"))
