"""Pluggable scorers (J1-J8): ``fit(train) -> model``, ``model.score(df)``.

Three task kinds share the round driver:
* ``standard``   -- one row -> K logits ``z`` and probabilities ``probs``;
* ``nli``        -- one row x K hypotheses -> (z_entail, z_not) per pair;
* ``generation`` -- one row -> predicted answer ``pred`` + per-step scores.

Fitted parameters that these scorers need (class centroids, a coefficient
matrix) are bounded by a closed label vocabulary and the feature dimension,
not by the data; they become literals of the scoring plan, the way an MLlib
model keeps its coefficients on the driver.  For label sets of any size
``blocked.BlockedCentroids`` keeps the classes in a table.
"""

from __future__ import annotations

import json
import math
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import most_frequent, once, word_tokens, ws_tokens
from ..operators.nli import hypotheses

METHODS = ("standard", "nli", "generation")
# reference method names accepted as aliases
METHOD_ALIASES = {"standard_dl": "standard", "nli": "nli", "generation": "generation"}

# ---- fixed parameters of the SQL-checkable stand-in scorers ---------------
CENTROID_SCALE = 20.0   # logit = 20 x dot(features, class mean)
INPUT_LEN = 368         # padded input width = 384 - 16
#: A word with more than this part of all tokens is dealt to several tasks.
HOT = 1000
#: A vocabulary of up to so many words (some 50 MB) is sent to every executor.
BROADCAST_WORDS = 1_000_000
# ---------------------------------------------------------------------------


class Scorer(Protocol):
    """``fit(train or None) -> model``; train is None in a zero-shot round."""
    kind: str

    def fit(self, train: DataFrame | None): ...


class StandardModel(Protocol):
    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``z`` (K logits, vocabulary order) and ``probs``; keeps idx."""


class NLIModel(Protocol):
    def score_pairs(self, df: DataFrame) -> DataFrame:
        """(idx, hypo_pos, z_entail, z_not) for every row x hypothesis.
        A model may also offer ``score_rows(df, label=None)`` returning the
        K values as arrays per row (no expansion)."""


class GenerationModel(Protocol):
    def score(self, df: DataFrame) -> DataFrame:
        """(idx, pred, score): generated answer and its sequence score; a
        model with a ``keep`` argument also carries those columns."""


def resolve_method(name: str) -> str:
    """Method dispatch; unknown names raise."""
    if name in METHODS:
        return name
    if name in METHOD_ALIASES:
        return METHOD_ALIASES[name]
    raise ValueError(f"unknown method {name!r}; known: {', '.join([*METHODS, *METHOD_ALIASES])}")


# ----------------------------------------------------------------- standard
class CentroidModel:
    kind = "standard"

    def __init__(self, vocab: list[str], centroids: list[list[float]], scale: float, features: str):
        self.vocab, self.centroids, self.scale, self.features = vocab, centroids, scale, features

    def logits(self):
        # one JSON string literal; Catalyst constant-folds from_json into an
        # array literal (one driver->JVM call instead of one per cell)
        m = F.from_json(F.lit(json.dumps(self.centroids)), "array<array<double>>")
        x = F.col(self.features).cast("array<double>")
        return F.transform(m, lambda c: F.lit(self.scale) * S.dot(x, c))

    def score(self, df: DataFrame) -> DataFrame:
        """idx + z (K logits) + probs (softmax); a narrow projection."""
        return (df.withColumn("z", self.logits())
                .withColumn("probs", S.softmax("z")))


class CentroidScorer:
    """Nearest-class-mean scorer: logit_k = scale x dot(x, mean_k).  Classes
    with no training row get a zero centroid (logit 0)."""
    kind = "standard"

    def __init__(self, vocab: list[str], features: str = "features", scale: float = CENTROID_SCALE):
        self.vocab, self.features, self.scale = list(vocab), features, scale

    def centroid_table(self, train: DataFrame) -> DataFrame:
        """(label_text, pos, c): mean of each feature position per class,
        aggregated map-side; K x D rows."""
        ex = train.select("label_text", F.posexplode(F.col(self.features).cast("array<double>")).alias("pos", "v"))
        return ex.groupBy("label_text", "pos").agg(F.avg("v").alias("c"))

    def fit(self, train: DataFrame) -> CentroidModel:
        cent = self.centroid_table(train)
        vec = cent.groupBy("label_text").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("centroid"))
        rows = {r["label_text"]: list(r["centroid"]) for r in vec.collect()}   # K rows of D doubles
        dim = max((len(v) for v in rows.values()), default=0)
        mat = [rows.get(lab, [0.0] * dim) for lab in self.vocab]
        return CentroidModel(self.vocab, mat, self.scale, self.features)


class MLlibModel:
    kind = "standard"

    def __init__(self, model, vocab, features_col: str):
        self.model, self.vocab, self.features_col = model, vocab, features_col

    def score(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        out = self.model.transform(df)
        return (out.withColumn("z", vector_to_array("rawPrediction"))
                .withColumn("probs", vector_to_array("probability"))
                .drop("rawPrediction", "probability", "prediction", "_features", "_label",
                      "_tokens", "_tf"))


class LogisticScorer:
    """MLlib multinomial logistic regression, refitted from scratch each
    round (never warm-started).  ``text=True`` puts a tokenizer, HashingTF
    and IDF in front for raw text."""
    kind = "standard"

    def __init__(self, vocab: list[str], features: str = "features", text: bool = False,
                 params: dict | None = None, num_hash_features: int = 1 << 18):
        self.vocab, self.features, self.text = list(vocab), features, text
        self.params = {"maxIter": 50, "regParam": 0.01, "family": "multinomial", **(params or {})}
        self.num_hash_features = num_hash_features

    def _label(self, df: DataFrame) -> DataFrame:
        voc = F.array(*[F.lit(v) for v in self.vocab])
        meta = {"ml_attr": {"type": "nominal", "name": "_label", "vals": self.vocab}}
        return df.withColumn("_label", (F.array_position(voc, F.col("label_text")) - 1)
                             .cast("double").alias("_label", metadata=meta))

    def fit(self, train: DataFrame) -> MLlibModel:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
        from pyspark.ml.functions import array_to_vector
        lr = LogisticRegression(featuresCol="_features", labelCol="_label", **self.params)
        if self.text:
            stages = [RegexTokenizer(inputCol=self.features, outputCol="_tokens",
                                     pattern="[ \n\t\r.,;!?]+", toLowercase=True),
                      HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=self.num_hash_features),
                      IDF(inputCol="_tf", outputCol="_features"), lr]
            pipe = Pipeline(stages=stages)
            model = pipe.fit(self._label(train))
            return MLlibModel(model, self.vocab, self.features)
        vec = self._label(train).withColumn("_features", array_to_vector(self.features))
        model = Pipeline(stages=[lr]).fit(vec)

        class _Wrap:
            def __init__(s, m, f):
                s.m, s.f = m, f

            def transform(s, df):
                return s.m.transform(df.withColumn("_features", array_to_vector(s.f)))
        return MLlibModel(_Wrap(model, self.features), self.vocab, self.features)


class BatchUDFModel:
    kind = "standard"

    def __init__(self, predict_udf, features: str):
        self.predict_udf, self.features = predict_udf, features

    def score(self, df: DataFrame) -> DataFrame:
        return (df.withColumn("z", self.predict_udf(F.col(self.features)))
                .withColumn("probs", S.softmax("z")))


class BatchUDFScorer:
    """A user's own model behind ``predict_batch_udf``: Arrow batches of
    ``batch_size`` rows reach a numpy predict function on the executors.
    ``make_fit(train) -> make_predict_fn`` builds the function from a fitted
    model (only the model, not the data, is shipped)."""
    kind = "standard"

    def __init__(self, make_fit, k: int, dim: int, features: str = "features", batch_size: int = 1024):
        self.make_fit, self.k, self.dim = make_fit, k, dim
        self.features, self.batch_size = features, batch_size

    def fit(self, train: DataFrame) -> BatchUDFModel:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, DoubleType
        make_predict_fn = self.make_fit(train)
        udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()),
                                batch_size=self.batch_size, input_tensor_shapes=[[self.dim]])
        return BatchUDFModel(udf, self.features)


def centroid_predict_fn_factory(vocab, features="features", scale=CENTROID_SCALE):
    """Example user model for ``BatchUDFScorer``: the centroid model done in
    numpy inside the Arrow batches."""
    def make_fit(train: DataFrame):
        mat = CentroidScorer(vocab, features, scale).fit(train).centroids

        def make_predict_fn():
            import numpy as np
            c = np.asarray(mat, dtype=np.float64)

            def predict(x):
                return scale * (np.asarray(x, dtype=np.float64) @ c.T)
            return predict
        return make_predict_fn
    return make_fit


# ------------------------------------------------------------------- nli
class OverlapNLIScorer:
    """Stand-in NLI model: entail logit = number of distinct hypothesis
    words among the words of the whole text; not-entail logit = 1.
    Needs no fit (zero-shot).  Text tokens are computed once per row before
    the K-way expansion."""
    kind = "nli"

    def __init__(self, hypo_label_dic: dict[str, str]):
        self.hypo_label_dic = hypo_label_dic

    def fit(self, train: DataFrame | None = None) -> "OverlapNLIScorer":
        return self

    def _hyp_tokens(self):
        return [(p, lab, h, F.array_distinct(word_tokens(F.lit(h))))
                for p, lab, h in hypotheses(self.hypo_label_dic)]

    def _text_tokens(self):
        return F.array_distinct(word_tokens("text"))

    def score_pairs(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(idx, hypo_pos, z_entail, z_not) for every row x hypothesis: the
        long pair form a pairwise NLI model consumes."""
        hyp = F.array(*[F.struct(F.lit(p).alias("hypo_pos"), t.alias("htok")) for p, _, _, t in self._hyp_tokens()])
        t = df.select("idx", *keep, self._text_tokens().alias("_tt"))
        ex = t.select("idx", *keep, "_tt", F.explode(hyp).alias("h"))
        return ex.select("idx", *keep, F.col("h.hypo_pos").alias("hypo_pos"),
                         F.size(F.array_intersect("_tt", "h.htok")).cast("double").alias("z_entail"),
                         F.lit(1.0).alias("z_not"))

    def score_testset(self, df: DataFrame, label: str = "label_text") -> DataFrame:
        """Pair form with the NLI test label (0 at the row's own hypothesis)
        computed in the same expansion -- no join back to a label table."""
        from ..operators.nli import nli_testset
        t = df.select("idx", label, self._text_tokens().alias("_tt"))
        ts = nli_testset(t, self.hypo_label_dic, label=label, keep=("_tt",))
        return ts.select("idx", "hypo_pos", "label",
                         F.size(F.array_intersect("_tt", F.array_distinct(word_tokens("hypothesis"))))
                         .cast("double").alias("z_entail"), F.lit(1.0).alias("z_not"))

    def score_rows(self, df: DataFrame, label: str | None = "label_text", keep: tuple[str, ...] = ()) -> DataFrame:
        """Row form: (idx, *keep, z_entail[K], z_not[K] [, label[K]]) without
        expanding rows -- the K hypotheses are a literal array evaluated in
        the row, so there is no regroup shuffle at all."""
        hyps = self._hyp_tokens()
        # the whole text meets the words of all hypotheses once; the few that it has are counted for each
        known = F.array_distinct(F.concat(*(t for _, _, _, t in hyps)))
        z = once(F.array_intersect(word_tokens("text"), known), lambda has: F.array(*[F.size(F.array_intersect(has, t)).cast("double") for _, _, _, t in hyps]))
        cols = ["idx", *keep, z.alias("z_entail"), F.array_repeat(F.lit(1.0), len(hyps)).alias("z_not")]
        if label is not None:
            from ..operators.nli import _own_hypothesis
            own = _own_hypothesis(self.hypo_label_dic, label)
            own = F.when(own.isNull(), F.raise_error(F.lit("label not in hypothesis dictionary"))).otherwise(own)
            cols.append(F.array(*[F.when(F.lit(h) == own, 0).otherwise(1) for _, _, h, _ in hyps]).alias("label"))
        return df.select(*cols).withColumn("n_hypo", F.lit(len(hyps)))


# ------------------------------------------------------------ generation
class UnigramModel:
    kind = "generation"

    def __init__(self, counts: DataFrame, n_tokens: int, vocab_size: int, input_len: int, length_penalty: float,
                 broadcast_words: int = BROADCAST_WORDS):
        self.broadcast_words = broadcast_words
        self.counts, self.n_tokens, self.vocab_size = counts, n_tokens, vocab_size
        self.input_len, self.length_penalty = input_len, length_penalty

    def _step(self):
        """Log unigram probability of a joined token, add-one smoothed."""
        return F.log((F.coalesce(F.col("cnt"), F.lit(0)) + 1) / F.lit(float(self.n_tokens + self.vocab_size)))

    def step_scores(self, df: DataFrame) -> DataFrame:
        """(idx, pos, token, step): the step of every token of the whole
        text.  Frequent words skew this join on token; AQE splits the skewed
        partitions (or broadcasts the counts when they turned out small)."""
        tok = df.select("idx", F.posexplode(ws_tokens("text")).alias("pos", "token"))
        return tok.join(self.counts, on="token", how="left").select("idx", "pos", "token", self._step().alias("step"))

    def predictions(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return answer_predictions(df, keep)

    def score(self, df: DataFrame, with_pred: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
        """(idx, *keep, [pred,] score) with the I6 sequence score over the
        whole text.

        Sums and counts of a text are partial aggregates before they meet by
        id.  A vocabulary of up to ``BROADCAST_WORDS`` (it was counted when the
        model was fitted) is looked up where the text is read.  A larger one
        is met in one exchange by token; words that make up more than
        1 / ``HOT`` of all tokens -- fewer than ``HOT`` of them, whatever the
        corpus -- are dealt to salts there, with their counts repeated.  A text
        without tokens stays as a row of its own, so nothing is joined back."""
        cols = [*keep, *(["pred"] if with_pred else [])]
        # the answer is made before the text is taken apart, not once a token
        rows = df.select("idx", *keep, F.col("text").alias("_text"), *([most_frequent(word_tokens("text")).alias("pred")] if with_pred else []))
        rows = rows.select("idx", *cols, F.explode_outer(ws_tokens("_text")).alias("token"))
        if self.vocab_size <= self.broadcast_words:
            step = rows.join(F.broadcast(self.counts), on="token", how="left")
        else:
            step = self._dealt(rows)
        step = step.withColumn("step", F.when(F.col("token").isNotNull(), self._step()))
        out = step.groupBy("idx").agg(*(F.first(c).alias(c) for c in cols), F.sum("step").alias("_sum"), F.count(F.when(F.col("step") < 0, 1)).alias("_neg"))
        return (out.withColumn("score", S.sequence_score_of(F.coalesce("_sum", F.lit(0.0)), F.col("_neg"), self.input_len, self.length_penalty))
                .drop("_sum", "_neg"))


    def _dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (idx, token, ...) with ``cnt``, through an exchange by (token, salt)."""
        share = max(1, self.n_tokens // HOT)
        salts = F.when(F.col("cnt") > share, F.ceil(F.col("cnt") / share).cast("int")).otherwise(F.lit(1))
        hot = self.counts.where(F.col("cnt") > share).select(F.col("token").alias("_hot"), salts.alias("_salts"))
        rows = rows.join(F.broadcast(hot), F.col("token") == F.col("_hot"), "left")   # fewer than HOT rows
        salt = F.coalesce(F.pmod(F.xxhash64("idx"), F.col("_salts")).cast("int"), F.lit(0))
        counts = self.counts.select("token", "cnt", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        return rows.withColumn("salt", salt).join(counts, on=["token", "salt"], how="left")


def answer_predictions(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(idx, pred): the stand-in generated answer = the most frequent word
    of the whole text (ties: the smaller word), computed inside the row --
    no explode, no shuffle, and no fitted state needed."""
    return df.select("idx", *keep, most_frequent(word_tokens("text")).alias("pred"))


class UnigramScorer:
    """Stand-in generation model: unigram counts of the training texts (of
    the corpus when there is no train table yet: the zero-shot prior)."""
    kind = "generation"

    def __init__(self, corpus: DataFrame, input_len: int = INPUT_LEN, length_penalty: float = 1.0):
        self.corpus, self.input_len, self.length_penalty = corpus, input_len, length_penalty

    @staticmethod
    def counts(texts: DataFrame) -> DataFrame:
        tok = texts.select(F.explode(ws_tokens("text")).alias("token"))
        return tok.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))

    def fit(self, train: DataFrame | None) -> UnigramModel:
        src = self.corpus if train is None else train
        # the fitted model is the count table: written once to the shared
        # checkpoint folder (reliable checkpoint), then read for the totals
        # and for every scoring join -- the texts are tokenized once per fit
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(src.sparkSession)
        counts = self.counts(src).checkpoint(eager=True)
        tot = counts.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("v")).first()   # two scalars
        return UnigramModel(counts, int(tot["n"] or 0), int(tot["v"] or 0), self.input_len, self.length_penalty)


def log_prob(count: int, n_tokens: int, vocab_size: int) -> float:
    """Reference value of one step score (for tests)."""
    return math.log((count + 1) / (n_tokens + vocab_size))
