"""Round driver (K1-K5, A4-A7): fit -> score -> evaluate -> draw -> update.

The loop runs on the driver over lazy DataFrames, but lineage never grows:
every round ends by writing its state (scored rows, metrics, the draw, the
train-id set) as parquet below the shared checkpoint folder, and the next
round starts from those files and the immutable source tables.  Actions per
round: the fit, the scored write, the metrics write, the draw write.

Iteration numbering follows the reference: metrics of round r carry
``iter = r``; the draw made from them carries ``iter = r + 1``, the round
that will train on it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import ledger as L
from ..operators import nli as N
from ..operators.strategies import PoolExhausted, breaking_ties, min_certainty, vocab_sql
from ..session import new_run_id, state_path
from ..sources.history import exists, read_history, read_iter, write_iter
from .scorers import resolve_method


class ScoreMismatch(RuntimeError):
    """The scored rows of a slot are not as many as its rows."""


@dataclass
class RoundState:
    """The three slots (corpus, train, test) plus the train-id set."""
    iter: int
    corpus: DataFrame                  # remaining pool rows
    train: DataFrame | None
    test: DataFrame | None
    train_ids: DataFrame | None        # (idx, iter)


@dataclass
class ActiveLearningRun:
    spark: SparkSession
    corpus: DataFrame                  # original pool (idx, text/features, label_text)
    scorer: object
    vocab: list[str]
    method: str = "standard"
    test: DataFrame | None = None
    seed_train: DataFrame | None = None
    n_sample: int = 20
    seed: int = 42
    keep_seed_train: bool = True
    annotations: DataFrame | None = None   # ledger (idx, label, ts, seq, annotator)
    hypo_label_dic: dict | None = None
    metric_digits: int | None = None
    out_dir: str | None = None
    # Keep the scored pool of every round (A7).  One narrow pool-sized write
    # per round, read twice (metrics, draw).  False: no write, the scoring
    # plan runs twice instead -- cheaper when K is large and scoring is cheap.
    persist_scored: bool = True
    # Write the seed train once under out_dir and use that table: a seed drawn
    # lazily from the pool would be re-derived (full pool scan) every round.
    materialize_seed: bool = True
    # NLI prediction: "logits" picks the highest raw entail logit (as the
    # original does), "softmax" the highest per-hypothesis entail probability
    nli_select: str = "logits"
    # How the pool loses the train ids: "join", or "bitmap" for so many ids
    # that a join would exchange the pool (see ledger.pool_minus)
    membership: str = "join"
    state: RoundState = field(init=False)

    def __post_init__(self):
        self.method = resolve_method(self.method)
        if self.out_dir is None:
            self.out_dir = state_path(self.spark, new_run_id())
        if self.method == "generation" and self.metric_digits is None:
            self.metric_digits = 3
        if self.method == "nli" and not self.hypo_label_dic:
            raise ValueError("the nli method needs a hypothesis dictionary")
        if self.method == "nli" and sorted(self.hypo_label_dic) != sorted(self.vocab):
            raise ValueError("hypothesis dictionary and label vocabulary differ")
        if self.seed_train is not None and self.materialize_seed:
            self.seed_train.write.mode("overwrite").parquet(self.path("seed_train"))
            self.seed_train = self.spark.read.parquet(self.path("seed_train"))
        self.state = RoundState(0, self.corpus, self.seed_train, self.test, None)
        self._n_seed, self._scored = None, None
        self._n_drawn_by_iter: dict[int, int] = {}   # round -> rows drawn (re-runs overwrite)

    # -- paths ---------------------------------------------------------------
    def path(self, name: str) -> str:
        return f"{self.out_dir}/{name}"

    # -- scoring per method --------------------------------------------------
    def _fit(self):
        train = self.state.train
        if self.method == "standard" and train is None:
            raise ValueError("a trained-type scorer needs a seed train set in round 0")
        if self.method == "nli" and train is not None:
            train = N.nli_trainset(train, self.hypo_label_dic, self.seed, keep=("text",))
        return self.scorer.fit(train)

    def _score(self, model, rows: DataFrame, split: str) -> DataFrame:
        """(split, idx, gold, pred, probs, score) for one slot."""
        gold = rows.select("idx", F.col("label_text").alias("gold"))
        if self.method == "standard":
            s = model.score(rows).selectExpr(
                "idx", "label_text AS gold",
                f"element_at({vocab_sql(self.vocab)}, cast(array_position(z, array_max(z)) AS int)) AS pred",
                "probs", "CAST(NULL AS double) AS score")
        elif self.method == "nli":
            if hasattr(model, "score_rows"):
                # hypotheses evaluated inside each row: no expansion, no regroup
                p = N.nli_predict(model.score_rows(rows, label=None, keep=("label_text",)), select=self.nli_select)
                p = p.withColumnRenamed("label_text", "gold")
            else:
                pairs = model.score_pairs(rows)
                p = N.nli_predict(N.regroup(pairs, ["z_entail", "z_not"], k=len(self.vocab)), select=self.nli_select)
                p = p.join(gold, on="idx", how="inner")
            s = p.selectExpr(
                "idx", "gold", f"element_at({vocab_sql(self.vocab)}, pred_pos + 1) AS pred",
                "p_entail AS probs", "CAST(NULL AS double) AS score")
        else:
            sc = model.score(rows, keep=("label_text",))
            s = sc.select(
                "idx", F.col("label_text").alias("gold"), "pred", F.lit(None).cast("array<double>").alias("probs"), "score")
        return s.withColumn("split", F.lit(split))

    # -- one round -------------------------------------------------------------
    def run_round(self) -> DataFrame:
        """K1: fit if there is a train table, score test then pool, write the
        scored rows and the metrics of this round; returns the metrics row."""
        r = self.state.iter
        if self.state.corpus.isEmpty():
            raise PoolExhausted(f"the pool has no row left to score in round {r}")
        model = self._fit()
        parts = [self._score(model, self.state.corpus, "corpus")]
        if self.state.test is not None:
            parts.append(self._score(model, self.state.test, "test"))
        scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        eval_split = "test" if self.state.test is not None else "corpus"
        if self.persist_scored:
            write_iter(scored.withColumn("iter", F.lit(r)), self.path("scored"), ("iter", "split"))
            self._scored = None
            self._check_counts(r)
            ev = read_iter(self.spark, self.path("scored"), r, split=eval_split)
        else:
            # no scored history: metrics and the draw each evaluate the lazy
            # scoring plan (two passes over the pool, no pool-sized write)
            self._scored = scored
            ev = scored.filter(F.col("split") == eval_split)
        m = E.eval_metrics(ev, digits=self.metric_digits)
        # rows the model was fitted on: seed rows counted once, drawn rows
        # tracked from the collected draw ids (no count job per round)
        if self._n_seed is None:
            self._n_seed = 0 if self.seed_train is None else self.seed_train.count()
        n_drawn = sum(v for k, v in self._n_drawn_by_iter.items() if k <= r)
        n_train = (self._n_seed if (r == 0 or self.keep_seed_train) else 0) + n_drawn
        if self.state.train is None:
            n_train = 0
        m = m.withColumn("iter", F.lit(r)).withColumn("n_train", F.lit(n_train).cast("long"))
        write_iter(m, self.path("metrics"))
        return read_iter(self.spark, self.path("metrics"), r)

    def _check_counts(self, r: int) -> None:
        """A scorer gives one row for each row of a slot; a lost or
        doubled row is an error, not a smaller result."""
        got = {row["split"]: row["n"] for row in
               read_iter(self.spark, self.path("scored"), r).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        for split, rows in (("corpus", self.state.corpus), ("test", self.state.test)):
            if rows is not None and got.get(split, 0) != (n := rows.count()):
                raise ScoreMismatch(f"round {r}: {got.get(split, 0)} scores for {n} rows of the {split} slot")

    def draw(self) -> DataFrame:
        """F1/F2 on this round's pool scores; writes the sample as iter+1."""
        r = self.state.iter
        if self._scored is not None:
            sc = self._scored.filter(F.col("split") == "corpus")
        else:
            sc = read_iter(self.spark, self.path("scored"), r, split="corpus")
        if self.method == "generation":
            d = min_certainty(sc, self.n_sample, self.seed, score="score")
            d = d.select("idx", F.col("score"), F.lit(None).cast("double").alias("margin"),
                         F.col("pred").alias("label_text_pred"),
                         F.lit(None).cast("map<string,double>").alias("probs"),
                         F.lit(None).cast("map<string,double>").alias("probs_scaled"), "shuffle_rank")
        else:
            d = breaking_ties(sc, self.vocab, self.n_sample, self.seed, probs="probs")
            d = d.select("idx", F.lit(None).cast("double").alias("score"), "margin", "label_text_pred",
                         F.col("probs_named").alias("probs"), "probs_scaled", "shuffle_rank")
        write_iter(d.withColumn("iter", F.lit(r + 1)), self.path("samples"))
        out = read_iter(self.spark, self.path("samples"), r + 1)
        return out

    def update(self) -> RoundState:
        """K2: extend the train ids (set union), rebuild train with current
        labels, shrink the pool.

        The rows of the new draw are fetched from the corpus by a semi-join
        (one scan; the written draw is the small side) and kept in a
        per-round ``train_rows`` table.  Train is that table plus the seed
        rows, relabelled from the ledger."""
        r = self.state.iter + 1
        # train ids = every drawn id so far: a view over the sample history
        ids = self.train_ids(upto=r)
        drawn = read_iter(self.spark, self.path("samples"), r).select("idx")
        write_iter(L.rows_in(self.corpus, drawn).withColumn("iter", F.lit(r)), self.path("train_rows"))
        self._n_drawn_by_iter[r] = drawn.count()
        return self._rebuild(r, ids)

    def _rebuild(self, r: int, ids: DataFrame) -> RoundState:
        """State of round ``r`` from the written train rows and the id view:
        train = drawn rows (+ seed rows) with current ledger labels, pool =
        corpus minus the train ids."""
        rows = read_history(self.spark, self.path("train_rows")).filter(F.col("iter") <= r).drop("iter")
        latest = L.latest_annotation(self.annotations) if self.annotations is not None else None
        train = L.with_current_labels(rows, latest)
        if self.keep_seed_train and self.seed_train is not None:
            train = self.seed_train.unionByName(train)
        self.state = RoundState(r, L.pool_minus(self.corpus, ids, by=self.membership), train, self.test, ids)
        return self.state

    def resume(self) -> RoundState:
        """Rebuild the state after a driver restart from the tables already
        written under ``out_dir`` (pass the same ``out_dir``): the last
        applied draw decides the round; train ids, train rows and the pool
        follow from the written draws.  A round that was only partly written
        is simply run again (its partitions are overwritten)."""
        if not exists(self.spark, self.path("train_rows")):
            return self.state
        last = read_history(self.spark, self.path("train_rows")).agg(F.max("iter").alias("m")).first()["m"]
        if last is None:
            return self.state
        ids = self.train_ids(upto=last)
        self._n_drawn_by_iter = {int(r["iter"]): int(r["n"]) for r in
                                 ids.groupBy("iter").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= rounds rows
        return self._rebuild(last, ids)

    def train_ids(self, upto: int | None = None) -> DataFrame:
        """(idx, iter): set union of all draws up to round ``upto``, each id
        with the round it first entered (H2)."""
        s = read_history(self.spark, self.path("samples")).select("idx", "iter")
        if upto is not None:
            s = s.filter(F.col("iter") <= upto)
        return L.union_train_ids(None, s)

    def run(self, n_rounds: int) -> "ActiveLearningRun":
        """K3: n rounds of run_round + draw + update, then the metrics of the
        model trained on the last draw: n + 1 metrics rows."""
        self.draws(n_rounds).run_round()
        return self

    def draws(self, n_rounds: int) -> "ActiveLearningRun":
        """n rounds of run_round + draw + update, the last model unfitted."""
        for _ in range(n_rounds):
            self.run_round()
            self.draw()
            self.update()
        return self

    # -- history views ---------------------------------------------------------
    def metrics_history(self) -> DataFrame:
        return read_history(self.spark, self.path("metrics"))

    def sample_history(self) -> DataFrame:
        return read_history(self.spark, self.path("samples"))

    def scored_history(self) -> DataFrame:
        return read_history(self.spark, self.path("scored"))
