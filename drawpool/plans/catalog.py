"""The registered queries: one per operator of the coverage checklist.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver's tables (through the adaptors), so work grows with the tables.
Float outputs are rounded to 6 digits and integers are BIGINT, the shape
the DuckDB oracle (``plans/oracle.py``) produces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import labels as LB
from ..operators import ledger as L
from ..operators import nli as N
from ..operators import sampling as SM
from ..session import materialize
from ..operators.strategies import breaking_ties, margin_scores, min_certainty
from ..sources import adaptors as A
from ..sources.contracts import contract_summary
from . import scorers as SC
from .blocked import BlockedCentroids
from .postings import PostingsNLI
from .text_batches import TextBatches, word_count_predict_fn
from .rounds import ActiveLearningRun

# ---- fixed query parameters -------------------------------------------------
N_TRAIN_VEC = 100        # seed train rows of the vector pool
N_DRAW = 20              # rows per draw
N_DRAW_ZERO_SHOT = 10    # rows per draw in the zero-shot NLI round
N_ROUNDS = 3             # rounds of the round-driver queries
N_TEST_SLOT = 60         # rows of the test slot
N_UNIFORM = 200          # uniform draw (test: half)
N_LEDGER_TRAIN = 20      # train ids drawn from the ledger pool
TOKEN_BUDGET = 64        # single-text and pair token budgets
HEAD_ROWS = 50           # prediction listing
TASK_LABELS = ["q0_t0", "q1_t0", "q1_t1"]   # whitelist of the label filter
DIGITS = 6
# -----------------------------------------------------------------------------

Q = {}


def query(fn=None, *, name=None):
    """Register a query under its function name (or ``name``)."""
    def reg(f):
        Q[name or f.__name__] = f
        return f
    return reg(fn) if fn is not None else reg


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Put several one-row aggregates into one row: union them in long form
    and pivot with a single aggregate (no join between them)."""
    long = None
    for df in rows:
        part = df.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]),
            F.array(*[F.col(c).cast("long") for c in df.columns]))).alias("k", "v"))
        long = part if long is None else long.unionByName(part)
    names = [c for df in rows for c in df.columns]
    return long.agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), DIGITS).alias(name) if name else F.round(c.cast("double"), DIGITS)


# ------------------------------------------------------------------ helpers
def vec_split(spark, sf):
    """Vector pool: seed train = first 100 by md5(42:idx), pool = the rest."""
    pv = A.pool_vec(spark, sf)
    train = SM.uniform_sample(pv, N_TRAIN_VEC, SM.SEED)
    pool = L.pool_minus(pv, train)
    return pv, train, pool


def vec_vocab(spark, sf) -> list[str]:
    return LB.vocab_list(A.pool_vec(spark, sf))


def vec_scored(spark, sf):
    """Round-0 centroid scores of the vector pool: idx, label_text, z, probs."""
    pv, train, pool = vec_split(spark, sf)
    vocab = LB.vocab_list(pv)
    model = SC.CentroidScorer(vocab).fit(train)
    return model.score(pool), vocab, train


def _metric_cols():
    return [r6(c, c) for c in E.METRIC_COLUMNS] + [F.col("n_rows").cast("long").alias("n_rows")]


def lang_scored(spark, sf):
    """NLI predictions of the language pool with the overlap scorer, row form
    (the K hypotheses are evaluated inside each row: no expansion, no shuffle)."""
    pl = A.pool_lang(spark, sf)
    return N.nli_predict(SC.OverlapNLIScorer(A.LANG_HYPOTHESES).score_rows(pl))


def lang_scored_pairs(spark, sf):
    """The same through the pair form: expand, score pairs, regroup by idx."""
    pl = A.pool_lang(spark, sf)
    pairs = SC.OverlapNLIScorer(A.LANG_HYPOTHESES).score_testset(pl)
    return N.nli_predict(N.regroup(pairs, ["z_entail", "z_not", "label"], len(A.LANG_HYPOTHESES)))


def gen_model(spark, sf, train=None):
    pg = A.pool_gen(spark, sf)
    return pg, SC.UnigramScorer(pg).fit(train)


def vec_run(spark, sf, **kw) -> ActiveLearningRun:
    """A round-driver run over the vector pool, not yet started."""
    from ..session import new_run_id, state_path
    pv, train, _ = vec_split(spark, sf)
    vocab = LB.vocab_list(pv)
    # the seed is written once; the corpus is derived from that table, so
    # no round re-derives the seed from a scan of the whole pool
    out_dir = state_path(spark, new_run_id())
    train.write.mode("overwrite").parquet(f"{out_dir}/seed_train")
    seed = spark.read.parquet(f"{out_dir}/seed_train")
    return ActiveLearningRun(spark, corpus=L.pool_minus(pv, seed), scorer=SC.CentroidScorer(vocab),
                             vocab=vocab, method="standard_dl", seed_train=seed, n_sample=N_DRAW,
                             keep_seed_train=True, out_dir=out_dir, materialize_seed=False, **kw)


# ------------------------------------------------------------- 2.A sources
@query
def pool_contract(spark, sf):
    parts = [contract_summary(A.pool_vec(spark, sf).withColumn("text", F.lit("")), "pool_vec"),
             contract_summary(A.pool_quality(spark, sf), "pool_quality"),
             contract_summary(A.pool_lang(spark, sf), "pool_lang"),
             contract_summary(A.pool_gen(spark, sf), "pool_gen")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", *[F.col(c).cast("long").alias(c) for c in
                                      ["n_rows", "n_idx", "n_null_idx", "n_null_text", "n_null_label"]])


@query
def metrics_history(spark, sf):
    m = vec_run(spark, sf).run(N_ROUNDS).metrics_history()
    return m.select(F.col("iter").cast("long").alias("iter"), *_metric_cols(),
                    F.col("n_train").cast("long").alias("n_train"))


@query
def sample_history(spark, sf):
    s = vec_run(spark, sf).draws(N_ROUNDS).sample_history()
    return s.select(F.col("iter").cast("long").alias("iter"), F.col("idx").cast("long").alias("idx"),
                    r6("margin", "margin"), "label_text_pred",
                    F.col("shuffle_rank").cast("long").alias("shuffle_rank"))


@query
def scored_long(spark, sf):
    s = vec_run(spark, sf).run(N_ROUNDS).scored_history()
    return s.select(F.col("iter").cast("long").alias("iter"), "split", F.col("idx").cast("long").alias("idx"),
                    "gold", "pred")


@query
def zip_csv_source(spark, sf):
    """Conversations written as zip archives of CSV (line ends, quotes and all)
    and read back through the archive source."""
    from ..session import new_run_id, state_path
    from ..sources.zipped import read_zip_csv, write_zip_csv
    turns = A.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    folder = state_path(spark, new_run_id(), "zip")
    write_zip_csv(turns, folder)
    back = read_zip_csv(spark, folder, turns.schema)
    return back.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ------------------------------------------------------------- 2.B labels/text
@query
def first_answer_default(spark, sf):
    return A.qa_with_label(spark, sf).select(F.col("idx").cast("long").alias("idx"), "label_text")


@query
def qa_prompt(spark, sf):
    q = A.qa(spark, sf)
    return q.select(F.col("idx").cast("long").alias("idx"),
                    T.qa_prompt("context", "question").alias("text_prepared"))


@query
def context_quote_prompt(spark, sf):
    q = A.quotes(spark, sf)
    return q.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    T.quote_prompt("text_preceding", "text_original", "text_following").alias("text_prepared"))


@query
def task_label_filter(spark, sf):
    return LB.filter_labels(A.pool_quality(spark, sf), TASK_LABELS).select(
        F.col("idx").cast("long").alias("idx"), "label_text")


@query
def label_codes_first_seen(spark, sf):
    pq = A.pool_quality(spark, sf)
    codes = LB.label_codes_first_seen(pq)
    return LB.attach_codes(pq, codes).select(F.col("idx").cast("long").alias("idx"), "label_text",
                                              F.col("label").cast("long").alias("label"))


@query
def label_codes_alpha(spark, sf):
    return LB.label_codes_alpha(A.pool_quality(spark, sf)).select(
        "label_text", F.col("code").cast("long").alias("code"))


@query
def answer_codes(spark, sf):
    """Codes of an open vocabulary (the first words of all documents), by
    alphabet and by first appearance."""
    pg = A.pool_gen(spark, sf).select("idx", "label_text")
    alpha = LB.label_codes_alpha(pg).withColumnRenamed("code", "alpha_code")
    both = alpha.join(LB.label_codes_first_seen(pg), on="label_text")
    return both.select("label_text", F.col("alpha_code").cast("long").alias("alpha_code"), F.col("code").cast("long").alias("first_code"))


@query
def label_vocab(spark, sf):
    v = LB.label_vocab(A.pool_quality(spark, sf))
    return v.select(F.array_join("vocab", ",").alias("vocab"), F.col("k").cast("long").alias("k"))


@query
def label_length_max(spark, sf):
    return LB.label_length_max(A.qa_with_label(spark, sf))


@query
def pred_vs_gold_head(spark, sf):
    sc, vocab, _ = vec_scored(spark, sf)
    voc = F.array(*[F.lit(v) for v in vocab])
    return (sc.select(F.col("idx").cast("long").alias("idx"),
                      F.element_at(voc, S.argmax("z") + 1).alias("label_text_pred"), "label_text")
            .orderBy("idx").limit(HEAD_ROWS))


@query
def token_budget_audit(spark, sf):
    pl = A.pool_lang(spark, sf)
    t = pl.select("idx", T.ws_tokens("text").alias("tok"))
    n = F.size("tok")
    kept = F.size(T.truncate_tokens("tok", TOKEN_BUDGET))
    return t.select(F.col("idx").cast("long").alias("idx"), n.cast("long").alias("n_tokens"),
                    kept.cast("long").alias("n_kept"), (n - kept).cast("long").alias("n_dropped"),
                    (n > TOKEN_BUDGET).cast("long").alias("truncated"))


@query
def pair_token_budget(spark, sf):
    pl = A.pool_lang(spark, sf).select("idx", F.size(T.ws_tokens("text")).alias("n_text"), "label_text")
    pairs = N.nli_testset(pl, A.LANG_HYPOTHESES, keep=("n_text",))
    pairs = pairs.withColumn("n_hypo", F.size(T.ws_tokens("hypothesis")))
    ka, kb = T.pair_budget("n_text", "n_hypo", TOKEN_BUDGET)
    return pairs.select(F.col("idx").cast("long").alias("idx"), F.col("hypo_pos").cast("long").alias("hypo_pos"),
                        F.col("n_text").cast("long").alias("n_text"), F.col("n_hypo").cast("long").alias("n_hypo"),
                        ka.alias("keep_text"), kb.alias("keep_hypo"))


# ------------------------------------------------------------- 2.C joins
@query
def pool_minus_train(spark, sf):
    pv, train, _ = vec_split(spark, sf)
    pool = L.pool_minus(pv.select("idx", "label_text"), train, by="bitmap")
    return pool.select(F.col("idx").cast("long").alias("idx"), "label_text")


@query
def train_rows_current(spark, sf):
    lp = A.ledger_pool(spark, sf)
    ids = SM.uniform_sample(lp, N_LEDGER_TRAIN, SM.SEED).select("idx")
    latest = L.latest_annotation(A.ledger(spark, sf))
    tr = L.train_rows_current(lp.withColumn("label_orig", F.col("label_text")), ids, latest)
    return tr.select(F.col("idx").cast("long").alias("idx"), "label_text", "label_orig")


@query
def test_minus_corpus(spark, sf):
    drawn = SM.split_draws(A.pool_quality(spark, sf).select("idx", "label_text"))
    return drawn.where("in_test").select(F.col("idx").cast("long").alias("idx"), "label_text")


@query
def nli_trainset(spark, sf):
    tr = N.nli_trainset(A.pool_quality(spark, sf), A.QUALITY_HYPOTHESES, SM.SEED)
    return tr.select(F.col("idx").cast("long").alias("idx"), F.col("hypo_pos").cast("long").alias("hypo_pos"),
                     F.col("label").cast("long").alias("label"))


@query
def nli_trainset_shared(spark, sf):
    """The same with one order of the rows for all hypotheses: every negative
    set's histogram is that of all rows minus that of its own label."""
    tr = N.nli_trainset(A.pool_lang(spark, sf), A.LANG_HYPOTHESES, SM.SEED, order="shared")
    return tr.select(F.col("idx").cast("long").alias("idx"), F.col("hypo_pos").cast("long").alias("hypo_pos"),
                     F.col("label").cast("long").alias("label"))


@query
def nli_testset(spark, sf):
    ts = N.nli_testset(A.pool_lang(spark, sf), A.LANG_HYPOTHESES)
    return ts.select(F.col("idx").cast("long").alias("idx"), F.col("hypo_pos").cast("long").alias("hypo_pos"),
                     F.col("label").cast("long").alias("label"))


@query
def annotation_latest(spark, sf):
    la = L.latest_annotation(A.ledger(spark, sf))
    return la.select(F.col("idx").cast("long").alias("idx"), "label",
                     F.col("n_annotations").cast("long").alias("n_annotations"))


@query
def annotation_stream_latest(spark, sf):
    """C6 fed by Structured Streaming: the events table is read as a file
    stream of annotations, appended to a ledger with foreachBatch, and the
    latest label per id is computed from that ledger."""
    from ..session import new_run_id, state_path
    from ..streaming.ledger_feed import annotation_stream, latest_from_ledger, start_ledger_feed
    from pyspark.sql import types as T
    ev_schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                              T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])
    stream = annotation_stream(spark, sf, ev_schema, glob="events.parquet").select(
        F.col("user_id").alias("idx"), F.col("event_type").alias("label"), "ts",
        F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("annotator"))
    base = state_path(spark, new_run_id())
    q = start_ledger_feed(stream, f"{base}/ledger", f"{base}/ledger_ckpt")
    q.awaitTermination()
    la = latest_from_ledger(spark, f"{base}/ledger")
    return la.select(F.col("idx").cast("long").alias("idx"), "label",
                     F.col("n_annotations").cast("long").alias("n_annotations"))


#: The ledger is fed in three parts, the later ones first.
FEEDS = (2, 0, 1)


def _label_state(spark):
    from ..session import new_run_id, state_path
    from ..streaming.label_state import LabelState
    return LabelState(spark, state_path(spark, new_run_id()))


def _feeds(spark, sf):
    from ..streaming.label_state import annotation_events
    lg = A.ledger(spark, sf)
    return [annotation_events(lg.where(F.col("seq") % len(FEEDS) == k)) for k in FEEDS]


@query
def annotation_state(spark, sf):
    """C6 as keyed state: three feeds out of order, each a new start of the
    stream from its checkpoint; the second feed comes twice."""
    state, feeds = _label_state(spark), _feeds(spark, sf)
    for f in (*feeds, feeds[1]):
        state.add(f)
        state.advance()
    return state.latest().select(F.col("idx").cast("long").alias("idx"), "label")


@query
def metrics_by_retraction(spark, sf):
    """Metrics after each feed of revised annotations against fixed
    predictions (the first label of each id), from signed counts alone."""
    from ..streaming.label_state import prediction_events
    state, out = _label_state(spark), None
    state.add(prediction_events(A.ledger_pool(spark, sf).select("idx", F.col("label_text").alias("pred")), 0))
    for k, f in enumerate(_feeds(spark, sf)):
        state.add(f)
        state.advance()
        row = materialize(state.metrics().select(F.lit(k).cast("long").alias("feed"), *_metric_cols()), "metrics")
        out = row if out is None else out.unionByName(row)
    return out


@query
def merge_predictions(spark, sf):
    sc, vocab, _ = vec_scored(spark, sf)
    voc = F.array(*[F.lit(v) for v in vocab])
    preds = sc.select("idx", F.element_at(voc, S.argmax("probs") + 1).alias("label_text_pred"),
                      F.array_max("probs").alias("prob_pred"), "probs")
    _, _, pool = vec_split(spark, sf)
    # every pool column, the prediction, and each class's probability
    m = L.merge_predictions(pool, preds)
    m = m.select("*", F.posexplode("probs").alias("pos", "p"))
    return m.select(F.col("idx").cast("long").alias("idx"), "label_text", F.size("features").cast("long").alias("n_features"),
                    r6(S.array_sum("features"), "sum_features"), "label_text_pred", r6("prob_pred", "prob_pred"),
                    F.col("pos").cast("long").alias("pos"), r6("p", "prob"))


# ------------------------------------------------------------- 2.D evaluation
@query
def label_distribution(spark, sf):
    return LB.label_distribution(A.pool_quality(spark, sf)).select(
        "label_text", F.col("n").cast("long").alias("n"))


@query
def round_counts(spark, sf):
    pl = A.pool_lang(spark, sf)
    corpus = N.nli_testset(pl, A.LANG_HYPOTHESES)
    train_ids = SM.uniform_sample(pl, 100, SM.SEED).select("idx")
    new_pool = L.pool_minus(corpus, train_ids)
    a = corpus.agg(F.count(F.lit(1)).alias("n_corpus_rows"), F.count_distinct("idx").alias("n_corpus_idx"))
    b = train_ids.agg(F.count_distinct("idx").alias("n_train"))
    c = new_pool.agg(F.count_distinct("idx").alias("n_pool"))
    return side_by_side(a, b, c)


def _vec_gold_pred(spark, sf, use="logits"):
    sc, vocab, _ = vec_scored(spark, sf)
    voc = F.array(*[F.lit(v) for v in vocab])
    if use == "logits":
        pred = F.element_at(voc, S.argmax("z") + 1)
    else:
        pred = S.label_of_max(S.round_probs("probs"), voc)
    return sc.select("idx", F.col("label_text").alias("gold"), pred.alias("pred")), vocab


@query
def confusion_counts(spark, sf):
    gp, _ = _vec_gold_pred(spark, sf)
    return E.confusion(gp).select("gold", "pred", F.col("n").cast("long").alias("n"))


@query
def eval_metrics(spark, sf):
    gp, _ = _vec_gold_pred(spark, sf, use="probs")
    return E.eval_metrics(gp).select(*_metric_cols())


@query
def class_report(spark, sf):
    gp, vocab = _vec_gold_pred(spark, sf)
    rep = E.class_report(E.confusion(gp), vocab)
    return rep.select("label_text", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"),
                      F.col("support").cast("long").alias("support"))


@query
def class_report_open(spark, sf):
    """The report over an open vocabulary: all gold answers, kept as a table."""
    gp = _gen_gold_pred(spark, sf)
    conf = materialize(E.confusion(gp), "confusion")
    rep = E.class_report(conf, conf.select("gold"))
    return rep.select("label_text", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"),
                      F.col("support").cast("long").alias("support"))


def _gen_gold_pred(spark, sf):
    """Gold (first word) and predicted answer side by side, one projection."""
    pg = A.pool_gen(spark, sf).withColumnRenamed("label_text", "gold")
    return SC.answer_predictions(pg, keep=("gold",))


@query
def eval_open_vocab(spark, sf):
    return E.eval_metrics(_gen_gold_pred(spark, sf)).select(*_metric_cols())


@query
def nli_regroup(spark, sf):
    p = lang_scored_pairs(spark, sf)
    return p.select(F.col("idx").cast("long").alias("idx"), F.col("n_hypo").cast("long").alias("n_hypo"),
                    F.col("pred_pos").cast("long").alias("pred_pos"),
                    F.col("gold_pos").cast("long").alias("gold_pos"))


@query
def learning_curve(spark, sf):
    run = vec_run(spark, sf).run(N_ROUNDS)
    lc = E.learning_curve(run.metrics_history(), run.sample_history())
    return lc.select(F.col("iter").cast("long").alias("iter"), F.col("n_labels").cast("long").alias("n_labels"),
                     *[r6(c, c) for c in E.METRIC_COLUMNS])


@query
def nli_eval(spark, sf):
    p = lang_scored(spark, sf)
    return E.eval_metrics(p.select(F.col("gold_pos").alias("gold"), F.col("pred_pos").alias("pred"))) \
        .select(*_metric_cols())


@query
def standard_eval(spark, sf):
    gp, _ = _vec_gold_pred(spark, sf, use="logits")
    return E.eval_metrics(gp).select(*_metric_cols())


@query
def generation_eval(spark, sf):
    return E.eval_metrics(_gen_gold_pred(spark, sf), digits=3).select(*_metric_cols())


# ------------------------------------------------------------- 2.F ranking
@query(name="min_certainty")
def min_certainty_draw(spark, sf):
    pg, model = gen_model(spark, sf)
    sc = model.score(pg, with_pred=False)
    d = min_certainty(sc, N_DRAW, SM.SEED, score="score")
    return d.select(F.col("idx").cast("long").alias("idx"), r6("score", "score"),
                    F.col("score_rank").cast("long").alias("score_rank"),
                    F.col("shuffle_rank").cast("long").alias("shuffle_rank"))


@query(name="breaking_ties")
def breaking_ties_draw(spark, sf):
    sc, vocab, _ = vec_scored(spark, sf)
    d = breaking_ties(sc, vocab, N_DRAW, SM.SEED)
    return d.select(F.col("idx").cast("long").alias("idx"), r6("margin", "margin"), "label_text_pred",
                    F.col("margin_rank").cast("long").alias("margin_rank"),
                    F.col("shuffle_rank").cast("long").alias("shuffle_rank"))


@query
def breaking_ties_half(spark, sf):
    """Half of the language pool by breaking ties under the word-overlap
    scorer, whose margins tie for most texts: a draw by radix cutoffs."""
    pl = A.pool_lang(spark, sf)
    p = N.nli_predict(SC.OverlapNLIScorer(A.LANG_HYPOTHESES).score_rows(pl, label=None)).select("idx", F.col("p_entail").alias("probs"))
    p = materialize(p, "scored")
    n = max(1, p.count() // 2)
    d = breaking_ties(p, sorted(A.LANG_HYPOTHESES), n, SM.SEED, strategy="radix")
    return d.select(F.col("idx").cast("long").alias("idx"), r6("margin", "margin"), "label_text_pred",
                    F.col("margin_rank").cast("long").alias("margin_rank"), F.col("shuffle_rank").cast("long").alias("shuffle_rank"))


@query(name="margin_scores")
def margin_scores_all(spark, sf):
    sc, vocab, _ = vec_scored(spark, sf)
    m = margin_scores(sc, vocab)
    return m.select(F.col("idx").cast("long").alias("idx"), r6("margin", "margin"), "label_text_pred")


@query
def shuffled_sample(spark, sf):
    _, train, _ = vec_split(spark, sf)
    # another seed than the draw's, whose order the rows would keep
    return SM.shuffle_rank(train.select("idx"), SM.SEED_TEST, n_max=N_TRAIN_VEC).select(
        F.col("idx").cast("long").alias("idx"), F.col("shuffle_rank").cast("long").alias("shuffle_rank"))


def _blocked(scored):
    return scored.select(F.col("idx").cast("long").alias("idx"), "pred", F.col("pred_pos").cast("long").alias("pred_pos"), r6("prob", "prob"), r6("margin", "margin"))


@query
def blocked_margins(spark, sf):
    """The margins of the vector pool with the classes in a table, four to a block."""
    pv, train, pool = vec_split(spark, sf)
    model = BlockedCentroids.fit(train, pv.select("label_text"), block=4)
    return _blocked(model.score(pool))


@query
def blocked_instances(spark, sf):
    """Every training vector a class of its own: blocks of 32 classes."""
    _, train, pool = vec_split(spark, sf)
    train = train.withColumn("label_text", F.lpad(F.col("idx").cast("string"), 12, "0"))
    return _blocked(BlockedCentroids.fit(train, block=32).score(pool))


@query
def scaled_probs(spark, sf):
    sc, vocab, _ = vec_scored(spark, sf)
    d = breaking_ties(sc, vocab, N_DRAW, SM.SEED)
    ex = d.select("idx", F.explode("probs_named").alias("label_text", "prob"),
                  F.col("probs_scaled").alias("_s"))
    return ex.select(F.col("idx").cast("long").alias("idx"), "label_text", r6("prob", "prob"),
                     r6(F.element_at("_s", F.col("label_text")), "prob_scaled"))


# ------------------------------------------------------------- 2.G sampling
@query
def uniform_sample(spark, sf):
    pq = A.pool_quality(spark, sf)
    c = SM.uniform_sample(pq, N_UNIFORM, SM.SEED).withColumn("split", F.lit("corpus"))
    t = SM.uniform_sample(pq, N_UNIFORM // 2, SM.SEED_TEST).withColumn("split", F.lit("test"))
    return c.unionByName(t).select(F.col("idx").cast("long").alias("idx"), "label_text", "split")


@query
def stratified_sample(spark, sf):
    s = SM.stratified_sample(A.pool_quality(spark, sf), SM.STRATA_CAP, SM.SEED, rank_col="rank")
    return s.select(F.col("idx").cast("long").alias("idx"), "label_text", F.col("rank").cast("long").alias("rank"))


@query
def corpus_test_split(spark, sf):
    drawn = SM.split_draws(A.pool_quality(spark, sf).select("idx", "label_text")).where("in_corpus OR in_test")
    return drawn.select(F.col("idx").cast("long").alias("idx"), "label_text", F.when(F.col("in_corpus"), "corpus").otherwise("test").alias("split"))


@query
def seed_train_overlap(spark, sf):
    drawn = SM.split_draws(A.pool_quality(spark, sf).select("idx", "label_text")).where("in_seed_train")
    return drawn.select(F.col("idx").cast("long").alias("idx"), "label_text", F.col("in_corpus").cast("long").alias("in_corpus"), F.col("in_test").cast("long").alias("in_test"))


# ------------------------------------------------------------- 2.H set ops
@query
def train_ids_union(spark, sf):
    pq = A.pool_quality(spark, sf)
    d1 = SM.uniform_sample(pq, 50, SM.SEED).select("idx", F.lit(1).alias("iter"))
    d2 = SM.uniform_sample(pq, 50, SM.SEED_TEST).select("idx", F.lit(2).alias("iter"))
    u = L.union_train_ids(L.union_train_ids(None, d1), d2)
    return u.select(F.col("idx").cast("long").alias("idx"), F.col("iter").cast("long").alias("iter"))


@query
def train_plus_scored(spark, sf):
    sc, vocab, train = vec_scored(spark, sf)
    voc = F.array(*[F.lit(v) for v in vocab])
    scored = sc.select("idx", "label_text", F.element_at(voc, S.argmax("z") + 1).alias("label_text_pred"), "probs")
    u = L.train_plus_scored(train.select("idx", "label_text"), scored)
    # the probabilities in long form; a train row has none
    u = u.select(F.col("idx").cast("long").alias("idx"), "split", "label_text", "label_text_pred", F.posexplode_outer("probs").alias("pos", "p"))
    return u.select("idx", "split", "label_text", "label_text_pred", F.col("pos").cast("long").alias("pos"), r6("p", "prob"))


# ------------------------------------------------------------- 2.I scores
@query
def softmax_probs(spark, sf):
    sc, _, _ = vec_scored(spark, sf)
    return sc.select(F.col("idx").cast("long").alias("idx"), F.posexplode("probs").alias("pos", "p")) \
        .select("idx", F.col("pos").cast("long").alias("pos"), r6("p", "prob"))


@query
def argmax_label(spark, sf):
    sc, vocab, _ = vec_scored(spark, sf)
    voc = F.array(*[F.lit(v) for v in vocab])
    return sc.select(F.col("idx").cast("long").alias("idx"), S.argmax("z").cast("long").alias("pred_pos"),
                     F.element_at(voc, S.argmax("z") + 1).alias("label_text_pred"))


@query
def nli_predict(spark, sf):
    p = lang_scored(spark, sf)
    ex = p.select("idx", "pred_pos", "gold_pos", F.posexplode("p_entail").alias("hypo_pos", "pe"))
    return ex.select(F.col("idx").cast("long").alias("idx"), F.col("hypo_pos").cast("long").alias("hypo_pos"),
                     r6("pe", "p_entail"),
                     (F.col("hypo_pos") == F.col("pred_pos")).cast("long").alias("is_pred"),
                     (F.col("hypo_pos") == F.col("gold_pos")).cast("long").alias("is_gold"))


@query
def sequence_score(spark, sf):
    pg, model = gen_model(spark, sf)
    return model.score(pg, with_pred=False).select(F.col("idx").cast("long").alias("idx"), r6("score", "score"))


@query
def naive_certainty(spark, sf):
    pv = A.pool_vec(spark, sf)
    # steps = consecutive pairs of vector entries
    steps = F.transform(F.sequence(F.lit(0), (F.floor(F.size("features") / 2) - 1).cast("int")),
                        lambda i: F.slice("features", (i * 2 + 1).cast("int"), 2))
    return pv.select(F.col("idx").cast("long").alias("idx"), r6(S.naive_certainty(steps), "certainty"))


# ------------------------------------------------------------- 2.J scorers
@query
def centroid_logits(spark, sf):
    sc, _, _ = vec_scored(spark, sf)
    return sc.select(F.col("idx").cast("long").alias("idx"), F.posexplode("z").alias("pos", "z")) \
        .select("idx", F.col("pos").cast("long").alias("pos"), r6("z", "logit"))


@query
def score_batch_udf(spark, sf):
    pv, train, pool = vec_split(spark, sf)
    vocab = LB.vocab_list(pv)
    dim = len(pv.select("features").first()["features"])
    model = SC.BatchUDFScorer(SC.centroid_predict_fn_factory(vocab), k=len(vocab), dim=dim).fit(train)
    sc = model.score(pool)
    return sc.select(F.col("idx").cast("long").alias("idx"), F.posexplode("z").alias("pos", "z")) \
        .select("idx", F.col("pos").cast("long").alias("pos"), r6("z", "logit"))


@query
def score_text_batches(spark, sf):
    """A user's model over whole texts in batches by length: how often the
    words of each language's hypothesis occur."""
    lists = [h.split() for _, _, h in N.hypotheses(A.LANG_HYPOTHESES)]
    sc = TextBatches(word_count_predict_fn(lists)).score(A.pool_lang(spark, sf).select("idx", "text"))
    return sc.select(F.col("idx").cast("long").alias("idx"), F.posexplode("z").alias("pos", "z")).select("idx", F.col("pos").cast("long").alias("pos"), r6("z", "logit"))


@query
def unigram_step_scores(spark, sf):
    pg, model = gen_model(spark, sf)
    st = model.step_scores(pg)
    return st.select(F.col("idx").cast("long").alias("idx"), F.col("pos").cast("long").alias("pos"),
                     r6("step", "step"))


@query
def nli_overlap_logits(spark, sf):
    pairs = SC.OverlapNLIScorer(A.LANG_HYPOTHESES).score_pairs(A.pool_lang(spark, sf))
    return pairs.select(F.col("idx").cast("long").alias("idx"), F.col("hypo_pos").cast("long").alias("hypo_pos"),
                        r6("z_entail", "z_entail"), r6("z_not", "z_not"))


def _postings(rows, hypos):
    out = PostingsNLI(hypos).predict(rows)
    return out.select(F.col("idx").cast("long").alias("idx"), "pred_pos", r6("z_entail", "z_entail"), "n_shared", r6("margin", "margin"))


@query
def nli_postings(spark, sf):
    """The language hypotheses as a table, scored through their posting lists."""
    hypos = spark.createDataFrame([(p, h) for p, _, h in N.hypotheses(A.LANG_HYPOTHESES)], "hypo_pos int, hypothesis string")
    return _postings(A.pool_lang(spark, sf).select("idx", "text"), hypos)


@query
def nli_postings_open(spark, sf):
    """Every first word of a document is a hypothesis: as many as there are
    answers, in a table that grows with the documents."""
    pg = A.pool_gen(spark, sf)
    hypos = LB.label_codes_alpha(pg).select(F.col("code").alias("hypo_pos"), F.col("label_text").alias("hypothesis"))
    return _postings(pg.select("idx", "text"), hypos)


def _round_run(spark, pool, scorer, vocab, **kw) -> ActiveLearningRun:
    from ..session import new_run_id, state_path
    return ActiveLearningRun(spark, corpus=pool, scorer=scorer, vocab=vocab, out_dir=state_path(spark, new_run_id()), **kw)


@query
def zero_shot_round(spark, sf):
    """An NLI round of the driver before there is any train table."""
    vocab = sorted(A.LANG_HYPOTHESES)
    run = _round_run(spark, A.pool_lang(spark, sf), SC.OverlapNLIScorer(A.LANG_HYPOTHESES), vocab,
                     method="nli", hypo_label_dic=A.LANG_HYPOTHESES, n_sample=N_DRAW_ZERO_SHOT)
    run.run_round()
    d = run.draw()
    return d.select(F.col("idx").cast("long").alias("idx"), r6("margin", "margin"), "label_text_pred",
                    F.col("shuffle_rank").cast("long").alias("shuffle_rank"))


@query
def generation_round(spark, sf):
    """A generation round of the driver: gold, answer and sequence score."""
    pg = A.pool_gen(spark, sf)
    run = _round_run(spark, pg, SC.UnigramScorer(pg), ["unused"], method="generation", n_sample=N_DRAW)
    run.run_round()
    return run.scored_history().select(F.col("idx").cast("long").alias("idx"), "gold", "pred", r6("score", "score"))


@query
def test_slot_round(spark, sf):
    """A round with a test slot: the scored rows of both slots."""
    pv, train, pool = vec_split(spark, sf)
    vocab = LB.vocab_list(pv)
    test = SM.uniform_sample(pool, N_TEST_SLOT, SM.SEED_TEST)
    run = _round_run(spark, L.pool_minus(pool, test), SC.CentroidScorer(vocab), vocab, method="standard_dl", seed_train=train, test=test)
    run.run_round()
    s = run.scored_history().select("split", F.col("idx").cast("long").alias("idx"), "gold", "pred", F.posexplode("probs").alias("pos", "p"))
    return s.select("split", "idx", "gold", "pred", F.col("pos").cast("long").alias("pos"), r6("p", "prob"))


@query
def test_slot_metrics(spark, sf):
    """The metrics row of a round with a test slot."""
    pv, train, pool = vec_split(spark, sf)
    vocab = LB.vocab_list(pv)
    test = SM.uniform_sample(pool, N_TEST_SLOT, SM.SEED_TEST)
    run = _round_run(spark, L.pool_minus(pool, test), SC.CentroidScorer(vocab), vocab, method="standard_dl", seed_train=train, test=test)
    return run.run_round().select(*_metric_cols())


@query
def fit_score_vectors(spark, sf):
    pv, train, pool = vec_split(spark, sf)
    vocab = LB.vocab_list(pv)
    model = SC.LogisticScorer(vocab).fit(train)
    return _fit_checks(model.score(pool), vocab)


def _fit_checks(scored: DataFrame, vocab: list[str]) -> DataFrame:
    """What every fitted classifier's rows must hold: K probabilities that
    sum to 1, and a prediction that has the largest of them."""
    voc = F.array(*[F.lit(v) for v in vocab])
    pred = F.element_at(voc, S.argmax("probs") + 1)
    at = F.element_at(F.col("probs"), F.array_position(voc, pred).cast("int"))
    return scored.select(F.col("idx").cast("long").alias("idx"), F.size("probs").cast("long").alias("n_probs"),
                         r6(S.array_sum("probs"), "prob_sum"), (at == F.array_max("probs")).cast("long").alias("pred_has_max"))


@query
def fit_score_text(spark, sf):
    pq = A.pool_quality(spark, sf)
    vocab = LB.vocab_list(pq)
    train = SM.uniform_sample(pq, N_UNIFORM, SM.SEED)
    pool = L.pool_minus(pq, train)
    model = SC.LogisticScorer(vocab, features="text", text=True, params={"maxIter": 20},
                              num_hash_features=1 << 16).fit(train)
    return _fit_checks(model.score(pool), vocab)


# ------------------------------------------------------------- 2.K rounds
@query
def al_one_round(spark, sf):
    m = vec_run(spark, sf).run_round()
    return m.select(F.col("iter").cast("long").alias("iter"), *_metric_cols(),
                    F.col("n_train").cast("long").alias("n_train"))


@query
def update_round(spark, sf):
    """Train rows and pool in the driver's state after one draw and update."""
    state = vec_run(spark, sf, membership="bitmap").draws(1).state
    a = state.train.agg(F.count_distinct("idx").alias("n_train"))
    b = state.corpus.agg(F.count(F.lit(1)).alias("n_pool"))
    return side_by_side(a, b)


@query
def al_rounds(spark, sf):
    run = vec_run(spark, sf).draws(N_ROUNDS)
    ids = run.train_ids()
    return ids.select(F.col("idx").cast("long").alias("idx"), F.col("iter").cast("long").alias("iter"))
