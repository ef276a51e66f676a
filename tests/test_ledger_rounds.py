"""Ledger upkeep and the round driver (FIXTURES 20, 21; C1-C6, H2, K1-K3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from drawpool.operators import labels as LB
from drawpool.operators import ledger as L
from drawpool.plans import scorers as SC
from drawpool.plans.rounds import ActiveLearningRun
from drawpool.operators import sampling as SM
from drawpool.sources import adaptors as A
from conftest import SF001


def test_latest_annotation_wins(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    led = spark.createDataFrame([(1, "x", t1, 1, 0), (1, "y", t2, 2, 0), (2, "z", t1, 3, 0)],
                                "idx long, label string, ts timestamp, seq long, annotator long")
    latest = {r.idx: r.label for r in L.latest_annotation(led).collect()}
    assert latest == {1: "y", 2: "z"}
    orig = spark.createDataFrame([(1, "t", "x"), (2, "u", "z"), (3, "v", "w")], "idx long, text string, label_text string")
    ids = spark.createDataFrame([(1,)], "idx long")
    tr = L.train_rows_current(orig, ids, L.latest_annotation(led)).collect()
    assert [(r.idx, r.label_text) for r in tr] == [(1, "y")]


def test_union_is_idempotent(spark):
    draw = spark.createDataFrame([(3, 1), (1, 1)], "idx long, iter int")
    once = L.union_train_ids(None, draw)
    twice = L.union_train_ids(once, draw)
    assert sorted(tuple(r) for r in twice.collect()) == [(1, 1), (3, 1)]
    pool = spark.createDataFrame([(i,) for i in range(1, 6)], "idx long")
    assert sorted(r.idx for r in L.pool_minus(L.pool_minus(pool, once), twice).collect()) == [2, 4, 5]


def test_train_plus_scored_missing_columns(spark):
    tr = spark.createDataFrame([(1, "a")], "idx long, label_text string")
    sc = spark.createDataFrame([(2, "b")], "idx long, label_text_pred string")
    rows = {r.idx: r for r in L.train_plus_scored(tr, sc).collect()}
    assert rows[1].label_text_pred is None and rows[2].label_text is None


def _vec_setup(spark):
    pv = A.pool_vec(spark, SF001)
    train = SM.uniform_sample(pv, 50)
    pool = L.pool_minus(pv, train)
    return pv, train, pool, LB.vocab_list(pv)


@pytest.mark.parametrize("keep_seed", [True, False])
def test_rounds_keep_pool_and_train_disjoint(spark, keep_seed):
    pv, train, pool, vocab = _vec_setup(spark)
    run = ActiveLearningRun(spark, corpus=pool, scorer=SC.CentroidScorer(vocab), vocab=vocab,
                            method="standard_dl", seed_train=train, n_sample=10, keep_seed_train=keep_seed)
    run.run(2)
    st = run.state
    pool_ids = {r.idx for r in st.corpus.collect()}
    drawn = {r.idx for r in st.train_ids.collect()}
    assert len(drawn) == 20 and not (pool_ids & drawn)
    assert pool_ids | drawn == {r.idx for r in pool.collect()}
    n_train = st.train.count()
    assert n_train == (70 if keep_seed else 20)
    mh = run.metrics_history().orderBy("iter").collect()
    assert [r.iter for r in mh] == [0, 1, 2]  # the model trained on the last draw is evaluated too
    assert mh[0].n_train == 50
    sh = run.sample_history()
    assert sorted(r.iter for r in sh.select("iter").distinct().collect()) == [1, 2]


def test_rounds_rerun_round_is_idempotent(spark):
    pv, train, pool, vocab = _vec_setup(spark)
    run = ActiveLearningRun(spark, corpus=pool, scorer=SC.CentroidScorer(vocab), vocab=vocab,
                            seed_train=train, n_sample=10)
    run.run_round()
    a = sorted(tuple(r) for r in run.draw().select("idx", "shuffle_rank").collect())
    run.run_round()   # re-running round 0 overwrites its partitions only
    b = sorted(tuple(r) for r in run.draw().select("idx", "shuffle_rank").collect())
    assert a == b
    assert run.metrics_history().count() == 1


def test_standard_needs_seed_train(spark):
    pv, train, pool, vocab = _vec_setup(spark)
    run = ActiveLearningRun(spark, corpus=pool, scorer=SC.CentroidScorer(vocab), vocab=vocab)
    with pytest.raises(ValueError):
        run.run_round()


def test_generation_and_nli_rounds(spark):
    pg = A.pool_gen(spark, SF001)
    vocab_g = ["unused"]
    run = ActiveLearningRun(spark, corpus=pg, scorer=SC.UnigramScorer(pg), vocab=vocab_g,
                            method="generation", n_sample=5)
    run.run(2)
    m = run.metrics_history().orderBy("iter").collect()
    assert len(m) == 3 and all(round(r.f1_micro, 3) == r.f1_micro for r in m)
    pl = A.pool_lang(spark, SF001)
    run = ActiveLearningRun(spark, corpus=pl, scorer=SC.OverlapNLIScorer(A.LANG_HYPOTHESES),
                            vocab=sorted(A.LANG_HYPOTHESES), method="nli",
                            hypo_label_dic=A.LANG_HYPOTHESES, n_sample=5)
    run.run(1)
    assert run.sample_history().count() == 5
    assert run.metrics_history().first().accuracy > 0.5


def test_unknown_method():
    with pytest.raises(ValueError):
        SC.resolve_method("nsp")


def test_stream_ledger_equals_batch(spark):
    import __spark_entry__ as E
    a = sorted(tuple(r) for r in E.queries()["annotation_stream_latest"](spark, SF001).collect())
    b = sorted(tuple(r) for r in E.queries()["annotation_latest"](spark, SF001).collect())
    assert a == b and len(a) > 0


def test_rounds_use_revised_annotations(spark):
    """K5/C6 in the loop: a drawn id whose label was revised in the ledger
    enters train with the revised label."""
    pv, train, pool, vocab = _vec_setup(spark)
    run = ActiveLearningRun(spark, corpus=pool, scorer=SC.CentroidScorer(vocab), vocab=vocab,
                            seed_train=train, n_sample=5, keep_seed_train=False)
    run.run_round()
    drawn = [r.idx for r in run.draw().collect()]
    target = drawn[0]
    old = pool.filter(F.col("idx") == target).first().label_text
    new = [v for v in vocab if v != old][0]
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    run.annotations = spark.createDataFrame([(target, old, t1, 1, 0), (target, new, t2, 2, 1)],
                                            "idx long, label string, ts timestamp, seq long, annotator long")
    st = run.update()
    labels = {r.idx: r.label_text for r in st.train.collect()}
    assert set(labels) == set(drawn) and labels[target] == new


def test_resume_after_driver_restart(spark):
    pv, train, pool, vocab = _vec_setup(spark)
    kw = dict(corpus=pool, scorer=SC.CentroidScorer(vocab), vocab=vocab, seed_train=train, n_sample=10)
    full = ActiveLearningRun(spark, **kw)
    full.run(3)
    part = ActiveLearningRun(spark, **kw)
    part.run(1)
    again = ActiveLearningRun(spark, out_dir=part.out_dir, **kw)   # a new driver, same folder
    st = again.resume()
    assert st.iter == 1 and st.train.count() == 60
    again.run(2)
    a = sorted((r.iter, r.idx) for r in full.sample_history().collect())
    b = sorted((r.iter, r.idx) for r in again.sample_history().collect())
    assert a == b


def test_metrics_from_test_split_when_present(spark):
    pv, train, pool, vocab = _vec_setup(spark)
    test = SM.uniform_sample(pool, 60, seed=84)
    corpus = L.pool_minus(pool, test)
    run = ActiveLearningRun(spark, corpus=corpus, scorer=SC.CentroidScorer(vocab), vocab=vocab,
                            seed_train=train, test=test, n_sample=5)
    m = run.run_round().first()
    assert m.n_rows == 60
    splits = {r.split: r["count"] for r in run.scored_history().groupBy("split").count().collect()}
    assert splits == {"test": 60, "corpus": corpus.count()}


def test_rounds_without_scored_history_match(spark):
    pv, train, pool, vocab = _vec_setup(spark)
    kw = dict(corpus=pool, scorer=SC.CentroidScorer(vocab), vocab=vocab, seed_train=train, n_sample=10)
    a = ActiveLearningRun(spark, **kw).run(2)
    b = ActiveLearningRun(spark, persist_scored=False, **kw).run(2)
    key = lambda run: sorted((r.iter, r.idx, r.shuffle_rank) for r in run.sample_history().collect())
    assert key(a) == key(b)
    ma = [tuple(r) for r in a.metrics_history().orderBy("iter").collect()]
    mb = [tuple(r) for r in b.metrics_history().orderBy("iter").collect()]
    assert ma == mb


def test_run_until_the_pool_is_empty(spark):
    from drawpool.operators.strategies import PoolExhausted
    pv, train, pool, vocab = _vec_setup(spark)
    few = spark.createDataFrame(pool.limit(5).collect(), pool.schema)
    run = ActiveLearningRun(spark, corpus=few, scorer=SC.CentroidScorer(vocab), vocab=vocab, method="standard", seed_train=train, n_sample=3)
    with pytest.raises(PoolExhausted):
        run.run(3)
    assert run.train_ids().count() == 5 and sorted(r.iter for r in run.metrics_history().collect()) == [0, 1]


def test_lost_scores_raise(spark):
    from drawpool.plans.rounds import ScoreMismatch
    pv, train, pool, vocab = _vec_setup(spark)

    class Losing:
        kind = "standard"

        def fit(self, t):
            return self

        def score(self, df):
            return SC.CentroidScorer(vocab).fit(train).score(df).where("idx % 7 <> 0")
    run = ActiveLearningRun(spark, corpus=pool, scorer=Losing(), vocab=vocab, method="standard", seed_train=train)
    with pytest.raises(ScoreMismatch):
        run.run_round()


def test_strict_sample_raises(spark):
    pv = A.pool_vec(spark, SF001).limit(3)
    with pytest.raises(SM.SampleTooLarge):
        SM.uniform_sample(pv, 10, strict=True)
    assert SM.uniform_sample(pv, 10).count() == 3


def test_fitted_models_beat_chance(spark):
    """Accuracy of the two MLlib fits on rows that they did not see: near 1
    where the classes can be told apart, and chance on the vector table, whose
    labels have nothing to do with its vectors."""
    import random
    rng = random.Random(3)
    centre = {c: [rng.gauss(0, 3) for _ in range(8)] for c in "abc"}
    rows = [(i, [x + rng.gauss(0, 1) for x in centre[c]], c) for i, c in enumerate("abc" * 100)]
    vec = spark.createDataFrame(rows, "idx long, features array<double>, label_text string")

    def hits(train, pool, vocab):
        top = SC.LogisticScorer(vocab, params={"maxIter": 30}).fit(train).score(pool)
        hit = top.select((F.array_position("probs", F.array_max("probs")) - 1).alias("p"), "label_text").collect()
        return sum(vocab[r.p] == r.label_text for r in hit) / len(hit)
    assert hits(vec.where("idx < 150"), vec.where("idx >= 150"), ["a", "b", "c"]) > 0.95
    pv, train, pool, vocab = _vec_setup(spark)
    assert 0.3 / len(vocab) < hits(train, pool, vocab) < 3 / len(vocab)
    words = [("red apple pie", "food"), ("green apple tart", "food"), ("fast blue car", "ride"), ("old car and bus", "ride")] * 10
    text = spark.createDataFrame([(i, *w) for i, w in enumerate(words)], "idx long, text string, label_text string")
    model = SC.LogisticScorer(["food", "ride"], features="text", text=True, params={"maxIter": 20}).fit(text)
    new = spark.createDataFrame([(100, "an apple tart", "food"), (101, "a blue bus", "ride")], text.schema)
    assert [int(r.probs[1] > r.probs[0]) for r in model.score(new).orderBy("idx").collect()] == [0, 1]
