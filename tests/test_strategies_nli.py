"""Draws and the NLI formulation (FIXTURES 8-11, 15-18, 23)."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from drawpool.operators import nli as N
from drawpool.operators.strategies import PoolExhausted, breaking_ties, ensure_not_empty, min_certainty

VOCAB = ["a", "b"]


def margins_df(spark, margins):
    # two-class probabilities whose top-2 margin is the given value
    return spark.createDataFrame([(i, [0.5 + m / 2, 0.5 - m / 2]) for i, m in margins],
                                 "idx long, probs array<double>")


def test_breaking_ties_tie_break_by_idx(spark):
    df = margins_df(spark, [(1, 0.1), (2, 0.1), (3, 0.0), (4, 0.1)])
    d = breaking_ties(df, VOCAB, n=2)
    assert [r.idx for r in d.orderBy("margin_rank").collect()] == [3, 1]


def test_breaking_ties_bucketed_equals_topk(spark):
    df = spark.createDataFrame([(i, [((i * 37) % 100) / 100.0, 1 - ((i * 37) % 100) / 100.0]) for i in range(300)],
                               "idx long, probs array<double>")
    a = [(r.idx, r.margin_rank) for r in breaking_ties(df, VOCAB, 57).collect()]
    b = [(r.idx, r.margin_rank) for r in breaking_ties(df, VOCAB, 57, strategy="bucketed").collect()]
    assert sorted(a) == sorted(b)


def test_draw_n_larger_than_pool_and_empty(spark):
    df = margins_df(spark, [(1, 0.1), (2, 0.2), (3, 0.0), (4, 0.3)])
    assert breaking_ties(df, VOCAB, n=5).count() == 4
    empty = df.filter(F.lit(False))
    assert breaking_ties(empty, VOCAB, n=2).count() == 0
    with pytest.raises(PoolExhausted):
        ensure_not_empty(empty)


def test_nan_rejected(spark):
    df = spark.createDataFrame([(1, [float("nan"), 0.5])], "idx long, probs array<double>")
    with pytest.raises(Exception):
        breaking_ties(df, VOCAB, n=1).collect()


def test_wrong_k_rejected(spark):
    df = spark.createDataFrame([(1, [0.2, 0.3, 0.5])], "idx long, probs array<double>")
    with pytest.raises(Exception):
        breaking_ties(df, VOCAB, n=1).collect()


def test_min_certainty(spark):
    df = spark.createDataFrame([(i, float((i * 7) % 11)) for i in range(30)], "idx long, score double")
    a = sorted((r.idx, r.score_rank) for r in min_certainty(df, 5).collect())
    b = sorted((r.idx, r.score_rank) for r in min_certainty(df, 5, strategy="bucketed").collect())
    assert a == b
    assert [i for i, _ in sorted(a, key=lambda t: t[1])] == [0, 11, 22, 8, 19]
    with pytest.raises(TypeError):
        min_certainty(spark.createDataFrame([(1, [0.1])], "idx long, score array<double>"), 1)


def test_draw_plan_is_take_ordered(spark):
    df = margins_df(spark, [(i, i / 100) for i in range(20)])
    plan = breaking_ties(df, VOCAB, n=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    sc = spark.createDataFrame([(i, i / 10) for i in range(20)], "idx long, score double")
    assert "TakeOrderedAndProject" in min_certainty(sc, 5)._jdf.queryExecution().executedPlan().toString()


def test_nli_predict_raw_logits_vs_softmax(spark):
    rows = [(1, 0, 2.0, 1.9, 0), (1, 1, 1.0, -3.0, 1)]
    df = spark.createDataFrame(rows, "idx long, hypo_pos int, z_entail double, z_not double, label int")
    g = N.regroup(df, ["z_entail", "z_not", "label"], 2)
    r = N.nli_predict(g).first()
    assert r.pred_pos == 0 and r.gold_pos == 0
    assert [round(x, 6) for x in r.p_entail] == [0.524979, 0.982014]
    assert N.nli_predict(g, select="softmax").first().pred_pos == 1


def test_nli_trainset_golden(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "idx long, label_text string")
    tr = N.nli_trainset(df, {"a": "is a", "b": "is b"})
    got = {(r.hypo_pos, r.label): 0 for r in tr.collect()}
    counts = {}
    for r in tr.collect():
        counts[(r.hypo_pos, r.label)] = counts.get((r.hypo_pos, r.label), 0) + 1
    assert counts == {(0, 0): 3, (0, 1): 2, (1, 0): 1, (1, 1): 1}
    assert tr.count() == 7
    # the not-entail rows of 'a' are exactly b and null
    assert {r.idx for r in tr.collect() if r.hypo_pos == 0 and r.label == 1} == {4, 5}
    assert got


def test_nli_testset_golden(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "d")], "idx long, label_text string")
    hyp = {"a": "ha", "b": "hb", "c": "hc", "d": "hd"}
    ts = N.nli_testset(df, hyp).collect()
    assert len(ts) == 12
    for i in (1, 2, 3):
        labels = sorted(r.label for r in ts if r.idx == i)
        assert labels == [0, 1, 1, 1]


def test_nli_shared_hypothesis(spark):
    df = spark.createDataFrame([(1, "a")], "idx long, label_text string")
    ts = N.nli_testset(df, {"a": "same", "b": "same"}).collect()
    assert sorted(r.label for r in ts) == [0, 0]


def test_nli_unknown_label(spark):
    df = spark.createDataFrame([(1, "a"), (2, "zzz")], "idx long, label_text string")
    with pytest.raises((PySparkException, Exception)):
        N.nli_testset(df, {"a": "ha", "b": "hb"}).collect()
    assert N.nli_testset(df, {"a": "ha", "b": "hb"}, on_unknown="drop").count() == 2


def test_nli_train_size_bound(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else "a") for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, label_text string")
    assert N.nli_trainset(df, {"a": "ha", "b": "hb"}).count() <= 2 * df.count()


def test_nli_row_form_equals_pair_form(spark):
    from drawpool.plans import catalog as C
    from conftest import SF001
    a = {(r.idx, r.pred_pos, r.gold_pos) for r in C.lang_scored(spark, SF001).collect()}
    b = {(r.idx, r.pred_pos, r.gold_pos) for r in C.lang_scored_pairs(spark, SF001).collect()}
    assert a == b and len(a) == 200


def test_draw_and_metrics_repartition_invariant(spark):
    from drawpool.plans import catalog as C
    from drawpool.operators import evaluate as E
    from conftest import SF001
    sc, vocab, _ = C.vec_scored(spark, SF001)
    base = sorted(tuple(r) for r in breaking_ties(sc, vocab, 15).select("idx", "shuffle_rank").collect())
    m0 = E.eval_metrics(sc.select(F.col("label_text").alias("gold"), F.lit("0").alias("pred"))).first()
    for n in (1, 5, 13):
        rp = sc.repartition(n)
        assert sorted(tuple(r) for r in breaking_ties(rp, vocab, 15).select("idx", "shuffle_rank").collect()) == base
        assert E.eval_metrics(rp.select(F.col("label_text").alias("gold"), F.lit("0").alias("pred"))).first() == m0


def test_breaking_ties_labels_needing_escapes(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8]), (2, [0.6, 0.4])], "idx long, probs array<double>")
    voc = ["it's", "back\\slash"]
    rows = {r.idx: r for r in breaking_ties(df, voc, 2).collect()}
    assert rows[1].label_text_pred == "back\\slash" and rows[2].label_text_pred == "it's"
    assert rows[1].probs_named == {"it's": 0.2, "back\\slash": 0.8}


@pytest.mark.parametrize("bad", [None, [0.5, None], [0.5, float("nan")], [0.5, float("inf")], [1.0]])
def test_bad_probabilities_raise(spark, bad):
    df = spark.createDataFrame([(1, [0.6, 0.4]), (2, bad)], "idx long, probs array<double>")
    with pytest.raises(Exception, match="finite values"):
        breaking_ties(df, ["a", "b"], n=1).collect()


@pytest.mark.parametrize("bad", [None, float("nan"), float("-inf")])
def test_bad_scores_raise(spark, bad):
    df = spark.createDataFrame([(1, 0.5), (2, bad)], "idx long, score double")
    with pytest.raises(Exception, match="finite"):
        min_certainty(df, 1).collect()


def test_regroup_needs_every_hypothesis(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0)], "idx long, hypo_pos int, z double")
    with pytest.raises(Exception, match="not one score"):
        N.regroup(df, ["z"], 3).collect()
    with pytest.raises(Exception, match="not one score"):
        N.regroup(df, ["z"], 2).collect()
