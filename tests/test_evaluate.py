"""Evaluation (FIXTURES 4, 5; D3-D9, D12) and its properties."""

import math

from hypothesis import given, settings, strategies as st

from drawpool.operators import evaluate as E


def gp(spark, gold, pred):
    return spark.createDataFrame(list(zip(range(len(gold)), gold, pred)), "idx long, gold string, pred string")


def test_metrics_golden(spark):
    m = E.eval_metrics(gp(spark, list("aaabbc"), list("aabbda"))).first().asDict()
    assert math.isclose(m["precision_macro"], 7 / 24)
    assert math.isclose(m["recall_macro"], 7 / 24)
    assert math.isclose(m["f1_macro"], 7 / 24)
    assert math.isclose(m["accuracy_balanced"], 7 / 18)
    for k in ("precision_micro", "recall_micro", "f1_micro", "accuracy"):
        assert math.isclose(m[k], 0.5)
    assert m["n_rows"] == 6


def test_class_report_golden(spark):
    conf = E.confusion(gp(spark, list("aaabbc"), list("aabbda")))
    rep = {r.label_text: r for r in E.class_report(conf, list("abcde")).collect()}
    assert [rep[c].support for c in "abcde"] == [3, 2, 1, 0, 0]
    assert math.isclose(rep["macro avg"].precision, 7 / 30)
    assert math.isclose(rep["weighted avg"].precision, 0.5)
    assert math.isclose(rep["accuracy"].f1, 0.5)
    assert rep["accuracy"].support == 6


def test_zero_division_gives_zero(spark):
    m = E.eval_metrics(gp(spark, ["a", "a"], ["b", "b"])).first().asDict()
    assert m["precision_macro"] == 0.0 and m["f1_micro"] == 0.0 and m["accuracy"] == 0.0


def test_generation_rounding(spark):
    m = E.eval_metrics(gp(spark, list("aaabbc"), list("aabbda")), digits=3).first().asDict()
    assert m["precision_macro"] == 0.292 and m["accuracy_balanced"] == 0.389


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcde")), min_size=1, max_size=40))
def test_metric_properties(spark, pairs):
    gold = [g for g, _ in pairs]
    pred = [p for _, p in pairs]
    m = E.eval_metrics(gp(spark, gold, pred)).first().asDict()
    acc = sum(g == p for g, p in pairs) / len(pairs)
    assert math.isclose(m["accuracy"], acc)
    assert math.isclose(m["f1_micro"], acc)
    assert m["accuracy_balanced"] >= m["recall_macro"] - 1e-12


def test_learning_curve(spark):
    mh = spark.createDataFrame([(i, 0.1 * i, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1) for i in range(3)],
                               "iter int, " + ", ".join(f"{c} double" for c in E.METRIC_COLUMNS))
    sh = spark.createDataFrame([(i, j) for i in (1, 2, 3) for j in range(5)], "iter int, idx long")
    lc = {r.iter: r.n_labels for r in E.learning_curve(mh, sh).collect()}
    assert lc == {0: 0, 1: 5, 2: 10}
