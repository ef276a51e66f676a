
import pytest

import __spark_entry__ as E
from conftest import SF01
from drawpool.operators.strategies import breaking_ties


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_nli_trainset_599(spark, q):
    assert q["nli_trainset"](spark, SF01).count() == 599


def test_quality_class_sizes(spark, q):
    got = {r.label_text: r.n for r in q["label_distribution"](spark, SF01).collect()}
    assert got == {"q0_t0": 49, "q0_t1": 9, "q1_t0": 299, "q1_t1": 42}


def test_overlap_nli_accuracy(spark, q):
    """On whole texts; the first 64 words alone give 0.951."""
    assert round(q["nli_eval"](spark, SF01).first().accuracy, 3) == 0.980


def test_open_vocab_accuracy(spark, q):
    m = q["eval_open_vocab"](spark, SF01).first()
    assert m.n_rows == 1000 and round(m.accuracy * 1000) == 113


def test_unanswerable_conversations(spark, q):
    rows = q["first_answer_default"](spark, SF01).collect()
    assert len(rows) == 100 and sum(r.label_text == "unanswerable" for r in rows) == 2


def test_duplicate_vocabulary_rejected(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5])], "idx long, probs array<double>")
    with pytest.raises(ValueError):
        breaking_ties(df, ["a", "a"], 1)
