"""Column functions: scores, text templates, token budgets (FIXTURES 1, 2,
6, 7, 10, 12, 13, 14, 22)."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawpool.functions import scores as S
from drawpool.functions import text as TX


def one(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("r")).collect()


def test_first_answer_nested(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField(
        "answers", T.StructType([T.StructField("text", T.ArrayType(T.StringType()))]))])
    df = spark.createDataFrame([(1, (["x", "y"],)), (2, ([],)), (3, ([None],))], schema)
    out = {r.id: r.r for r in df.select("id", TX.first_answer("answers.text").alias("r")).collect()}
    assert out == {1: "x", 2: "unanswerable", 3: None}


def test_quote_prompt_nulls(spark):
    df = spark.createDataFrame([(None, "q", "n")], "p string, q string, n string")
    r = df.select(TX.quote_prompt("p", "q", "n").alias("r")).first().r
    assert r == '  || The quote: "q" End of the quote ||  n'


def test_qa_prompt_null_in_null_out(spark):
    df = spark.createDataFrame([("c", "q"), (None, "q")], "c string, q string")
    rows = [r.r for r in df.select(TX.qa_prompt("c", "q").alias("r")).collect()]
    assert rows[0] == ("Context: c\n\nQuestion: q\n\nExtract the answer from the context. "
                       "Extracted answer: ")
    assert rows[1] is None


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "z array<double>")
    r = df.select(S.softmax("z").alias("p"), S.argmax("z").alias("a")).first()
    assert [round(x, 6) for x in r.p] == [0.090031, 0.244728, 0.665241]
    assert r.a == 2


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([0.5, 0.9, 0.9],)], "p array<double>")
    assert df.select(S.argmax("p").alias("a")).first().a == 1


def test_margin_single_class(spark):
    df = spark.createDataFrame([([0.7],)], "p array<double>")
    assert df.select(S.top2_margin("p").alias("m")).first().m == 0.0


def test_rescale(spark):
    df = spark.createDataFrame([([0.2, 0.6],)], "p array<double>")
    assert [round(x, 6) for x in df.select(S.rescale("p").alias("s")).first().s] == [0.25, 0.75]


def test_sequence_score(spark):
    df = spark.createDataFrame([([-0.5, -0.25, 0.0],)], "s array<double>")
    r = df.select(S.sequence_score("s", 368, 1.0).alias("x")).first().x
    assert math.isclose(r, -0.75 / 370)


def test_naive_certainty(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [2.0, 0.0]],)], "s array<array<double>>")
    assert df.select(S.naive_certainty("s").alias("x")).first().x == 5.0


def test_entail_prob(spark):
    df = spark.createDataFrame([(2.0, 1.9), (1.0, -3.0)], "a double, b double")
    r = [round(x.p, 6) for x in df.select(S.entail_prob("a", "b").alias("p")).collect()]
    assert r == [0.524979, 0.982014]


@pytest.mark.parametrize("budget,expected", [(5, (3, 2)), (6, (3, 3)), (13, (10, 3))])
def test_pair_budget_golden(spark, budget, expected):
    df = spark.createDataFrame([(10, 3)], "a int, b int")
    ka, kb = TX.pair_budget("a", "b", budget)
    r = df.select(ka.alias("a"), kb.alias("b")).first()
    assert (r.a, r.b) == expected


def _longest_first(a, b, budget):
    while a + b > budget:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80)), min_size=1, max_size=20),
       st.integers(1, 70))
def test_pair_budget_matches_longest_first(spark, pairs, budget):
    df = spark.createDataFrame(pairs, "a int, b int")
    ka, kb = TX.pair_budget("a", "b", budget)
    got = [(r.a, r.b) for r in df.select(ka.alias("a"), kb.alias("b")).collect()]
    assert got == [_longest_first(a, b, budget) for a, b in pairs]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.floats(-30, 30), min_size=1, max_size=6), min_size=1, max_size=10),
       st.floats(-50, 50))
def test_softmax_sums_to_one_and_shift_invariant(spark, rows, shift):
    df = spark.createDataFrame([(r,) for r in rows], "z array<double>")
    df = df.withColumn("zs", F.transform("z", lambda x: x + F.lit(shift)))
    for r in df.select(S.softmax("z").alias("p"), S.softmax("zs").alias("q")).collect():
        assert math.isclose(sum(r.p), 1.0, rel_tol=1e-9)
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(r.p, r.q))


def test_tokens(spark):
    df = spark.createDataFrame([("  Hello, World!\tfoo\n",)], "t string")
    r = df.select(TX.ws_tokens("t").alias("w"), TX.word_tokens("t").alias("x"),
                  TX.first_word("t").alias("f")).first()
    assert r.w == ["Hello,", "World!", "foo"]
    assert r.x == ["hello", "world", "foo"]
    assert r.f == "hello"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd", "é"]), max_size=12), min_size=1, max_size=10))
def test_most_frequent_matches_python(spark, rows):
    from collections import Counter
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    got = {r.i: r.m for r in df.select("i", TX.most_frequent("t").alias("m")).collect()}
    for i, r in enumerate(rows):
        if not r:
            assert got[i] is None
        else:
            c = Counter(r)
            top = max(c.values())
            assert got[i] == min(x.encode() for x in c if c[x] == top).decode()


def test_generation_budgets(spark):
    assert TX.generation_budgets(384, 16) == (368, 16)
    with pytest.raises(ValueError):
        TX.generation_budgets(16, 16)
    df = spark.createDataFrame([(500, 3), (10, 40)], "a int, b int")
    inp, lab = TX.generation_budgets(384, 16)
    r = [(x.i, x.l) for x in df.select(TX.kept_tokens("a", inp).alias("i"), TX.kept_tokens("b", lab).alias("l")).collect()]
    assert r == [(368, 3), (10, 16)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r.,;!?aBcÉé", max_size=40), min_size=1, max_size=15),
       st.integers(1, 6))
def test_first_tokens_equals_full_split_prefix(spark, texts, n):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select(TX.first_tokens("t", n).alias("a"), TX.truncate_tokens(TX.ws_tokens("t"), n).alias("b"),
                  TX.first_tokens("t", n, TX.WORD_SPLIT, lower=True).alias("c"),
                  TX.truncate_tokens(TX.word_tokens("t"), n).alias("d")).collect()
    for x in r:
        assert x.a == x.b and x.c == x.d
