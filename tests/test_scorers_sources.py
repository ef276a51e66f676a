"""Scorers, sources, adaptors, the driver contract."""

import math

import pytest
from pyspark.sql import functions as F

from drawpool.operators import labels as LB
from drawpool.operators import ledger as L
from drawpool.operators import sampling as SM
from drawpool.plans import scorers as SC
from drawpool.sources import adaptors as A
from drawpool.sources.contracts import ContractError, check_contract
from drawpool.sources.readers import QUOTE_SCHEMA, read_delimited, read_qa
from conftest import SF001


def test_contract(spark):
    assert check_contract(A.pool_lang(spark, SF001))["n_rows"] == 200
    dup = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "idx long, text string, label_text string")
    with pytest.raises(ContractError):
        check_contract(dup)


def test_read_delimited_multiline(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('label_text,text_preceding_trans,text_original_trans,text_following_trans\n'
                 'a,"line one\nline two","say ""hi""",\n')
    df = read_delimited(spark, str(p), QUOTE_SCHEMA)
    r = df.first()
    assert r.text_preceding_trans == "line one\nline two" and r.text_original_trans == 'say "hi"'
    assert r.text_following_trans is None
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "x.zip"))


def test_read_qa_nested(spark, tmp_path):
    p = tmp_path / "qa.json"
    p.write_text('{"id":"1","context":"c","question":"q","answers":{"text":["x","y"]}}\n'
                 '{"id":"2","context":"c","question":"q","answers":{"text":[]}}\n')
    df = A.nested_answers(read_qa(spark, str(p)))
    assert [r.label_text for r in df.orderBy("id").collect()] == ["x", "unanswerable"]


def test_centroid_and_batch_udf_agree(spark):
    pv = A.pool_vec(spark, SF001)
    train = SM.uniform_sample(pv, 50)
    pool = L.pool_minus(pv, train).limit(40)
    vocab = LB.vocab_list(pv)
    a = {r.idx: r.z for r in SC.CentroidScorer(vocab).fit(train).score(pool).collect()}
    udf_model = SC.BatchUDFScorer(SC.centroid_predict_fn_factory(vocab), k=len(vocab), dim=64).fit(train)
    b = {r.idx: r.z for r in udf_model.score(pool).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[k], b[k]))


def test_logistic_scorer(spark):
    pv = A.pool_vec(spark, SF001)
    vocab = LB.vocab_list(pv)
    train = SM.uniform_sample(pv, 200)
    sc = SC.LogisticScorer(vocab, params={"maxIter": 20}).fit(train).score(L.pool_minus(pv, train))
    rows = sc.select("probs").limit(20).collect()
    assert all(len(r.probs) == len(vocab) and math.isclose(sum(r.probs), 1.0, rel_tol=1e-6) for r in rows)


def test_unigram_zero_shot_uses_corpus(spark):
    pg = A.pool_gen(spark, SF001)
    m = SC.UnigramScorer(pg).fit(None)
    n_tok = pg.select(F.sum(F.size(F.filter(F.split("text", "[ \n\t\r]+"), lambda t: t != "")))).first()[0]
    assert m.n_tokens == n_tok
    # every token of a text has a step, and the score is made of all of them
    some = pg.limit(1)
    steps = [r.step for r in m.step_scores(some).collect()]
    n = some.select(F.size(F.filter(F.split("text", "[ \n\t\r]+"), lambda t: t != ""))).first()[0]
    assert len(steps) == n and n > 16
    assert math.isclose(m.score(some).first().score, sum(steps) / (SC.INPUT_LEN + n), abs_tol=1e-8)


def test_unigram_vocabulary_sent_or_dealt(spark):
    """The same scores whether the vocabulary is broadcast or met by token
    with frequent words in salts."""
    rows = [(i, "la " * (i % 40) + f"w{i % 7} x{i}") for i in range(400)] + [(900, ""), (901, None), (902, " \n ")]
    df = spark.createDataFrame(rows, "idx long, text string").repartition(3)
    m = SC.UnigramScorer(df).fit(None)
    sent = sorted((r.idx, r.score, r.pred) for r in m.score(df).collect())
    m.broadcast_words = 0
    dealt = m.score(df, keep=("text",))
    assert sent == sorted((r.idx, r.score, r.pred) for r in dealt.collect()) and len(sent) == len(rows)
    assert "Salts" not in dealt.columns and {r.idx: r.text for r in dealt.collect()} == dict(rows)


def test_most_frequent_word(spark):
    from drawpool.functions.text import most_frequent, word_tokens
    rows = [("b a b a c",), ("",), (None,), ("x",), ("c c b b B",), ("z z y",)]
    got = spark.createDataFrame(rows, "t string").select(most_frequent(word_tokens("t")).alias("m")).collect()
    assert [r.m for r in got] == ["a", None, None, "x", "b", "z"]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["idx", "margin", "label_text_pred", "margin_rank", "shuffle_rank"]
    assert df.count() == 20
    from drawpool.plans import catalog
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(catalog.Q) <= set(sql)   # every query of the library itself has its SQL


def test_no_cartesian_or_row_udf_in_any_query(spark):
    """Every query of the library: no cartesian / nested-loop join and no
    row-at-a-time Python evaluation (Arrow batches only)."""
    from drawpool.plans import catalog
    for name, fn in catalog.Q.items():
        plan = fn(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in plan, (name, bad)


def test_cluster_conf():
    from drawpool.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert c["spark.sql.adaptive.enabled"] == "true"
    assert int(cluster_conf(10 * 1024 ** 2, 64)["spark.sql.shuffle.partitions"]) == 192


def test_neighbours_of_turns_with_gaps(spark):
    rows = [(1, 0, "a"), (1, 2, "b"), (1, 3, "c"), (1, 999, "d"), (1, 1000, "e"), (1, 5200, None), (1, 5201, "g"), (2, 7, "z")]
    out = {(r.conv_id, r.turn): (r.text_preceding, r.text_original, r.text_following)
           for r in A.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    texts = [None, *(t for c, _, t in rows if c == 1), None]
    for i, (c, n, _) in enumerate(rows[:-1]):
        assert out[(c, n)] == tuple(texts[i:i + 3])
    assert out[(2, 7)] == (None, "z", None)
