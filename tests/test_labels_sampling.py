"""Labels, sampling, ranking strategies (FIXTURES 3, 19; G1-G4, E1)."""

import pytest

from drawpool.operators import labels as LB
from drawpool.operators import sampling as SM
from drawpool.operators.ranking import rank_first
from drawpool.functions.hashing import hash_bucket, seeded_hash
from drawpool.sources import adaptors as A
from conftest import SF01


def test_label_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "idx long, label_text string")
    fs = LB.attach_codes(df, LB.label_codes_first_seen(df))
    assert [r.label for r in fs.orderBy("idx").collect()] == [0, -1, 1, 0]
    al = df.join(LB.label_codes_alpha(df), on="label_text", how="left")
    assert [r.code for r in al.orderBy("idx").collect()] == [1, None, 0, 1]
    assert LB.vocab_list(df) == ["a", "b"]


def test_label_distribution_drops_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "idx long, label_text string")
    assert [(r.label_text, r.n) for r in LB.label_distribution(df).collect()] == [("b", 2), ("a", 1)]


def test_filter_labels_long_list_is_semi_join(spark):
    df = spark.createDataFrame([(i, f"l{i % 7}") for i in range(50)], "idx long, label_text string")
    wl = [f"l{i}" for i in range(3)] + [f"x{i}" for i in range(2000)]
    a = {r.idx for r in LB.filter_labels(df, wl).collect()}
    assert a == {i for i in range(50) if i % 7 < 3}


def test_stratified_cap_and_partition_independence(spark):
    rows = [(i, "big") for i in range(50)] + [(100 + i, "small") for i in range(3)]
    df = spark.createDataFrame(rows, "idx long, label_text string")
    base = SM.stratified_sample(df, cap=30)
    got = sorted(r.idx for r in base.collect())
    assert len(got) == 33
    for n in (1, 3, 7):
        again = sorted(r.idx for r in SM.stratified_sample(df.repartition(n), cap=30).collect())
        assert again == got


@pytest.mark.parametrize("strategy", ["window", "bucketed"])
def test_rank_strategies_agree(spark, strategy):
    pq = A.pool_quality(spark, SF01)
    ref = {(r.idx, r.rank) for r in SM.stratified_sample(pq, 30, rank_col="rank", strategy="window").collect()}
    got = {(r.idx, r.rank) for r in SM.stratified_sample(pq, 30, rank_col="rank", strategy=strategy).collect()}
    assert got == ref


def test_uniform_topk_equals_bucketed(spark):
    pq = A.pool_quality(spark, SF01)
    a = {(r.idx, r.r) for r in SM.uniform_sample(pq, 123, rank_col="r", strategy="topk").collect()}
    b = {(r.idx, r.r) for r in SM.uniform_sample(pq, 123, rank_col="r", strategy="bucketed").collect()}
    assert a == b and len(a) == 123


def test_uniform_n_larger_than_pool(spark):
    df = spark.createDataFrame([(i, "a") for i in range(4)], "idx long, label_text string")
    assert SM.uniform_sample(df, 5).count() == 4
    assert SM.uniform_sample(df, 5, strategy="bucketed").count() == 4


def test_data_dependent_cap(spark):
    df = spark.createDataFrame([(i, i % 2, 3 if i % 2 else 5) for i in range(40)], "idx long, g int, cap long")
    df = df.withColumn("_h", seeded_hash(7, "idx"))
    got = rank_first(df, ["g"], ["_h", "idx"], "cap", bucket=hash_bucket("_h"), rank_col="r")
    counts = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert counts == {0: 5, 1: 3}


def test_corpus_test_split_disjoint(spark):
    c, t = SM.corpus_test_split(A.pool_quality(spark, SF01))
    ci = {r.idx for r in c.collect()}
    ti = {r.idx for r in t.collect()}
    assert not (ci & ti) and len(ci) > 0 and len(ti) > 0


def test_seed_train_exclude(spark):
    pq = A.pool_quality(spark, SF01)
    c, t = SM.corpus_test_split(pq)
    st = SM.seed_train_draw(pq, exclude=[c, t])
    ids = {r.idx for r in st.collect()}
    assert not ids & {r.idx for r in c.collect()}
    assert not ids & {r.idx for r in t.collect()}


def test_plan_window_group_limit(spark):
    pq = A.pool_quality(spark, SF01)
    plan = SM.stratified_sample(pq, 30)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_shuffle_rank_bucketed_equals_window(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "idx")
    a = {(r.idx, r.shuffle_rank) for r in SM.shuffle_rank(df, n_max=5000).collect()}
    b = {(r.idx, r.shuffle_rank) for r in SM.shuffle_rank(df, n_max=20_000).collect()}
    assert a == b and sorted(x for _, x in a) == list(range(1, 301))


def test_hot_label_bucketed_paths(spark):
    """One label holds most rows: the bucketed ranks give the same rows as
    the window ranks, for the stratified draw and the NLI negatives."""
    from drawpool.operators import nli as N
    rows = [(i, "hot" if i % 10 < 8 else ("a" if i % 10 == 8 else "b")) for i in range(3000)]
    df = spark.createDataFrame(rows, "idx long, label_text string")
    w = {(r.idx, r.rank) for r in SM.stratified_sample(df, 700, rank_col="rank", strategy="window").collect()}
    b = {(r.idx, r.rank) for r in SM.stratified_sample(df, 700, rank_col="rank", strategy="bucketed").collect()}
    assert w == b and len(w) == 700 + 300 + 300
    hyp = {"a": "ha", "b": "hb", "hot": "hh"}
    tb = sorted(tuple(r) for r in N.nli_trainset(df, hyp).collect())
    # hot: 2400 positives, 600 others -> 600 negatives; a, b: 300 + 300 each
    assert len(tb) == 2400 + 600 + 2 * (300 + 300)


def test_dense_ids(spark):
    from drawpool.operators.ranking import dense_ids
    df = spark.createDataFrame([(i * 7 + 3,) for i in range(500)], "idx long").repartition(5)
    got = sorted((r.idx, r.new_idx) for r in dense_ids(df).collect())
    assert got == [(i * 7 + 3, i) for i in range(500)]


def test_label_code_map_and_shuffled(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "idx long, label_text string")
    assert LB.label_code_map(df).first().label2id == {"a": 0, "b": 1}
    order = [r.idx for r in SM.shuffled(df).collect()]
    again = [r.idx for r in SM.shuffled(df.repartition(3)).collect()]
    ranks = [r.idx for r in SM.shuffle_rank(df, n_max=5000).orderBy("shuffle_rank").collect()]
    assert order == again == ranks and sorted(order) == [1, 2, 3, 4]


def test_quantile_bucket_monotone(spark):
    from drawpool.operators.ranking import quantile_bucket
    df = spark.createDataFrame([(float(i % 97) ** 2,) for i in range(2000)], "x double")
    rows = df.select("x", quantile_bucket(df, "x", 32).alias("b")).collect()
    pairs = sorted((r.x, r.b) for r in rows)
    assert all(b1 <= b2 for (_, b1), (_, b2) in zip(pairs, pairs[1:]))
    assert len({b for _, b in pairs}) > 10
