"""Cutoffs by counting digits, ranks by ranges, several draws in one scan."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from drawpool.operators import evaluate as E
from drawpool.operators import labels as LB
from drawpool.operators import nli as N
from drawpool.operators import sampling as SM
from drawpool.operators.radix import before_or_at, cutoffs, hex_digits, number_digits
from drawpool.operators.ranking import range_ranks
from drawpool.operators.strategies import breaking_ties, radix_draw
from drawpool.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [0, 3, 10_000])
def test_cutoffs_of_numbers_with_signs(spark, small):
    rng = random.Random(1)
    values = [-(1 << 63), (1 << 63) - 1, 0, -1, 1] + [rng.randrange(-(1 << 62), 1 << 62) >> rng.randrange(60) for _ in range(400)]
    rows = [(g, v) for g in (0, 1) for v in sorted(set(values))]
    df = spark.createDataFrame(rows, "g int, v long").repartition(5)
    levels = number_digits(F.col("v"))
    for caps in ({0: 1, 1: 7}, {0: 150, 1: len(rows)}, {0: 0, 1: 200, 5: 3}):
        got = cutoffs(df, "g", levels, caps, small=small)
        for g, n in caps.items():
            mine = sorted(v for k, v in rows if k == g)
            kept = sorted(r.v for r in df.where((F.col("g") == g) & before_or_at(levels, got[g])).collect())
            assert kept == mine[:n], (g, n)


def test_cutoffs_of_digests(spark):
    df = spark.range(3000).select(F.lit("a").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    levels = hex_digits(F.col("h"), 1)
    got = cutoffs(df, "g", levels, {"a": 777}, small=5)["a"]
    assert sorted(r.h for r in df.where(before_or_at(levels, got)).collect()) == sorted(r.h for r in df.collect())[:777]


def _tied(spark, n=24_000):
    """Half of the rows have one margin."""
    return spark.range(n).select((F.col("id") * 31 - n).alias("idx"), F.when(F.col("id") % 2 == 0, 0.25).otherwise(F.round((F.col("id") % 997) / 1000, 4)).alias("margin"))


@pytest.mark.parametrize("small", [50, 20_000])
def test_large_draw_with_half_of_the_pool_tied(spark, small):
    df = _tied(spark)
    want = sorted((r.margin, r.idx) for r in df.collect())
    for n in (10_500, 13_000, 30_000):
        got = [(r.margin_rank, r.margin, r.idx) for r in radix_draw(df, n, small=small).collect()]
        assert sorted(got) == [(i + 1, *w) for i, w in enumerate(want[:n])]


def test_large_draw_is_spread_over_tasks(spark):
    """Rows that tie are filtered where they are read and sorted by ranges:
    no task of the sort has twice the rows of the median task."""
    drawn = radix_draw(_tied(spark).repartition(8), 13_000).drop("margin_rank")
    part = drawn.repartitionByRange(8, "margin", "idx").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = sorted(r["count"] for r in part.collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]


def test_breaking_ties_strategies_agree(spark):
    rng = random.Random(2)
    rows = [(i, [p := rng.choice([.5, .6, .7]), 1 - p]) for i in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "idx long, probs array<double>")
    key = lambda d: sorted((r.idx, r.margin_rank, r.shuffle_rank, r.label_text_pred) for r in d.collect())
    assert key(breaking_ties(df, ["a", "b"], 400)) == key(breaking_ties(df, ["a", "b"], 400, strategy="radix"))


def test_range_ranks_of_any_type(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("s"), "id").repartition(7)
    got = {r.s: r.rank for r in range_ranks(df, ["s"]).collect()}
    assert got == {s: i + 1 for i, s in enumerate(sorted(got))} and len(got) == 5000
    assert range_ranks(df.where("id < 0"), ["s"]).count() == 0


def test_codes_of_an_open_vocabulary(spark):
    df = spark.range(20_000).select(F.col("id").alias("idx"), F.concat(F.lit("w"), (F.col("id") % 9000).cast("string")).alias("label_text"))
    codes = LB.label_codes_alpha(df)
    assert {r.label_text: r.code for r in codes.collect()} == {w: i for i, w in enumerate(sorted({f"w{i}" for i in range(9000)}))}
    assert {r.label_text: r.code for r in LB.label_codes_first_seen(df).collect()} == {f"w{i}": i for i in range(9000)}
    assert len(LB.vocab_list(df)) == 9000


def test_class_report_of_a_table_of_labels(spark):
    rows = [("a", "a")] * 3 + [("b", "c"), (None, "a"), ("d", None)]
    conf = E.confusion(spark.createDataFrame(rows, "gold string, pred string"))
    voc = spark.createDataFrame([(x,) for x in ("a", "b", "e", None, "a")], "label string")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(E.class_report(conf, voc)) == key(E.class_report(conf, ["a", "b", "e"]))


def _brute_nli(rows, dic, order):
    import hashlib
    out = []
    for p, lab in enumerate(sorted(dic)):
        mine = [i for i, x in rows if x == lab]
        name = (lambda i: f"42:{i}") if order == "shared" else (lambda i: f"42:{lab}:{i}")
        others = sorted((hashlib.md5(name(i).encode()).hexdigest(), i) for i, x in rows if x != lab)
        out += [(i, p, 0) for i in mine] + [(i, p, 1) for _, i in others[:len(mine)]]
    return sorted(out)


@pytest.mark.parametrize("order", ["own", "shared"])
@pytest.mark.parametrize("small", [2, 20_000])
def test_negatives_by_histogram_with_a_hot_label(spark, order, small):
    rows = [(i, None if i % 17 == 0 else "hot" if i % 2 else f"l{i % 3}" if i % 5 else "unknown") for i in range(4000)]
    df = spark.createDataFrame(rows, "idx long, label_text string").repartition(6)
    dic = {"hot": "h", "l0": "a", "l1": "b", "l2": "c", "none": "d"}
    got = N.nli_trainset(df, dic, order=order, small=small)
    assert sorted((r.idx, r.hypo_pos, r.label) for r in got.collect()) == _brute_nli(rows, dic, order)


def test_negatives_plan_has_no_exchange_by_hypothesis(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "idx long, label_text string")
    plan = plan_of(N.nli_trainset(df, {"a": "x", "b": "y"}))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1   # a filter where the rows are read


def test_draws_come_from_one_scan(spark):
    for name in ("corpus_test_split", "seed_train_overlap", "test_minus_corpus"):
        plan = plan_of(catalog.Q[name](spark, SF01))
        assert plan.count("FileScan parquet") == 2 and "WindowGroupLimit" in plan, name   # documents and labels, once each


def test_seeded_draws_equal_single_draws(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "ab"[i % 2], f"t{i}") for i in range(3000)], "idx long, label_text string, text string")
    for cap in (20, 1500):
        both = SM.seeded_draws(df, {"x": (1, cap), "y": (2, 7)})
        for name, seed, n in (("x", 1, cap), ("y", 2, 7)):
            want = sorted((r.idx, r.text, r.rank) for r in SM.stratified_sample(df, n, seed, rank_col="rank").collect())
            assert sorted((r.idx, r.text, r.rank) for r in both.where(F.col("draw") == name).collect()) == want
    c, t = SM.corpus_test_split(df)
    assert c.columns == df.columns and not {r.idx for r in c.collect()} & {r.idx for r in t.collect()}
