"""Any number of classes, hypotheses and train ids: tables, not literals."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from drawpool.functions.text import word_tokens
from drawpool.operators import ledger as L
from drawpool.operators import membership as M
from drawpool.operators.strategies import margin_scores
from drawpool.plans import blocked
from drawpool.plans import scorers as SC
from drawpool.plans.postings import PostingsNLI


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_fifty_thousand_classes(spark):
    k, dim = 50_000, 6
    label, value = F.lpad((F.col("id") * 7919 % k).cast("string"), 6, "0"), lambda j: F.sin(F.col("id") * (j + 1) + j)
    train = spark.range(k).select(label.alias("label_text"), F.array(*(value(j) for j in range(dim))).alias("features"))
    rng = np.random.default_rng(4)
    x = rng.standard_normal((70, dim))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, features array<double>")
    model = blocked.BlockedCentroids.fit(train, salt_rows=30)
    assert model.n == k and len(plan_of(model.score(rows))) < 300_000   # no literal matrix
    got = {r.idx: r for r in model.score(rows).collect()}
    c = np.empty((k, dim))
    for r in train.collect():
        c[int(r.label_text)] = r.features
    z = 20.0 * x @ c.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i in range(70):
        top = np.sort(p[i])[::-1]
        assert got[i].pred_pos == z[i].argmax() and got[i].pred == f"{z[i].argmax():06d}"
        assert abs(got[i].prob - top[0]) < 1e-9 and abs(got[i].margin - round(round(top[0], 4) - round(top[1], 4), 4)) < 1.01e-4


def test_blocked_margins_equal_margin_scores(spark):
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, .3) for _ in range(5)]
    vocab = [f"c{i:02d}" for i in range(23)]
    train = spark.createDataFrame([(rng.choice(vocab[:20]), vec()) for _ in range(200)], "label_text string, features array<double>")
    rows = spark.createDataFrame([(i, vec()) for i in range(300)], "idx long, features array<double>")
    dense = margin_scores(SC.CentroidScorer(vocab).fit(train).score(rows), vocab)
    want = {r.idx: (r.margin, vocab[max(range(23), key=lambda k: (r.z[k], -k))]) for r in dense.collect()}
    voc = spark.createDataFrame([(v,) for v in vocab], "v string")
    for block, salt in ((1, 50), (7, 1000), (100, 100)):   # classes without a training row have logit 0 in both
        got = {r.idx: (r.margin, r.pred) for r in blocked.BlockedCentroids.fit(train, voc, block=block, salt_rows=salt).score(rows).collect()}
        assert got == want
    one = blocked.BlockedCentroids.fit(train.withColumn("label_text", F.lit("only"))).score(rows)
    assert {(r.margin, r.pred, r.prob) for r in one.collect()} == {(0.0, "only", 1.0)}


def _dense(texts, hypos):
    """Overlap scores of every pair, by hand."""
    split = lambda t: {w for w in "".join(" " if ch in "\n\t\r.,;!?" else ch for ch in (t or "").lower()).split(" ") if w}
    hs = [split(h) for _, h in hypos]
    index = {}
    for p, ws in enumerate(hs):
        for w in ws:
            index.setdefault(w, []).append(p)
    out = {}
    for i, t in texts:
        z = Counter(p for w in split(t) for p in index.get(w, ()))
        best = sorted(((-n, p) for p, n in z.items()))[:2] + [(0, 0), (0, 0)]
        pe = lambda n: round(1 / (1 + float(np.exp(1.0 - n))), 4)
        out[i] = (best[0][1], float(-best[0][0]), len(z), round(pe(-best[0][0]) - pe(-best[1][0]), 4))
    return out


def test_twenty_thousand_hypotheses(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)] + ["the"] * 600
    hypos = [(p, "The " * (p % 2) + " ".join(rng.choice(words) for _ in range(5))) for p in range(20_000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(300)] + [(900, None), (901, ""), (902, "nothing known!"), (903, "The the, THE")]
    table = spark.createDataFrame(hypos, "hypo_pos int, hypothesis string").repartition(6)
    rows = spark.createDataFrame(texts, "idx long, text string").repartition(5)
    for part, per in ((256, 50_000), (37, 9)):   # long lists in parts, frequent words in salts
        model = PostingsNLI(table, part, per)
        got = {r.idx: (r.pred_pos, r.z_entail, r.n_shared, r.margin) for r in model.predict(rows).collect()}
        assert got == _dense(texts, hypos)
    # only hypotheses that share a word are scored, and each pair once
    few = rows.where("idx < 10")
    pairs = model.shared(few).collect()
    want = sum(v[2] for k, v in _dense(texts, hypos).items() if k < 10)
    assert len(pairs) == want < 10 * 20_000 and word_tokens is not None


def test_bitmap_membership(spark):
    ids = spark.createDataFrame([(i * 3,) for i in range(2000)] + [(None,)], "idx long").repartition(3)
    pool = spark.createDataFrame([(i, str(i)) for i in range(-500, 5000)] + [(None, "x")], "idx long, t string").repartition(4)
    want = sorted((r.idx is None, r.idx or 0, r.t) for r in pool.join(ids, on="idx", how="left_anti").collect())
    inside = sorted(r.t for r in pool.join(ids, on="idx", how="left_semi").collect())
    for bits in (1 << 15, 1 << 16, 1 << 24):   # the small one is full of collisions
        assert sorted((r.idx is None, r.idx or 0, r.t) for r in M.rows_not_in(pool, ids, bits=bits).collect()) == want
        assert sorted(r.t for r in M.rows_in(pool, ids, bits=bits).collect()) == inside
    empty = ids.where("idx < 0")
    assert M.rows_not_in(pool, empty).count() == pool.count() and M.rows_in(pool, empty).count() == 0


def test_pool_is_not_exchanged(spark, tmp_path):
    pool = spark.range(200_000).withColumnRenamed("id", "idx")
    pool.write.parquet(str(tmp_path / "pool"))
    pool, ids = spark.read.parquet(str(tmp_path / "pool")), spark.range(0, 3000).withColumnRenamed("id", "idx")
    out = L.pool_minus(pool, ids, by="bitmap")
    assert out.count() == 197_000
    held = M.bitmap(ids, "idx")
    through = pool.where(M.may_be_in(F.col("idx"), held)).count()
    assert 3000 <= through < 3200   # the members and a few collisions meet the ids
