import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents, rows_of, sql_rows  # noqa: E402

from drawpool.llm import linking, near_dedup, oracle, queries, substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = {"documents": f"{SF}/documents.parquet"}


@pytest.mark.parametrize("name", ["op5_near_dedup", "op7_substring_dedup"])
def test_query_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == sql_rows(oracle.SQL[name], TABLES)


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def _groups(docs):
    """Brute force over distinct (doc_id, text) rows with an id."""
    ids = sorted({d for d, _ in docs if d is not None})
    comp = {d: d for d in ids}
    rows = [(d, _set(t)) for d, t in docs if d is not None and _set(t)]

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, (a, p) in enumerate(rows):
        for b, q in rows[:i]:
            if 100 * len(p & q) >= 75 * len(p | q):
                lo, hi = sorted((root(a), root(b)))
                comp[hi] = lo
    return {d: root(d) for d in ids}


def _family(rng, n, words=60):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        yield " ".join(t)


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(3)
    texts = [t for _ in range(6) for t in _family(rng, 12)] + [t for t in _family(rng, 60, 200)] + ["a b", "A  b", "a", "b a", "", None, " \n", "a b c d e"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    docs += [(3, texts[3]), (1000, texts[5]), (None, texts[7]), (None, "quite alone here"), (None, None)]
    out = near_dedup.near_dedup(documents(spark, docs)).collect()
    want = _groups(docs)
    assert len(out) == len(docs)
    for r in out:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert {r.doc_id: r.n_shingles for r in out if r.doc_id is not None} == {d: len(_set(t)) for d, t in docs if d is not None}
    assert sorted(str((r.component_id, r.kept)) for r in out if r.doc_id is None) == sorted(map(str, [(want[7], False), (None, True), (None, True)]))


def test_repeated_ids_tie_their_texts(spark):
    docs = [(1, "one two three four five six"), (2, "seven eight nine ten eleven"), (2, "one two three four five six"), (4, "seven eight nine ten eleven")]
    out = near_dedup.near_dedup(documents(spark, docs)).collect()
    assert {r.component_id for r in out} == {1}


def test_near_dedup_empty_table(spark):
    assert near_dedup.near_dedup(documents(spark, [])).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    both, one = rng.integers(0, 2**63, 300, np.uint64), rng.integers(0, 2**63, 200, np.uint64)
    a, b = np.concatenate([both, one[:100]]), np.concatenate([both, one[100:]])
    small = both[:5]
    sig = near_dedup.super_minhash(np.concatenate([a, b, small, small[::-1]]), np.array([0, 400, 800, 805, 810, 810]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    assert (sig[2] == sig[3]).all() and (sig[4] == np.iinfo(np.uint64).max).all()
    assert len(np.unique(sig[2] >> np.uint64(48))) > 1  # a small set goes on drawing until every register is filled
    assert (sig[:4] < np.uint64(512) << np.uint64(48)).all()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, d in ((5, 1), (146, 20), (600, 90), (3000, 700)):
        x = rng.integers(0, 2**63, n + d, np.uint64)
        a, b = x[:n], np.concatenate([x[:n - d], x[n:]])
        p = near_dedup.parities(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert np.bitwise_count((p[0] ^ p[1]).view(np.uint64)).sum() <= 2 * d


def test_leader_rounds_lose_no_link(spark):
    """One bucket: links form a path, so no leader is linked to most members."""
    n = 70
    members = spark.range(n).select(F.lit(1).cast("bigint").alias("bucket"), F.col("id").alias("node"))
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where("y - x = 7")
    got = {r.node: r.component for r in linking.link(members, verify).collect()}
    assert got == {i: i % 7 for i in range(n)}
    assert sum(seen) <= n * (n - 1) // 2


def test_a_large_group_of_copies_costs_one_pair_a_member(spark):
    members = spark.range(3000).select(F.lit(1).cast("bigint").alias("bucket"), F.col("id").alias("node"))
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs
    assert linking.link(members, verify).where("component <> 0").count() == 0
    assert sum(seen) == 2999


def _passages(docs, window=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in enumerate(docs)}
    key = lambda d: (d is None, d or 0)
    first = {}
    for i, (d, _) in enumerate(docs):
        for s in range(len(words[i]) - window + 1):
            g = tuple(words[i][s:s + window])
            first[g] = min(first.get(g, key(d)), key(d))
    out = []
    for i, (d, _) in enumerate(docs):
        gone = set()
        for s in range(len(words[i]) - window + 1):
            if first[tuple(words[i][s:s + window])] < key(d):
                gone |= set(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(words[i]) if p not in gone)
        out.append((d, len(words[i]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: [f"é{rng.randrange(300)}" for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 80, 200)] + [["x"] * 120]
    docs = []
    for i in range(80):
        parts = [text(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 20)
            parts += [p[cut:], text(rng.randrange(0, 40))]
        docs.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    docs += [(5, docs[0][1]), (5, docs[0][1]), (5, docs[3][1]), (None, docs[1][1]), (None, " ".join(passages[3])), (6, None), (7, ""), (8, "a b"), (10**7, " ".join(text(4000) + passages[4]))]
    out = substring_dedup.substring_dedup(documents(spark, docs))
    assert sorted(str(tuple(r)) for r in out.collect()) == _passages(docs)


def test_substring_dedup_empty_table(spark):
    assert substring_dedup.substring_dedup(documents(spark, [])).count() == 0


def test_cover_aligns_every_shift():
    cover, p = set(substring_dedup.COVER), substring_dedup.PERIOD
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))


def test_signatures_take_few_shingles_at_once(monkeypatch):
    """A worker holds a permutation of the registers for each shingle of a block."""
    import pyarrow as pa

    from drawpool.llm import near_dedup as nd

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": [" ".join(f"a{i}b{k}" for k in range(1500)) for i in range(50)]})
    seen, sign = [], nd.super_minhash
    monkeypatch.setattr(nd, "super_minhash", lambda h, *a: seen.append(len(h)) or sign(h, *a))
    assert sum(b.num_rows for b in nd._signatures(5)(iter([batch]))) == 50
    assert sum(seen) == 50 * 1496 and max(seen) <= 50_000
