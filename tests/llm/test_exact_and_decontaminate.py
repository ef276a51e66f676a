import hashlib
import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents, rows_of, sql_rows  # noqa: E402

from drawpool.llm import decontaminate, exact_dedup, oracle, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = {t: f"{SF}/{t}.parquet" for t in ("documents", "benchmark")}


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_exact_dedup"])
def test_query_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == sql_rows(oracle.SQL[name], TABLES)


ODD = [(5, "a  b"), (3, "a\tb"), (9, None), (4, ""), (7, "x" * 70_000), (8, "x" * 70_000), (5, "a  b"), (None, "a b"), (None, "only"), (2, "A b")]


def test_exact_dedup_odd_rows(spark):
    out = exact_dedup.exact_dedup(documents(spark, ODD)).collect()
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out)
    assert got == sorted([("5", "3", 4, False)] * 2 + [("3", "3", 4, True), ("None", "3", 4, False), ("9", "4", 2, False), ("4", "4", 2, True),
                         ("7", "7", 2, True), ("8", "7", 2, False), ("None", "None", 1, True), ("2", "2", 1, True)])
    assert {r.text_sha256 for r in out if r.doc_id == 4} == {hashlib.sha256(b"").hexdigest()}


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_exact_dedup_many_rows_without_id(spark):
    docs = spark.range(50_000).selectExpr("CASE WHEN id % 5 = 0 THEN id END AS doc_id", "concat('text ', id DIV 4) AS text")
    out = exact_dedup.exact_dedup(docs)
    got = out.agg(F.count(F.lit(1)), F.sum("group_size"), F.count("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    keep = [min((i for i in range(4 * g, 4 * g + 4) if i % 5 == 0), default=None) for g in range(12_500)]
    assert tuple(got) == (50_000, 200_000, 4 * sum(k is not None for k in keep), sum(4 if k is None else 1 for k in keep))


def test_exact_dedup_checks_bytes_when_digests_collide(spark):
    docs = documents(spark, [(i, f"text {i % 7}") for i in range(60)])
    weak = exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("binary"))
    full = exact_dedup.exact_dedup(docs)
    assert rows_of(weak) == rows_of(full)


def test_state_goes_on_from_its_folder(spark, tmp_path):
    docs = documents(spark, [(1, "a"), (2, "b"), (3, "a")], extra=False).select(
        "doc_id", F.col("doc_id").alias("locator"), exact_dedup.sha256(F.col("text")).alias("digest"))
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    for ids in ((2, 3), (1,)):
        docs.where(F.col("doc_id").isin(*ids)).coalesce(1).write.mode("append").parquet(src)
        exact_dedup.dedup_state(spark, spark.readStream.schema(docs.schema).parquet(src), state)
    assert sorted((r.keep_id, r.group_size) for r in exact_dedup.read_state(spark, state).collect()) == [(1, 2), (2, 1)]


def _brute(docs, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s:s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s:s + n])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd É9 x the of zz Q-r 12 ñ".split())
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 9, 10, 11, 14, 30, 60, 0, 5])] + [(90, None), (2, text(12)), (None, text(15))]
    items.append((91, items[6][1]))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(120)] + [(500, None), (501, ""), (502, text(3000)), (7, "- -"), (None, items[7][1]), (8, "-")]
    docs += [(600 + i, text(5) + " " + items[j][1][k:k + 70] + " " + text(4)) for i, (j, k) in enumerate([(6, 0), (7, 10), (5, 0), (7, 33)])]
    idf = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.decontaminate(documents(spark, docs), idf).drop("item_ids").collect()
    assert sorted(str(tuple(r)) for r in out) == _brute(docs, items)


def test_decontaminate_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark, [(1, "a b c")])
    assert [(r.n_words, r.n_hit) for r in decontaminate.decontaminate(docs, none).collect()] == [(3, 0)]
    assert decontaminate.decontaminate(documents(spark, []), none).count() == 0


def test_winnowing_guarantee():
    import numpy as np
    rng = random.Random(1)
    for _ in range(200):
        h = np.array([rng.randrange(4) for _ in range(40)], np.uint64)
        chosen = set(decontaminate._winnow(np.arange(40), h, np.zeros(40, int), 6).tolist())
        assert all(chosen & set(range(i, i + 6)) for i in range(35))


def test_no_python_on_the_exact_path(spark):
    plan = exact_dedup.exact_dedup(documents(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
