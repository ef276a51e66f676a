"""Length-bucketed batches of a user's text model; zip archives as a source."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawpool.plans.text_batches import TextBatches, batched, word_count_predict_fn
from drawpool.sources.readers import read_delimited
from drawpool.sources.zipped import read_zip_csv, write_zip_csv


def test_batches_are_bounded_and_whole(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["la"] * int(rng.paretovariate(1.1) * 5))) for i in range(4000)] + [(5000, "la " * 90_000), (5001, None), (5002, "")]
    df = spark.createDataFrame(rows, "idx long, text string").repartition(4)
    out = TextBatches(word_count_predict_fn([["la"], ["no"]]), max_cells=20_000).batches(df).collect()
    assert sorted(r.idx for r in out) == sorted(i for i, _ in rows)   # each row once
    assert {r.idx: r.z for r in out} == {i: [float((t or "").split().count("la")), 0.0] for i, t in rows}   # of whole texts
    by = {}
    for r in out:
        by.setdefault(r.batch, []).append(r)
    real, padded = sum(r.n_tokens for r in out), sum(r.width for r in out)
    assert padded <= 1.3 * real
    for b in by.values():
        assert {r.width for r in b} == {max(r.n_tokens for r in b)}
        assert len(b) == 1 or b[0].width * len(b) <= 20_000
    assert [len(b) for b in by.values() if any(r.idx == 5000 for r in b)] == [1]   # larger than the bound: alone
    assert len(by) < len(rows) / 5


def test_batched_closes_by_width_and_spread():
    got = [[n for n, in g] for g in batched(((n,) for n in (0, 0, 1, 10, 12, 13, 14, 90, 100)), 30, 1.3)]
    assert got == [[0, 0], [1], [10, 12], [13, 14], [90], [100]]


def test_scores_have_probabilities(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b")], "idx long, text string")
    got = {r.idx: r.probs for r in TextBatches(word_count_predict_fn([["a"], ["b"]])).score(df).collect()}
    assert np.allclose(got[1], [.5, .5]) and np.allclose(got[2], [1 / (1 + np.e), np.e / (1 + np.e)])


ROWS = [("1", "plain", "x"), ("2", 'with "quotes", commas', "line\nend\r\nand more"), ("3", None, ""), ("4", "", None), ("5", "é 日本", "  blanks  ")]


def _csv(rows):
    q = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
    return "\n".join(",".join(map(q, r)) for r in [("id", "a", "b"), *rows]) + "\n"


def _sorted(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_zip_equals_the_unpacked_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", _csv(ROWS[:3]))
        z.writestr("sub/two.csv", _csv(ROWS[3:]))
        z.writestr("empty.csv", "")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.csv").write_text(_csv(ROWS), newline="")
    zipped = read_delimited(spark, str(tmp_path / "t.zip"))
    assert zipped.rdd.getNumPartitions() == 3 and zipped.columns == ["id", "a", "b"]   # one for each member
    assert _sorted(zipped) == _sorted(read_delimited(spark, str(tmp_path / "plain")))
    assert _sorted(read_zip_csv(spark, str(tmp_path / "t.zip"))) == sorted(map(str, ROWS))   # quoted empties kept apart
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("none", T.StringType())])
    assert sorted((r.id, r.b, r.none) for r in read_delimited(spark, str(tmp_path / "t.zip"), schema).where("b IS NOT NULL").collect())[0] == (1, "x", None)


def test_empty_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    schema = T.StructType([T.StructField("id", T.StringType())])
    assert read_zip_csv(spark, str(tmp_path / "none.zip"), schema).count() == 0
    with pytest.raises(Exception, match="no member with a header"):
        read_zip_csv(spark, str(tmp_path / "none.zip"))


def test_round_trip_through_archives(spark, tmp_path):
    df = spark.range(9000).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "").otherwise(F.concat(F.lit('a "b",\n'), F.col("id").cast("string"))).alias("t"))
    write_zip_csv(df.repartition(3), str(tmp_path / "z"))
    back = read_zip_csv(spark, f"file:{tmp_path}/z", df.schema)
    assert back.rdd.getNumPartitions() == 3 and _sorted(back) == _sorted(df)
