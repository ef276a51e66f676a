"""Keyed label state and metrics by retraction."""

import random

from pyspark.sql import functions as F

from drawpool.operators import evaluate as E
from drawpool.operators import ledger as L
from drawpool.streaming.label_state import LabelState, annotation_events, prediction_events

LEDGER = "idx long, label string, ts timestamp, seq long"


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "idx long, label string, t long, seq long").select("idx", "label", F.timestamp_seconds("t").alias("ts"), "seq")


def _same(a, b):
    key = lambda d: sorted(map(str, map(tuple, d.collect())))
    assert key(a) == key(b)


def test_three_feeds_out_of_order_with_restarts(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(12) if i % 3 else 5, rng.choice(["a", "b", "c", None]), rng.randrange(40), i) for i in range(600)]   # id 5 has a third of them
    preds = [(i, rng.choice(["a", "b"])) for i in range(10)]
    parts = [[r for r in rows if r[3] % 3 == k] for k in (2, 0, 1)]
    base = str(tmp_path / "state")
    pred = spark.createDataFrame(preds, "idx long, pred string")
    seen = []
    for k, part in enumerate(parts):
        state = LabelState(spark, base)   # a new driver each time: only the folder is kept
        if k == 1:
            state.add(prediction_events(pred, 0))   # predictions come between the feeds
        state.add(annotation_events(_ledger(spark, part)).repartition(3))
        state.advance()
        seen += part
        latest = L.latest_annotation(_ledger(spark, seen))
        _same(state.latest(), latest.select("idx", "label"))
        if k:
            gp = latest.join(pred, on="idx").select(F.col("label").alias("gold"), "pred")
            _same(state.confusion(), E.confusion(gp))
            _same(state.metrics(6), E.eval_metrics(gp, digits=6))
    n = state.changes().count()
    state.add(annotation_events(_ledger(spark, parts[0])))   # all of it old
    state.advance()
    assert state.changes().count() == n


def test_new_predictions_move_cells(spark, tmp_path):
    state = LabelState(spark, str(tmp_path / "s"), max_files_per_trigger=1)
    state.add(annotation_events(_ledger(spark, [(i, "ab"[i % 2], 1, i) for i in range(20)])))
    state.advance()
    first = spark.createDataFrame([(i, "a") for i in range(20)], "idx long, pred string")
    second = first.withColumn("pred", F.when(F.col("idx") < 6, "b").otherwise("a"))
    for r, p in ((0, first), (1, second), (0, first)):   # a late round changes nothing
        state.add(prediction_events(p, r))
        state.advance()
    got = {(r.gold, r.pred): r.n for r in state.confusion().collect()}
    assert got == {("a", "b"): 3, ("b", "b"): 3, ("a", "a"): 7, ("b", "a"): 7}


def test_cost_follows_the_changed_ids(spark, tmp_path):
    state = LabelState(spark, str(tmp_path / "s"))
    state.add(annotation_events(_ledger(spark, [(i, "a", 1, i) for i in range(3000)])))
    state.advance()
    state.add(annotation_events(_ledger(spark, [(7, "b", 2, 9000), (8, "a", 2, 9001)])))
    state.advance()
    last = state.changes().where("batch_id > 0").collect()
    assert [(r.idx, r.old_label, r.new_label) for r in last] == [(7, "a", "b")]   # id 8 kept its label


def test_state_is_kept_by_buckets_and_exact(spark, tmp_path, monkeypatch):
    """One state value for a bucket of ids, not one for each; ids beyond 2^53 beside none and events without a time stay exact."""
    monkeypatch.setattr("drawpool.streaming.label_state.BUCKETS", 4)
    rows = [(2**60 + i, "ab"[i % 2], 5, i) for i in range(200)] + [(None, "n", 5, 1), (3, "old", None, 1), (3, "new", 1, None), (2**60, None, 9, 2)]
    state = LabelState(spark, str(tmp_path / "s"))
    for part in (rows[::2], rows[1::2]):
        state.add(annotation_events(_ledger(spark, part)))
        state.advance()
    want = {2**60 + i: "ab"[i % 2] for i in range(200)} | {None: "n", 3: "new", 2**60: None}
    assert {r.idx: r.label for r in state.latest().collect()} == want
    assert spark.read.format("statestore").load(state.path("checkpoint")).count() <= 4
