"""Removal of long repeated passages, found through difference-cover anchors.

A cover of the residues modulo 31 with 6 members has, for any two positions,
a shift below 31 that takes both to members.  So two equal windows of 50 words
share a run of 20 words that begins at a cover position in both documents:
only those runs (one word position in five) are hashed and compared.  Runs
found in more than one document are extended to the 50-word windows that hold
them; of those, the windows that begin in more than one document are kept,
each with the smallest such document, and every later document loses the
words they cover.

Texts are read again for each step instead of being shuffled: what a step
needs of the step before is a bitmap of fixed size, and exact joins follow.
Documents whose words are all those of a smaller one are settled by a digest
of the whole sequence.

Defined cases: null, empty and word-less texts have no words; texts under 50
words lose none; rows of a repeated ``doc_id`` are judged each by its own
text, never against each other; a null ``doc_id`` counts as larger than any
other, so such rows lose words but take none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bitmap, in_bitmap, written
from .textgrid import NONSPACE, Grid, blocks, buffers, mix, ngrams

WINDOW = 50
#: A perfect difference set: every residue modulo 31 but 0 is one difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: A null id, larger than any other.
LAST = (1 << 63) - 1
#: Bits of the bitmaps: 16 MB each.
BITS = 1 << 27


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _row_keys(grid: Grid, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A key of each row by its id and its sequence of words."""
    counts = grid.counts
    some = np.flatnonzero(counts > 0)
    seq = np.zeros(grid.n_docs, np.uint64)
    if len(some):
        from .textgrid import _Q, _spans
        seq[some] = _spans(words, grid.bounds[some], grid.bounds[some + 1], _Q)
    return mix(seq + mix(ids.view(np.uint64))).view(np.int64)


def _anchors(grid: Grid, words: np.ndarray, left: np.ndarray, use: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs at cover positions of the documents in ``use``."""
    pos = np.arange(len(words)) - np.repeat(grid.bounds[:-1], grid.counts)
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    some = np.where(member[pos % PERIOD] & np.repeat(use, grid.counts), left, 0)
    return ngrams(words, some, window - PERIOD + 1)


def _base(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary())])
    for b in batches:
        ids = _ids(b.column("doc_id"))
        for lo, hi, grid in blocks(b.column("text"), NONSPACE, False):
            whole = grid.data.tobytes()
            sha = [hashlib.sha256(b" ".join(whole[s:e].split())).digest() for s, e in zip(grid.offsets[:-1], grid.offsets[1:])]
            yield from batches_of({"doc_id": ids[lo:hi], "rk": _row_keys(grid, grid.hashes(), ids[lo:hi]), "n_words": grid.counts,
                                   "sha": pa.array(sha, pa.binary())}, schema)


def _anchor_rows(reps: np.ndarray, window: int):
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for b in batches:
            ids = _ids(b.column("doc_id"))
            for lo, hi, grid in blocks(b.column("text"), NONSPACE, False):
                words = grid.hashes()
                use = (grid.counts >= window) & in_bitmap(reps, _row_keys(grid, words, ids[lo:hi]), BITS)
                at, h = _anchors(grid, words, grid.left(), use, window)
                yield from batches_of({"h": h.view(np.int64), "doc_id": ids[lo + grid.doc[at]]}, schema)
    return run


def _window_rows(reps: np.ndarray, shared: np.ndarray, twice: np.ndarray | None, window: int):
    """Windows that hold a shared run: (w, v, doc_id), or with ``twice``, a
    bitmap of windows, those that it lets pass with the row's key and place."""
    names = ["w", "v", "doc_id"] + ([] if twice is None else ["rk", "start"])
    schema = pa.schema([(c, pa.int32() if c in ("v", "start") else pa.int64()) for c in names])

    def run(batches):
        for b in batches:
            ids = _ids(b.column("doc_id"))
            for lo, hi, grid in blocks(b.column("text"), NONSPACE, False):
                words, left, doc = grid.hashes(), grid.left(), grid.doc
                keys = _row_keys(grid, words, ids[lo:hi])
                use = (grid.counts >= window) & in_bitmap(reps, keys, BITS)
                at, h = _anchors(grid, words, left, use, window)
                at = at[in_bitmap(shared, h.view(np.int64), BITS)]
                # a window that begins up to 30 words before the run holds it
                steps = np.zeros(len(words) + 1, np.int32)
                np.add.at(steps, np.maximum(at - PERIOD + 1, grid.bounds[doc[at]]), 1)
                np.add.at(steps, at + 1, -1)
                some = np.where(np.cumsum(steps[:-1]) > 0, left, 0)
                at, w = ngrams(words, some, window)
                if twice is not None:
                    pick = in_bitmap(twice, w.view(np.int64), BITS)
                    at, w = at[pick], w[pick]
                    some = np.zeros(len(words), np.int64)
                    some[at] = left[at]
                _, v = ngrams(words, some, window, True)
                d = doc[at]
                cols = {"w": w.view(np.int64), "v": v.astype(np.uint32).view(np.int32), "doc_id": ids[lo + d]}
                if twice is not None:
                    cols |= {"rk": keys[d], "start": (at - grid.bounds[d]).astype(np.int32)}
                yield from batches_of(cols, schema)
    return run


def _passing(marks: np.ndarray):
    """The rows whose key the bitmap lets pass, with their key."""
    def run(batches):
        for b in batches:
            ids = _ids(b.column("doc_id"))
            for lo, hi, grid in blocks(b.column("text"), NONSPACE, False):
                keys = _row_keys(grid, grid.hashes(), ids[lo:hi])
                at = np.flatnonzero(in_bitmap(marks, keys, BITS))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + at]), pa.array(keys[at]), b.column("text").take(pa.array(lo + at)).cast(pa.string())],
                                                     names=["doc_id", "rk", "text"])
    return run


def _cut(window: int):
    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            removed, texts = [], []
            for i, starts in enumerate(b.column("starts")):
                words = data[offsets[i]:offsets[i + 1]].tobytes().split()
                s = np.unique(starts.values.to_numpy(zero_copy_only=False))
                steps = np.zeros(len(words) + 1, np.int32)
                np.add.at(steps, s, 1)
                np.add.at(steps, s + window, -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join(x for x, g in zip(words, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                                             names=["doc_id", "rk", "n_removed", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs`` (doc_id,
    text); with ``texts`` also kept_text, null where nothing was removed."""
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(docs.mapInArrow(_base, "doc_id bigint, rk bigint, n_words bigint, sha binary"), "rows")
    first = written(base.groupBy("sha").agg(F.min("doc_id").alias("first_id")), "sequences")
    base = written(base.join(first, "sha").select("doc_id", "rk", "n_words", "sha", ((F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)).alias("copy")), "rows")
    reps = bitmap(base.where(F.col("n_words") >= window).where("NOT copy"), "rk", BITS)

    anchors = docs.mapInArrow(_anchor_rows(reps, window), "h bigint, doc_id bigint")
    shared = bitmap(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi"), "h", BITS)
    windows = docs.mapInArrow(_window_rows(reps, shared, None, window), "w bigint, v int, doc_id bigint")
    twice = written(windows.groupBy("w", "v").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w", "v", "lo"), "windows")
    again = docs.mapInArrow(_window_rows(reps, shared, bitmap(twice, "w", BITS), window), "w bigint, v int, doc_id bigint, rk bigint, start int")
    starts = written(again.join(twice, ["w", "v"]).where("lo < doc_id").select("rk", "doc_id", "start")
                     .groupBy("rk", "doc_id").agg(F.collect_list("start").alias("starts")), "starts")

    hit = docs.mapInArrow(_passing(bitmap(starts, "rk", BITS)), "doc_id bigint, rk bigint, text string").distinct()
    cut = hit.join(starts, ["rk", "doc_id"]).mapInArrow(_cut(window), "doc_id bigint, rk bigint, n_removed bigint, kept_text string")
    cut = cut.withColumn("kept_sha", F.sha2(F.col("kept_text").cast("binary"), 256))
    cut = written(cut if texts else cut.drop("kept_text"), "cut")
    out = base.join(cut, ["rk", "doc_id"], "left").select(
        F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if texts else []))
    return out
