"""Benchmark decontamination by winnowing.

Of every 6 consecutive 5-word hashes the rightmost smallest is kept as a
fingerprint, in items and documents alike, so every shared span of 10 words
holds a fingerprint that both sides chose.  Document fingerprints pass a
bitmap of fixed size over the items' fingerprints, are joined with them
exactly, and each hit is extended: the 10-word windows around it are joined
with the items' windows on 128-bit hashes.  An item of fewer words is one
window; for each such length the documents' n-grams of that length are the
fingerprints, as winnowing with a window of one.

Defined cases: null or word-less texts have no words and no hits; a null or
repeated ``doc_id`` is a row of its own; repeated items and items with equal
text all count by their id, a null ``item_id`` is hit but not listed; an empty
benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bitmap, in_bitmap, lean, lists, row_ids, written
from .textgrid import ALNUM, Grid, blocks, mix, ngrams

SPAN = 10
GRAM = 5


def _winnow(at: np.ndarray, h: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Indices into ``at`` chosen as the rightmost smallest of some w in a row of one document."""
    n = len(at) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, pos = h[:n].copy(), np.arange(n)
    for j in range(1, w):
        i = np.flatnonzero(h[j:j + n] <= best)
        best[i], pos[i] = h[i + j], i + j
    inside = doc[at[:n]] == doc[at[w - 1:w - 1 + n]]
    chosen = np.zeros(len(at), bool)
    chosen[pos[inside]] = True
    return np.flatnonzero(chosen)


def _prints(grid: Grid, short: list[int], span: int, gram: int):
    """(span length, fingerprint positions, their hashes) of a block; the
    full span first, then each short length."""
    words, left, doc = grid.hashes(), grid.left(), grid.doc
    at, h = ngrams(words, left, gram)
    keep = _winnow(at, h, doc, span - gram + 1)
    yield span, at[keep], h[keep], words, left, doc
    for n in short:
        at, h = ngrams(words, left, n)
        yield n, at, mix(h + np.uint64(n)), words, left, doc


_ITEMS = "item_id bigint, n int, kind string, h bigint, h2 bigint"
_ROWS = "rid bigint, doc_id bigint, n_words bigint, n int, print bigint, starts array<bigint>, h array<bigint>, h2 array<bigint>"


def _item_rows(span: int, gram: int):
    schema = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("h", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for b in batches:
            ids = b.column("item_id").to_numpy(zero_copy_only=False)
            null = b.column("item_id").is_null().to_numpy(zero_copy_only=False)
            ids = np.where(null, 0, ids).astype(np.int64)
            for lo, hi, grid in blocks(b.column("text"), ALNUM, True):
                size = grid.counts
                lengths = sorted({int(x) for x in size if 0 < x < span})
                for n, at, h, words, left, doc in _prints(grid, lengths, span, gram):
                    mine = size[doc[at]] >= span if n == span else size[doc[at]] == n
                    at, h = at[mine], h[mine]
                    spans, s1 = ngrams(words, left, n)
                    _, s2 = ngrams(words, left, n, True)
                    mine = size[doc[spans]] >= span if n == span else size[doc[spans]] == n
                    spans, s1, s2 = spans[mine], s1[mine], s2[mine]
                    for kind, who, a, c in (("print", at, h, h), ("span", spans, s1, s2)):
                        item = lo + doc[who]
                        yield from batches_of({"item_id": pa.array(ids[item], mask=null[item]), "n": np.full(len(who), n, np.int32),
                                               "kind": pa.array([kind] * len(who), pa.string()), "h": a.view(np.int64), "h2": c.view(np.int64)}, schema)
    return run


def _doc_rows(short: list[int], marks: np.ndarray, span: int, gram: int):
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n", pa.int32()), ("print", pa.int64()),
                        *((c, pa.list_(pa.int64())) for c in ("starts", "h", "h2"))])

    def run(batches):
        seen = 0
        for b in batches:
            rid, ids = row_ids(seen, b.num_rows), b.column("doc_id")
            seen += b.num_rows
            for lo, hi, grid in blocks(b.column("text"), ALNUM, True):
                k = hi - lo
                none = pa.array([None] * k, pa.list_(pa.int64()))
                yield from batches_of({"rid": rid[lo:hi], "doc_id": ids.slice(lo, k), "n_words": grid.counts, "n": pa.nulls(k, pa.int32()),
                                       "print": pa.nulls(k, pa.int64()), "starts": none, "h": none, "h2": none}, schema)
                for n, at, h, words, left, doc in _prints(grid, short, span, gram):
                    hit = in_bitmap(marks, h.view(np.int64))
                    at, h = at[hit], h[hit]
                    if not len(at):
                        continue
                    # the spans that hold this fingerprint and lie inside the document
                    back = n - (gram if n == span else n)
                    starts = (at[:, None] - np.arange(back, -1, -1)[None, :]).ravel()
                    owner = np.repeat(np.arange(len(at)), back + 1)
                    d, m = doc[at][owner], len(words)
                    ok = (starts >= grid.bounds[d]) & (starts + n <= grid.bounds[d + 1])
                    starts, owner = starts[ok], owner[ok]
                    uniq, inv = np.unique(starts, return_inverse=True)
                    mask = np.zeros(m, np.int64)
                    mask[uniq] = n
                    some = np.where(mask > 0, left, 0)
                    _, s1 = ngrams(words, some, n)
                    _, s2 = ngrams(words, some, n, True)
                    bounds = np.searchsorted(owner, np.arange(len(at) + 1))
                    di = doc[at]
                    yield from batches_of({
                        "rid": rid[lo + di], "doc_id": ids.take(pa.array(lo + di)), "n_words": np.zeros(len(at), np.int64),
                        "n": np.full(len(at), n, np.int32), "print": h.view(np.int64),
                        "starts": lists(starts - grid.bounds[doc[starts]], bounds) if len(starts) else pa.array([[]] * len(at), pa.list_(pa.int64())),
                        "h": lists(s1[inv].view(np.int64), bounds) if len(starts) else pa.array([[]] * len(at), pa.list_(pa.int64())),
                        "h2": lists(s2[inv].view(np.int64), bounds) if len(starts) else pa.array([[]] * len(at), pa.list_(pa.int64()))}, schema)
    return run


def contaminated_spans(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): every document row (rid, doc_id, n_words), and its spans
    that occur in items (rid, start, n, item_ids)."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = written(items.mapInArrow(_item_rows(span, gram), _ITEMS), "items")
    prints = known.where("kind = 'print'").select("n", F.col("h").alias("print")).distinct()
    # one row for each distinct span: its items; a table of its own, so that joins may split either side
    spans = written(known.where("kind = 'span'").groupBy("n", "h", "h2").agg(F.collect_set("item_id").alias("item_ids")), "spans")
    prints = written(prints, "prints")
    short = sorted(r["n"] for r in prints.where(F.col("n") < span).select("n").distinct().collect())  # below ``span`` values
    marks = bitmap(prints, "print")

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(lean(_doc_rows(short, marks, span, gram)), _ROWS), "prints-of-documents")
    found = rows.where(F.col("print").isNotNull()).join(prints, ["n", "print"], "left_semi")
    around = found.select("rid", "n", F.explode(F.arrays_zip("starts", "h", "h2")).alias("s")).select("rid", "n", "s.starts", "s.h", "s.h2")
    hits = around.join(spans, ["n", "h", "h2"]).select("rid", F.col("starts").alias("start"), "n", "item_ids")
    return rows.where(F.col("print").isNull()).select("rid", "doc_id", "n_words"), hits


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids
    per row of ``docs`` (doc_id, text) against ``items`` (item_id, text)."""
    rows, hits = contaminated_spans(docs, items, span, gram)
    per = hits.groupBy("rid").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
                          lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).cast("bigint").alias("n"),
                                                F.greatest(a["upto"], s["end"]).cast("bigint").alias("upto")), lambda a: a["n"])
    out = rows.join(per.select("rid", covered.alias("n_hit"), "item_ids"), "rid", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    names = F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                      F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                      F.array_sort(ids).alias("item_ids"))
