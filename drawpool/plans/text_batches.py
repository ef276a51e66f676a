"""Batches of texts of like length for a user's own model.

A fixed number of rows per batch pads every text to the longest one.  Here the
texts of a partition are sorted by their token count and a batch is closed
before its longest text is more than ``SPREAD`` times its shortest, or before
its padded size goes over a bound: at most ``SPREAD`` padded cells for a real
one, and bounded memory for the model, with whole texts.  A text larger than
the bound is a batch of its own.  The sort is within the partitions that were
read, so nothing is exchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import softmax
from ..functions.text import ws_tokens
from ..session import importable

#: Padded tokens of a batch, and longest text over shortest.
MAX_CELLS, SPREAD = 1 << 16, 1.3
_SCHEMA = pa.schema([("idx", pa.int64()), ("z", pa.list_(pa.float64())), ("n_tokens", pa.int64()), ("batch", pa.int64()), ("width", pa.int64())])


def batched(rows: Iterator[tuple], max_cells: int, spread: float) -> Iterator[list[tuple]]:
    """Groups of (n_tokens, ...) rows that come in rising order."""
    held: list[tuple] = []
    for row in rows:
        if held and (row[0] > spread * held[0][0] or row[0] * (len(held) + 1) > max_cells):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


class TextBatches:
    """``make_predict_fn() -> predict(texts, width) -> (n, K)`` array of
    logits, built once per task; ``width`` is the token count of the batch's
    longest text.  ``length`` counts the tokens of a text (white-space tokens
    by default), for models with a tokenizer of their own."""
    kind = "standard"

    def __init__(self, make_predict_fn: Callable, length: Callable[[str], Column] | None = None, max_cells: int = MAX_CELLS, spread: float = SPREAD):
        self.make_predict_fn, self.max_cells, self.spread = make_predict_fn, max_cells, spread
        self.length = length or (lambda c: F.size(ws_tokens(F.coalesce(F.col(c), F.lit("")))))

    def fit(self, train: DataFrame | None) -> "TextBatches":
        return self

    def batches(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(idx, z, n_tokens, batch, width): each row's logits and its batch."""
        importable(df.sparkSession)
        make, cells, spread = self.make_predict_fn, self.max_cells, self.spread

        def run(batches):
            from pyspark import TaskContext

            predict, number = make(), TaskContext.get().partitionId() << 33

            def rows():
                for b in batches:
                    yield from zip(b.column("n").to_pylist(), b.column("idx").to_pylist(), b.column("t").to_pylist())
            for k, group in enumerate(batched(rows(), cells, spread)):
                n, idx, texts = zip(*group)
                z = np.asarray(predict([t or "" for t in texts], n[-1]), np.float64).reshape(len(idx), -1)
                ends = np.arange(len(idx) + 1, dtype=np.int32) * z.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.ListArray.from_arrays(ends, z.ravel()), pa.array(n, pa.int64()),
                                                  pa.array([number + k] * len(idx)), pa.array([n[-1]] * len(idx), pa.int64())], schema=_SCHEMA)
        rows = df.select(F.col("idx").cast("bigint").alias("idx"), F.col(text).alias("t"), self.length(text).cast("bigint").alias("n"))
        return rows.sortWithinPartitions("n").mapInArrow(run, "idx bigint, z array<double>, n_tokens bigint, batch bigint, width bigint")

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(idx, z, probs) of every row, once."""
        return self.batches(df, text).select("idx", "z").withColumn("probs", softmax("z"))


def word_count_predict_fn(lists: list[list[str]]) -> Callable:
    """Example user model: logit k = occurrences of the words of list k."""
    def make():
        def predict(texts, width):
            out = np.zeros((len(texts), len(lists)))
            for i, t in enumerate(texts):
                n = Counter(t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
                out[i] = [sum(n[w] for w in words) for words in lists]
            return out
        return predict
    return make
