"""Scores against any number of classes (J4, D14, F3): the classes stay a table.

A row is scored against blocks of classes; each (row, block) gives a state of
fixed size -- the largest logit and its class, the second largest, and the sum
of exponentials relative to the largest -- and states of a row are merged into
prediction, probability and margin.  No class matrix reaches the driver or the
plan.

The exchange is a matrix product by blocks: a task gets the rows of one salt
and one block of classes, both of bounded size, whatever the number of rows or
classes; rows and blocks are dealt on (block, salt) on both sides, so no block
gathers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import PROB_DIGITS
from ..operators.ranking import range_ranks
from ..session import importable, materialize
from .scorers import CENTROID_SCALE, CentroidScorer

#: Classes of a block, and rows that meet a block in one task.
BLOCK_CLASSES, SALT_ROWS = 4096, 20_000
_STATE = "idx bigint, top double, pos bigint, second double, mass double"


def block_states(scale: float):
    """Cogroup function: (rows, classes of a block) -> a state for each row."""
    schema = pa.schema([("idx", pa.int64()), ("top", pa.float64()), ("pos", pa.int64()), ("second", pa.float64()), ("mass", pa.float64())])

    def matrix(col: pa.ChunkedArray) -> np.ndarray:
        flat = col.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def run(rows: pa.Table, classes: pa.Table) -> pa.Table:
        if not rows.num_rows or not classes.num_rows:
            return schema.empty_table()
        order = np.argsort(classes["pos"].to_numpy())
        pos, c = classes["pos"].to_numpy()[order], matrix(classes["centroid"])[order]
        x, out = matrix(rows["x"]), []
        for lo in range(0, len(x), 1024):   # a slice of the logits at a time
            z = scale * (x[lo:lo + 1024] @ c.T)
            best = z.argmax(axis=1)   # the first of equal ones, in class order
            top = z[np.arange(len(z)), best]
            mass = np.exp(z - top[:, None]).sum(axis=1)
            z[np.arange(len(z)), best] = -np.inf
            out.append((top, pos[best], z.max(axis=1), mass))
        top, at, second, mass = (np.concatenate(v) for v in zip(*out))
        return pa.table([rows["idx"], pa.array(top), pa.array(at), pa.array(second), pa.array(mass)], schema=schema)
    return run


def merged(states: DataFrame) -> DataFrame:
    """(idx, top, pos, second, mass) of a row from its blocks' states.  A row
    has one state a block, so what is gathered is bounded by their number."""
    by = F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("down"), "pos", "top", "second", "mass")))
    s = states.groupBy("idx").agg(by.alias("s")).withColumn("best", F.element_at("s", 1))
    runner_up = F.greatest(F.col("best.second"), F.get(F.transform("s", lambda b: b["top"]), 1))
    mass = F.aggregate("s", F.lit(0.0), lambda acc, b: acc + b["mass"] * F.exp(b["top"] - F.col("best.top")))
    return s.select("idx", F.col("best.top").alias("top"), F.col("best.pos").alias("pos"), runner_up.alias("second"), mass.alias("mass"))


class BlockedCentroids:
    """Fitted class table of a nearest-class-mean scorer: (pos, label_text,
    centroid), ``pos`` by alphabet.  Classes without a training row have no
    centroid: their logit is 0, so one row of zeros stands for all of them."""
    kind = "standard"

    def __init__(self, classes: DataFrame, n_classes: int, dim: int, scale: float = CENTROID_SCALE, features: str = "features",
                 block: int = BLOCK_CLASSES, salt_rows: int = SALT_ROWS):
        self.classes, self.n, self.dim, self.scale, self.features = classes, n_classes, dim, scale, features
        self.block, self.salt_rows = block, salt_rows

    @classmethod
    def fit(cls, train: DataFrame, labels: DataFrame | None = None, features: str = "features", scale: float = CENTROID_SCALE, **kw) -> "BlockedCentroids":
        """``labels``: a table whose first column is the vocabulary; the
        labels of ``train`` when there is none."""
        voc = (train.select("label_text") if labels is None else labels.select(F.col(labels.columns[0]).alias("label_text"))).where("label_text IS NOT NULL").distinct()
        numbered = range_ranks(voc, ["label_text"], "pos").withColumn("pos", F.col("pos") - 1)
        cells = CentroidScorer([], features, scale).centroid_table(train)
        means = cells.groupBy("label_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("centroid"))
        classes = materialize(numbered.join(means, on="label_text", how="left"), "classes")
        sizes = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()   # two numbers
        dim = max(0, sizes["d"] or 0)
        classes = classes.withColumn("centroid", F.coalesce("centroid", F.array_repeat(F.lit(0.0), dim)))
        return cls(classes, sizes["n"], dim, scale, features, **kw)

    def states(self, df: DataFrame) -> DataFrame:
        importable(df.sparkSession)
        blocks, n_rows = -(-self.n // self.block), df.count()
        salts = max(1, -(-n_rows // self.salt_rows))
        rows = df.select("idx", F.col(self.features).cast("array<double>").alias("x"), F.pmod(F.xxhash64("idx"), F.lit(salts)).cast("int").alias("salt"),
                         F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("block"))
        cls = self.classes.select("pos", "centroid", F.floor(F.col("pos") / self.block).cast("int").alias("block"),
                                  F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return rows.groupBy("block", "salt").cogroup(cls.groupBy("block", "salt")).applyInArrow(block_states(self.scale), _STATE)

    def score(self, df: DataFrame) -> DataFrame:
        """(idx, pred, pred_pos, prob, margin): the class of the largest logit
        (the first by alphabet of equal ones), its probability and the margin
        of the two largest probabilities, both of four digits as in
        ``strategies.margin_scores``."""
        m = merged(self.states(df))
        first, second = 1 / F.col("mass"), F.exp(F.col("second") - F.col("top")) / F.col("mass")
        margin = F.when(F.col("second") == float("-inf"), F.lit(0.0)).otherwise(F.round(F.round(first, PROB_DIGITS) - F.round(second, PROB_DIGITS), PROB_DIGITS))
        names = self.classes.select("pos", F.col("label_text").alias("pred"))
        return m.join(names, on="pos").select("idx", "pred", F.col("pos").alias("pred_pos"), first.alias("prob"), margin.alias("margin"))
