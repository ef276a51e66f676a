"""Evaluation (D1-D15): confusion counts, macro/micro P/R/F1, accuracy,
balanced accuracy, per-class report, learning curve.

The scored table is scanned once: one ``groupBy(gold, pred)`` (partial
aggregation map-side, one shuffle of at most classes^2 keys per task).
Every metric is then computed from the counts.  Three class sets, as in the
reference:
* macro averages: classes seen in gold OR pred;
* balanced accuracy: classes seen in gold only;
* class report: the fixed label vocabulary (absent classes count as zeros).
Division by zero gives 0 (zero_division=0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

METRIC_COLUMNS = ["f1_macro", "f1_micro", "accuracy_balanced", "accuracy",
                  "precision_macro", "recall_macro", "precision_micro", "recall_micro"]


def _div(a, b) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# The metric arithmetic is written as SQL expression text: each select is
# then one call into the JVM instead of one per Column operator, which
# matters for the round driver that rebuilds these plans every round.
def _sdiv(a: str, b: str) -> str:
    return f"coalesce(try_divide(cast({a} AS double), cast({b} AS double)), 0D)"


def _sf1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0D END"


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(gold, pred, n)."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """(cls, tp, true_n, pred_n, precision, recall, f1) for classes in gold
    or pred.

    Each confusion cell contributes to its gold class (tp, true_n) and to
    its predicted class (pred_n); both contributions come from one explode,
    so the upstream plan is evaluated once."""
    sides = ("explode(array("
             "named_struct('cls', cast(gold AS string), 'tp', IF(gold = pred, n, 0L), 'true_n', n, 'pred_n', 0L), "
             "named_struct('cls', cast(pred AS string), 'tp', 0L, 'true_n', 0L, 'pred_n', n))) AS s")
    u = conf.selectExpr(sides).selectExpr("s.*").where("cls IS NOT NULL")
    pc = u.groupBy("cls").agg(F.expr("sum(tp) AS tp"), F.expr("sum(true_n) AS true_n"),
                              F.expr("sum(pred_n) AS pred_n"))
    pc = pc.selectExpr("*", f"{_sdiv('tp', 'pred_n')} AS precision", f"{_sdiv('tp', 'true_n')} AS recall")
    return pc.selectExpr("*", f"{_sf1('precision', 'recall')} AS f1")


def metrics_from_confusion(conf: DataFrame, digits: int | None = None) -> DataFrame:
    """One row of the eight aggregate metrics plus n_rows."""
    agg = per_class(conf).selectExpr(
        "avg(precision) AS precision_macro", "avg(recall) AS recall_macro", "avg(f1) AS f1_macro",
        "avg(CASE WHEN true_n > 0 THEN recall END) AS accuracy_balanced",
        "sum(tp) AS _tp", "sum(true_n) AS _true", "sum(pred_n) AS _pred")
    mic = agg.selectExpr("*", f"{_sdiv('_tp', '_pred')} AS precision_micro",
                         f"{_sdiv('_tp', '_true')} AS recall_micro",
                         f"{_sdiv('_tp', '_true')} AS accuracy", "cast(_true AS bigint) AS n_rows")
    mic = mic.selectExpr("*", f"{_sf1('precision_micro', 'recall_micro')} AS f1_micro")

    def out(c):
        e = f"coalesce({c}, 0D)"
        return f"round({e}, {digits}) AS {c}" if digits is not None else f"{e} AS {c}"
    return mic.selectExpr(*[out(c) for c in METRIC_COLUMNS], "n_rows")


def eval_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred",
                 digits: int | None = None) -> DataFrame:
    return metrics_from_confusion(confusion(df, gold, pred), digits)


def class_report(conf: DataFrame, vocab) -> DataFrame:
    """Per-label P/R/F1/support over the fixed vocabulary (a list, or a table
    whose first column holds the labels), plus the rows 'accuracy', 'macro
    avg' and 'weighted avg'.

    The label rows are written once; the summary rows are one aggregate over
    them, of partial sums, so no task gathers the labels."""
    if isinstance(vocab, DataFrame):
        voc = vocab.select(F.col(vocab.columns[0]).alias("cls")).where("cls IS NOT NULL").distinct()
    else:
        voc = conf.sparkSession.createDataFrame([(v,) for v in vocab], "cls string")
    pc = per_class(conf)
    rows = (voc.join(pc, on="cls", how="left")
            .select(F.col("cls").alias("label_text"),
                    F.coalesce("precision", F.lit(0.0)).alias("precision"),
                    F.coalesce("recall", F.lit(0.0)).alias("recall"),
                    F.coalesce("f1", F.lit(0.0)).alias("f1"),
                    F.coalesce("true_n", F.lit(0)).cast("long").alias("support"),
                    F.coalesce("tp", F.lit(0)).cast("long").alias("_tp")))
    rows = materialize(rows, "class-report")
    scores = ("precision", "recall", "f1")
    total = rows.agg(F.sum("support").alias("_n"), F.sum("_tp").alias("_ntp"), *(F.avg(c).alias(f"_m{c}") for c in scores),
                     *(F.sum(F.col(c) * F.col("support")).alias(f"_w{c}") for c in scores)).where("_n IS NOT NULL")
    acc = _div(F.col("_ntp"), F.col("_n"))

    def row(name, values):
        return F.struct(F.lit(name).alias("label_text"), *(v.alias(c) for c, v in zip(scores, values)), F.col("_n").cast("long").alias("support"))
    extra = F.array(row("accuracy", [acc] * 3), row("macro avg", [F.col(f"_m{c}") for c in scores]),
                    row("weighted avg", [_div(F.col(f"_w{c}"), F.col("_n")) for c in scores]))
    return rows.select("label_text", *scores, "support").unionByName(total.select(F.explode(extra).alias("s")).select("s.*"))


def learning_curve(metrics_hist: DataFrame, sample_hist: DataFrame,
                   metric_cols: list[str] = METRIC_COLUMNS) -> DataFrame:
    """Metrics of each round against the number of labels it was trained on:
    the samples drawn in rounds before it (iter-tables have one row per
    round, so the running window is over a tiny table)."""
    per_iter = sample_hist.groupBy("iter").agg(F.count(F.lit(1)).alias("n_sampled"))
    run = Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    cum = per_iter.select("iter", F.sum("n_sampled").over(run).alias("n_labels"))
    return (metrics_hist.join(cum, on="iter", how="left")
            .withColumn("n_labels", F.coalesce(F.col("n_labels"), F.lit(0)).cast("long"))
            .select("iter", "n_labels", *metric_cols))
