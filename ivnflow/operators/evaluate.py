"""Detection metrics over a scored table ``(y_true, y_prob)``.

Curves and ranking metrics start from one row per distinct score
(``groupBy(score)``, partial aggregation), then need prefix sums in score
order. A window without partitioning would run in one task, so
``running_totals`` cuts the scores into ranges of equal numbers of rows
(range partitioning, whatever their distribution: saturated scores near 1
as well as heavy tails), sums each range, and adds the exclusive prefix of
the range sums as an offset to a window per range.

Threshold sweeps never expand rows: a ``Bucketizer`` maps each score to
the number of grid thresholds at or below it (binary search in the JVM),
and everything after that works on at most grid-size rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def running_totals(df: DataFrame, order_col: str, cols: list[str], descending: bool = True,
                   prefix: str = "cum_", total_prefix: str | None = None,
                   within: list[str] | None = None) -> DataFrame:
    """Add inclusive running sums of ``cols`` in ``order_col`` order, per group
    of the non-null columns ``within``; with ``total_prefix`` also the totals.

    ``df`` should hold one row per distinct ``order_col`` value (and group).
    Rows are range-partitioned and checkpointed with their range number, so
    every reader, and every retry, sees the same ranges.
    """
    groups = within or []
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(df.repartitionByRange(n, *groups, o).withColumn("_p", F.spark_partition_id()))
    tot = d.groupBy(*groups, "_p").agg(*[F.sum(c).alias(c + "_t") for c in cols])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*groups, "_p", *[F.coalesce(F.sum(c + "_t").over(before), F.lit(0)).alias(c + "_o") for c in cols],
                     *([F.sum(c + "_t").over(whole).alias(total_prefix + c) for c in cols] if total_prefix else []))
    # at most one row per range and one more per group
    d = d.join(F.broadcast(off), [*groups, "_p"])
    w = Window.partitionBy(*groups, "_p").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in cols:
        d = d.withColumn(prefix + c, F.sum(c).over(w) + F.col(c + "_o"))
    return d.drop("_p", *[c + "_o" for c in cols])


def score_table(df: DataFrame, y: str = "y_true", s: str = "y_prob") -> DataFrame:
    """One row per distinct score with positive and negative counts."""
    return df.groupBy(F.col(s).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))


def curve_points(df: DataFrame, y: str = "y_true", s: str = "y_prob") -> DataFrame:
    """Per distinct score (descending): tp, fp, fn, tn at threshold = score."""
    r = running_totals(score_table(df, y, s), "score", ["pos", "neg"], total_prefix="all_")
    return r.select(
        "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        (F.col("all_pos") - F.col("cum_pos")).alias("fn"), (F.col("all_neg") - F.col("cum_neg")).alias("tn"),
        F.col("all_pos").alias("P"), F.col("all_neg").alias("N"))


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def roc_curve(df, y="y_true", s="y_prob") -> DataFrame:
    c = curve_points(df, y, s)
    return c.select(F.col("score").alias("threshold"), _div(F.col("fp"), F.col("N")).alias("fpr"),
                    _div(F.col("tp"), F.col("P")).alias("tpr"))


def pr_curve(df, y="y_true", s="y_prob") -> DataFrame:
    c = curve_points(df, y, s)
    return c.select(F.col("score").alias("threshold"),
                    _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _div(F.col("tp"), F.col("P")).alias("recall"))


def det_curve(df, y="y_true", s="y_prob") -> DataFrame:
    c = curve_points(df, y, s)
    return c.select(F.col("score").alias("threshold"), _div(F.col("fp"), F.col("N")).alias("fpr"),
                    _div(F.col("fn"), F.col("P")).alias("fnr"))


def roc_auc(df, y="y_true", s="y_prob") -> DataFrame:
    """Exact ROC-AUC; tied scores count one half (trapezoid)."""
    c = curve_points(df, y, s)
    return c.agg(_div(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)),
                      F.first("P").cast("double") * F.first("N").cast("double")).alias("roc_auc"))


def average_precision(df, y="y_true", s="y_prob") -> DataFrame:
    """Step-sum average precision: sum over distinct scores of
    (R_n - R_{n-1}) * P_n."""
    c = curve_points(df, y, s)
    return c.agg(_div(F.sum(F.col("pos") * _div(F.col("tp"), F.col("tp") + F.col("fp"))),
                      F.first("P")).alias("average_precision"))


def confusion(df, t: float, y="y_true", s="y_prob") -> DataFrame:
    pred = F.col(s) >= F.lit(t)
    pos = F.col(y) == 1
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.agg(cnt(~pos & ~pred).alias("tn"), cnt(~pos & pred).alias("fp"),
                  cnt(pos & ~pred).alias("fn"), cnt(pos & pred).alias("tp"))


def prf_cols(tp="tp", fp="fp", fn="fn"):
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    return [_div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
            _div(2 * tp, 2 * tp + fp + fn).alias("f1")]


def prf(df, t: float, y="y_true", s="y_prob") -> DataFrame:
    return confusion(df, t, y, s).select("*", *prf_cols())


def accuracy(df, t: float, y="y_true", s="y_prob") -> DataFrame:
    c = confusion(df, t, y, s)
    return c.select(_div(F.col("tp") + F.col("tn"),
                         F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))


def log_loss(df, y="y_true", s="y_prob", eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.least(F.greatest(F.col(s), F.lit(eps)), F.lit(1 - eps))
    yy = F.col(y).cast("double")
    return df.agg(F.avg(-(yy * F.ln(p) + (1 - yy) * F.ln(1 - p))).alias("log_loss"))


# ---- threshold grids ----------------------------------------------------------

def arange(start: float, stop: float, step: float) -> list[float]:
    """Grid with the same doubles as a numpy ``arange`` (start + i * delta,
    delta = (start + step) - start)."""
    n = int(math.ceil((stop - start) / step))
    delta = (start + step) - start
    return [start + i * delta for i in range(n)]


def threshold_counts(df: DataFrame, thresholds: list[float], y="y_true", s="y_prob") -> DataFrame:
    """tp, fp, fn, tn for each threshold (predict positive iff score >= t)."""
    spark = df.sparkSession
    splits = [-math.inf] + list(thresholds) + [math.inf]
    bz = Bucketizer(splits=splits, inputCol="_s", outputCol="_idx", handleInvalid="keep")
    d = bz.transform(df.select(F.col(s).cast("double").alias("_s"), F.col(y).alias("_y")))
    d = d.withColumn("_idx", F.when(F.isnan("_s"), F.lit(0)).otherwise(F.col("_idx").cast("int")))
    g = d.groupBy("_idx").agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).cast("long").alias("neg"))
    grid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)],
                                 T.StructType([T.StructField("i", T.IntegerType()),
                                               T.StructField("threshold", T.DoubleType())]))
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # both sides are bounded by the grid size
    j = F.broadcast(grid).join(F.broadcast(g), F.col("_idx") > F.col("i"), "left")
    above = j.groupBy("i", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"),
                                            F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    return above.crossJoin(F.broadcast(tot)).select(
        "i", "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
        (F.col("N") - F.col("fp")).alias("tn"))


def f1_curve(df, thresholds, y="y_true", s="y_prob") -> DataFrame:
    return threshold_counts(df, thresholds, y, s).select("i", "threshold", *prf_cols())


def best_threshold(df, thresholds=None, y="y_true", s="y_prob",
                   default=(0.5, 0.0)) -> DataFrame:
    """First threshold with the strictly highest F1; ``default`` when no
    threshold gives F1 > 0."""
    thresholds = thresholds or arange(0.01, 0.99, 0.01)
    c = f1_curve(df, thresholds, y, s)
    best = c.where(F.col("f1") > 0).agg(F.min_by(F.struct("threshold", "f1"),
                                                 F.struct(-F.col("f1"), F.col("i"))).alias("b"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(default[0])).alias("threshold"),
                       F.coalesce(F.col("b.f1"), F.lit(default[1])).alias("f1"))


def scenario_metrics(df, t: float, scenario: str, y="y_true", s="y_prob") -> DataFrame:
    """All metrics of one scored set at threshold ``t`` as one row.

    Everything comes from the distinct-score table: the counts at ``t`` are
    sums over scores >= t, so the data is scanned once.
    """
    c = curve_points(df, y, s)
    at = F.col("score") >= F.lit(t)
    a = c.agg(
        F.sum(F.when(at, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(at, F.col("neg")).otherwise(0)).alias("fp"),
        F.first("P").alias("_P"),
        _div(F.sum(F.col("pos") * _div(F.col("tp"), F.col("tp") + F.col("fp"))),
             F.first("P")).alias("pr_auc"),
        _div(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)),
             F.first("P").cast("double") * F.first("N").cast("double")).alias("roc_auc"))
    a = a.withColumn("fn", F.col("_P") - F.col("tp"))
    return a.select(F.lit(scenario).alias("scenario"), F.lit(float(t)).alias("threshold"),
                    *prf_cols(), "pr_auc", "roc_auc")


# ---- impurity ------------------------------------------------------------------

def gini_splits(df: DataFrame, feature: str, y: str = "label") -> DataFrame:
    """Gini impurity and gain for every split ``feature <= v`` over the
    distinct values v (one row per candidate split)."""
    g = df.groupBy(F.col(feature).alias("value")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.count(F.lit(1)).alias("n"))
    r = running_totals(g, "value", ["pos", "n"], descending=False, total_prefix="_all_")

    def gini(p, n):
        q = _div(p, n)
        return F.lit(1.0) - q * q - (F.lit(1.0) - q) * (F.lit(1.0) - q)

    lp, ln = F.col("cum_pos"), F.col("cum_n")
    rp, rn = F.col("_all_pos") - lp, F.col("_all_n") - ln
    parent = gini(F.col("_all_pos"), F.col("_all_n"))
    gl = F.when(ln > 0, gini(lp, ln)).otherwise(F.lit(0.0))
    gr = F.when(rn > 0, gini(rp, rn)).otherwise(F.lit(0.0))
    weighted = (ln * gl + rn * gr) / F.col("_all_n")
    return r.select(F.col("value").alias("split_value"), ln.alias("n_left"), rn.alias("n_right"),
                    gl.alias("gini_left"), gr.alias("gini_right"), weighted.alias("gini_weighted"),
                    (parent - weighted).alias("gain"))
