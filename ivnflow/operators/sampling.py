"""Exact rank cuts without sorting whole classes in one task.

``mark_first_k`` answers "is this row among the first k of its class in
key order" for every row. A class may hold a third of all rows, so a
window partitioned by class is ruled out. Instead:

1. a histogram of (class, key bucket) counts is built with a partial
   aggregate (small: classes x buckets);
2. cumulative counts over the histogram locate, per class, the one bucket
   that holds the cut;
3. rows in earlier buckets are in, rows in later buckets are out, and only
   the rows of the cut bucket are ranked (one small window per class).

The result equals a full ranking; the big input is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED_SUFFIX = "|42"


def hash_key(id_col, seed_suffix: str = SEED_SUFFIX) -> Column:
    """Deterministic pseudo-random order key, equal in Spark and DuckDB."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(seed_suffix)))


def mark_first_k(df: DataFrame, part_cols: list[str], order_cols: list[str],
                 bucket: Column, k: DataFrame, out_col: str = "_in") -> DataFrame:
    """Add boolean ``out_col``: row is among the first ``k`` of its class.

    ``bucket`` must be non-decreasing in ``order_cols`` order. ``k`` is a
    DataFrame with ``part_cols`` and an integer column ``k`` (one row per
    class, so its size is bounded by the number of classes).
    """
    d = df.withColumn("_bkt", bucket)
    hist = d.groupBy(*part_cols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("_cum", F.sum("_n").over(w))
            .transform(lambda h: h.join(F.broadcast(k), part_cols, "left")
                       if part_cols else h.crossJoin(F.broadcast(k)))
            .withColumn("_k", F.coalesce(F.col("k"), F.lit(0)))
            .withColumn("_before", F.col("_cum") - F.col("_n"))
            .withColumn("_status",
                        F.when(F.col("_cum") <= F.col("_k"), F.lit(1))
                        .when(F.col("_before") >= F.col("_k"), F.lit(0))
                        .otherwise(F.lit(2)))
            .select(*part_cols, "_bkt", "_status", "_before", "_k"))
    # The histogram has at most classes x buckets rows: safe to broadcast.
    marked = d.join(F.broadcast(hist), part_cols + ["_bkt"], "inner")
    whole = (marked.where(F.col("_status") != 2)
             .withColumn(out_col, F.col("_status") == 1))
    wc = Window.partitionBy(*part_cols, "_bkt").orderBy(*order_cols)
    cut = (marked.where(F.col("_status") == 2)
           .withColumn(out_col, (F.col("_before") + F.row_number().over(wc)) <= F.col("_k")))
    return whole.unionByName(cut).drop("_bkt", "_status", "_before", "_k")


def md5_bucket(key_col: str, digits: int = 4) -> Column:
    return F.substr(F.col(key_col), F.lit(1), F.lit(digits))


def class_counts(df: DataFrame, part_cols: list[str]) -> DataFrame:
    return df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("n"))


def ordered_bucket(x, mant_bits: int = 8) -> Column:
    """Monotone log-scale bucket of a double: sign, binary exponent and the
    top ``mant_bits`` mantissa bits. Each bucket spans a fixed relative
    range, so heavy-tailed values spread over many buckets (equal-width
    buckets would put almost everything into one). Non-decreasing in x:
    an exponent misjudged by one at an octave edge lands on the same key.
    """
    x = F.col(x) if isinstance(x, str) else x
    ax = F.abs(x)
    scale = 1 << mant_bits
    e = F.floor(F.log2(ax))
    m = F.floor((ax / F.pow(F.lit(2.0), e) - F.lit(1.0)) * F.lit(float(scale)))
    pos = (e + F.lit(1100)) * F.lit(scale) + m + F.lit(1)
    return F.when(x > 0, pos).when(x < 0, -pos).otherwise(F.lit(0)).cast("long")
