"""Profiles of packet and feature tables (A1-A7) and exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.someip import someip_port
from ..session import cut_lineage
from .evaluate import running_totals
from .sampling import ordered_bucket

# Fixed value: attack share in the authors' labelled matrices.
EXPECTED_ATTACK_SHARE = 0.117


def to_long(df: DataFrame, cols: list[str], key: str = "feature", value: str = "value",
            keep: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` into (key, value) rows."""
    return df.select(*(keep or []), F.explode(F.array(*[
        F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(value)) for c in cols])).alias("_kv")
    ).select(*(keep or []), f"_kv.{key}", f"_kv.{value}")


def capture_counts(pk: DataFrame, file_col: str = "pcap_file") -> DataFrame:
    """Frames read and kept (SOME/IP port range) per capture file."""
    kept = F.sum(F.when(someip_port("src_port", "dst_port"), 1).otherwise(0)).cast("long")
    return pk.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_read"), kept.alias("n_kept")) \
        .withColumn("pct_kept", F.col("n_kept") * 100.0 / F.col("n_read"))


def class_distribution(df: DataFrame, label_col: str = "label_str") -> DataFrame:
    g = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # one row per class: the total is a window over a tiny table
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def per_column(df: DataFrame, values: dict[str, Column], aggs: dict, key: str = "feature") -> DataFrame:
    """One row per named value from one wide aggregate: rows are not expanded,
    only the single result row is turned on its side."""
    wide = df.agg(*[agg(v).alias(f"_{i}_{a}") for i, v in enumerate(values.values()) for a, agg in aggs.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias(key), *[F.col(f"_{i}_{a}").alias(a) for a in aggs])
        for i, name in enumerate(values)])))


def _doubles(cols: list[str]) -> dict[str, Column]:
    return {c: F.col(c).cast("double") for c in cols}


def feature_range(df: DataFrame, cols: list[str]) -> DataFrame:
    return per_column(df, _doubles(cols), {"x_min": F.min, "x_max": F.max})


def zero_share(df: DataFrame, cols: list[str]) -> DataFrame:
    return per_column(df, _doubles(cols), {
        "zero_share": lambda v: F.avg(F.when(v == 0, 1.0).otherwise(0.0))})


def exact_quantiles(lng: DataFrame, qs: list[float], key: str = "feature",
                    value: str = "value") -> DataFrame:
    """Exact linear-interpolated quantiles per key, as pandas computes them.

    Values are cut into monotone log-scale buckets (robust to heavy tails);
    a histogram, checkpointed once, locates the buckets holding the two ranks
    around each quantile, and only the distinct values of those buckets are
    ranked, by ``running_totals`` over value ranges. No key's values are ever
    gathered into one task or buffer, and heavy ties (a third of rows equal to
    0.0, say) cost one row, not one row each. Keys must not be null.
    """
    vb = lng.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))) \
        .withColumn("_b", ordered_bucket(F.col(value)))
    # at most keys x buckets rows
    hist = cut_lineage(vb.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c")))
    st = hist.groupBy(key).agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_cum", F.sum("_c").over(w)).withColumn("_before", F.col("_cum") - F.col("_c"))
    # needed 0-based ranks: floor and ceil of (n - 1) * q
    need = st.select(key, F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"),
                     ((F.col("_n") - 1) * F.col("q")).alias("_h")) \
        .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    # one row per key, quantile and rank
    at = cut_lineage(need.alias("r").join(cum.alias("h"), (F.col(f"r.{key}") == F.col(f"h.{key}"))
                                          & (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_cum")))
                     .select(f"r.{key}", "q", "_h", "_r", "_b", "_before"))
    cut = at.select(key, "_b", "_before").distinct()
    dv = vb.join(F.broadcast(cut), [key, "_b"]).groupBy(key, "_b", "_before", value) \
        .agg(F.count(F.lit(1)).alias("_cv"))
    dv = running_totals(dv, value, ["_cv"], descending=False, within=[key, "_b"]) \
        .withColumn("_vhi", F.col("_before") + F.col("cum__cv")) \
        .withColumn("_vlo", F.col("_vhi") - F.col("_cv"))
    vals = dv.alias("d").join(F.broadcast(at.alias("a")), (F.col(f"a.{key}") == F.col(f"d.{key}"))
                              & (F.col("a._b") == F.col("d._b")) & (F.col("_r") >= F.col("_vlo"))
                              & (F.col("_r") < F.col("_vhi"))) \
        .select(f"a.{key}", "q", "_h", F.col(f"d.{value}").alias("_v"))
    nq = vals.groupBy(key, "q", "_h").agg(F.min("_v").alias("_lo_v"), F.max("_v").alias("_hi_v"))
    frac = F.col("_h") - F.floor("_h")
    return nq.select(key, "q", (F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * frac).alias("quantile"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear) and max per column;
    a column without values has count 0 and nulls."""
    base = per_column(df, _doubles(cols), {"count": F.count, "mean": F.avg, "std": F.stddev_samp,
                                           "min": F.min, "max": F.max})
    q = exact_quantiles(to_long(df, cols), [0.25, 0.5, 0.75])
    qw = q.groupBy("feature").agg(*[F.max(F.when(F.col("q") == x, F.col("quantile"))).alias(n)
                                    for x, n in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]])
    # one row per column
    return base.join(F.broadcast(qw), "feature", "left").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def pair_sums(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """min / max / mean of a + b for each column pair (data check, not an identity)."""
    return per_column(df, {f"{a}+{b}": F.col(a) + F.col(b) for a, b in pairs},
                      {"s_min": F.min, "s_max": F.max, "s_mean": F.avg}, key="pair")


def label_quality(df: DataFrame, label_col: str = "label",
                  expected_share: float = EXPECTED_ATTACK_SHARE) -> DataFrame:
    """Attack share vs the expected share, and the always-attack classifier."""
    a = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("long").alias("n_attack"))
    p = F.col("n_attack") / F.col("n")
    return a.select("n", "n_attack", p.alias("attack_share"), F.lit(expected_share).alias("expected_share"),
                    p.alias("const_precision"),
                    F.when(F.col("n_attack") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("const_recall"),
                    F.coalesce(F.try_divide(2 * p, p + 1), F.lit(0.0)).alias("const_f1"))
