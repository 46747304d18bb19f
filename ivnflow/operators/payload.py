"""Benign byte-distribution model and payload scores.

Model: for byte position i and value b, ``P_i(b) = (c_i(b) + a) / (N_i + 256 a)``
counted over the first ``sample_size`` benign payloads in file order.
Scores: log-likelihood ``sum ln(P_i(x_i) + 1e-12)`` over the first
``max_positions`` bytes, and cross-entropy ``-sum / L`` over the full length.

The fitted model is a one-row table holding a flat ``array<double>`` of
log-probabilities (``pos * 256 + byte``); its size is bounded by
``max_positions * 256`` whatever the data size. Scoring never explodes or
shuffles: the default engine gathers the model with numpy over whole Arrow
batches (model shipped as a broadcast variable); the ``sql`` engine keeps
it in Catalyst as a broadcast one-row join with per-row array lookups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import hex_byte_at, hex_len_bytes, hex_valid
from .evaluate import running_totals

LOG_EPS = 1e-12


def benign_sample(df: DataFrame, hex_col: str = "payload_hex",
                  label_col: str = "label_str", order_col: str = "pkt_no",
                  sample_size: int | None = None, benign: str = "normal",
                  bucket_width: int = 1 << 16) -> DataFrame:
    """Benign, non-null payloads: all of them, or the first ``sample_size`` in
    ``order_col`` order.

    ``order_col`` is a non-negative integral file-order key. A histogram of
    key ranges, summed over row ranges, finds the one range with the cut (two
    numbers); the rows are then re-read with literal filters on
    ``order_col``, which reach the parquet scan, so only the table's prefix
    is read again. Only the rows of that one key range are ranked (equal
    keys by payload).
    """
    b = df.where((F.lower(F.col(label_col)) == benign) & F.col(hex_col).isNotNull())
    if sample_size is None:
        return b.select(order_col, hex_col)
    bucket = F.floor(F.col(order_col) / bucket_width)
    hist = b.where(F.col(order_col).isNotNull()).groupBy(bucket.alias("_bkt")).agg(F.count(F.lit(1)).alias("_n"))
    cut = running_totals(hist, "_bkt", ["_n"], descending=False).where(F.col("cum__n") >= sample_size) \
        .agg(F.min(F.struct("_bkt", (F.col("cum__n") - F.col("_n")).alias("_before"))).alias("c")).select("c.*").first()
    if cut["_bkt"] is None:
        # fewer benign payloads than the sample size: all of them
        return b.select(order_col, hex_col)
    low, high = (F.lit(int(cut["_bkt"] + i) * bucket_width) for i in (0, 1))
    b = b.select(order_col, hex_col)
    first = Window.partitionBy(bucket).orderBy(order_col, hex_col)
    last = b.where((F.col(order_col) >= low) & (F.col(order_col) < high)).withColumn("_k", F.row_number().over(first)) \
        .where(F.col("_k") <= sample_size - int(cut["_before"])).drop("_k")
    return b.where(F.col(order_col) < low).unionByName(last)


def fit_byte_model(sample: DataFrame, hex_col: str = "payload_hex",
                   alpha: float = 1.0, max_positions: int = 256,
                   group_cols: list[str] | None = None) -> DataFrame:
    """Long-form model: (group..., pos, byte, cnt, n_pos, prob, logp) for seen pairs.

    Invalid hex strings are skipped (they still used up a sample slot).
    """
    g = group_cols or []
    h = F.col(hex_col)
    v = sample.where(hex_valid(h) & (F.length(h) >= 2))
    n = F.least(hex_len_bytes(h), F.lit(max_positions))
    pairs = v.select(*g, F.posexplode(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: hex_byte_at(h, i))
    ).alias("pos", "byte"))
    counts = pairs.groupBy(*g, "pos", "byte").agg(F.count(F.lit(1)).alias("cnt"))
    # per-position totals over the (at most positions x 256 rows) count table
    counts = counts.withColumn("n_pos", F.sum("cnt").over(Window.partitionBy(*g, "pos")))
    prob = (F.col("cnt") + F.lit(alpha)) / (F.col("n_pos") + F.lit(256.0 * alpha))
    return counts.select(*g, "pos", "byte", "cnt", "n_pos", prob.alias("prob"),
                         F.ln(prob + F.lit(LOG_EPS)).alias("logp"))


def model_vector(model: DataFrame, alpha: float = 1.0,
                 group_cols: list[str] | None = None) -> DataFrame:
    """Dense one-row-per-group form: ``npos`` and flat ``logp`` array.

    Built with a single aggregation: the seen (pos, byte) counts (at most
    ``max_positions * 256`` of them) are gathered into a map and the dense
    array is filled from it. Unseen bytes at a seen position get
    ``a / (N_i + 256 a)``; positions past ``npos`` are scored with the
    uniform 1/256 (see ``unseen_logp``).
    """
    g = group_cols or []
    agg = model.groupBy(*g) if g else model.groupBy()
    m = agg.agg(
        F.coalesce(F.max("pos") + 1, F.lit(0)).cast("int").alias("npos"),
        F.map_from_entries(F.collect_list(F.struct((F.col("pos") * 256 + F.col("byte")).alias("k"),
                                                   F.col("cnt")))).alias("_cnt"),
        F.map_from_entries(F.collect_set(F.struct("pos", "n_pos"))).alias("_tot"))
    dense = F.transform(
        F.sequence(F.lit(0), F.col("npos") * 256 - 1),
        lambda k: F.ln((F.coalesce(F.try_element_at("_cnt", k), F.lit(0)) + F.lit(alpha)) /
                       (F.try_element_at("_tot", F.floor(k / 256).cast("int")) + F.lit(256.0 * alpha))
                       + F.lit(LOG_EPS)))
    return m.select(*g, "npos", F.when(F.col("npos") > 0, dense)
                    .otherwise(F.array().cast("array<double>")).alias("logp"))


def unseen_logp() -> float:
    return math.log(1.0 / 256.0 + LOG_EPS)


UNROLL_BYTES = 32


def loglik_expr(h: Column, npos: Column, logp: Column, max_positions: int = 256) -> Column:
    """Sum of log-probabilities of the first ``max_positions`` bytes.

    The first ``UNROLL_BYTES`` positions (the whole stored payload prefix)
    are plain expressions, so they compile into the generated code; the
    lambda form only runs for longer payloads. Terms are added in byte
    order, as a sequential loop would.
    """
    n = F.least(hex_len_bytes(h), F.lit(max_positions))

    def term(i):
        ii = i if isinstance(i, Column) else F.lit(i)
        return F.when(ii < npos, F.element_at(logp, ii * 256 + hex_byte_at(h, ii) + 1)) \
            .otherwise(F.lit(unseen_logp()))

    u = min(UNROLL_BYTES, max_positions)
    acc = F.lit(0.0)
    for i in range(u):
        acc = acc + F.when(F.lit(i) < n, term(i)).otherwise(F.lit(0.0))
    rest = F.aggregate(F.sequence(F.lit(u), n - 1), acc, lambda a, i: a + term(i))
    return F.when(n > u, rest).otherwise(acc)


def scoreable(h: Column) -> Column:
    return hex_valid(h) & (F.length(h) >= 2)


def score_payloads(df: DataFrame, vec: DataFrame, hex_col: str = "payload_hex",
                   lik_col: str = "likelihood", ent_col: str = "entropy",
                   max_positions: int = 256, engine: str = "arrow") -> DataFrame:
    """Add likelihood and entropy columns; null/short/invalid payloads score 0.0.

    ``engine="arrow"`` (default) sums the log-probabilities in an
    Arrow-batched pandas UDF: a whole batch of hex strings becomes one
    byte matrix and the model is gathered with numpy, about 7x faster than
    the best Catalyst form measured at sf0.1. The model (one row, at most
    ``max_positions * 256`` doubles whatever the data size) travels as a
    broadcast variable. ``engine="sql"`` keeps everything in Catalyst: the
    one-row model is cross-joined as a broadcast and looked up per row.
    """
    h = F.col(hex_col)
    ok = scoreable(h)
    if engine == "arrow":
        from ..session import ship_package
        ship_package(df.sparkSession)
        m = vec.first()
        # no more of a payload than is scored reaches the Python workers
        ll = _arrow_loglik(df.sparkSession, list(m["logp"]), int(m["npos"]), max_positions)(F.substring(h, 1, 2 * max_positions))
        return df.select("*", F.when(ok, ll).otherwise(F.lit(0.0)).alias(lik_col)) \
            .withColumn(ent_col, F.when(ok, -F.col(lik_col) / hex_len_bytes(h)).otherwise(F.lit(0.0)))
    m = vec.select(F.col("npos").alias("_npos"), F.col("logp").alias("_logp"))
    j = df.crossJoin(F.broadcast(m))
    ll = loglik_expr(h, F.col("_npos"), F.col("_logp"), max_positions)
    return j.select(
        *df.columns,
        F.when(ok, ll).otherwise(F.lit(0.0)).alias(lik_col),
        F.when(ok, -ll / hex_len_bytes(h)).otherwise(F.lit(0.0)).alias(ent_col))


def _arrow_loglik(spark, logp: list, npos: int, max_positions: int):
    """Vectorised log-likelihood UDF over a broadcast model table."""
    table = np.asarray(logp, dtype=np.float64)
    bc = spark.sparkContext.broadcast(table)
    unseen = unseen_logp()
    lut = np.full(256, 255, dtype=np.uint8)
    for i, c in enumerate(b"0123456789abcdef"):
        lut[c] = i
    for i, c in enumerate(b"ABCDEF"):
        lut[c] = 10 + i

    @F.pandas_udf("double")
    def loglik(hx: pd.Series) -> pd.Series:
        tb = bc.value
        s = hx.fillna("")
        nbytes = (s.str.len().to_numpy() // 2)
        w = int(min(max(nbytes.max(initial=0), 1), max_positions))
        cut = s.str.slice(0, 2 * w).str.ljust(2 * w, "0")
        raw = np.frombuffer(cut.str.cat().encode("latin-1", "replace"), dtype=np.uint8)
        nib = lut[raw.reshape(-1, 2 * w)]
        byte = nib[:, 0::2].astype(np.int64) * 16 + nib[:, 1::2]
        n = np.minimum(nbytes, w)
        acc = np.zeros(len(s))
        for i in range(w):  # sequential over positions, vectorised over rows
            live = i < n
            if not live.any():
                break
            if i < npos:
                v = tb[np.minimum(i * 256 + byte[:, i], len(tb) - 1)]
            else:
                v = np.full(len(s), unseen)
            acc = acc + np.where(live, v, 0.0)
        return pd.Series(acc)

    return loglik


def top_anomalous(scored: DataFrame, k: int, lik_col: str = "likelihood",
                  tie_cols: list[str] | None = None) -> DataFrame:
    """The ``k`` payloads with the lowest likelihood (top-k report)."""
    return scored.orderBy(F.col(lik_col).asc(), *(tie_cols or [])).limit(k)
