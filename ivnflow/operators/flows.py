"""Per-flow behavioural features (time gap, length changes, payload change).

All flow features need only the previous packet of the same flow in
``(ts, pkt_no)`` order. Two exact plans compute that previous row:

* ``plain``: ``lag`` over a window partitioned by the five-tuple (one
  shuffle by flow); for comparison in tests.
* ``chunked`` (the default at every size): a flood can put a third of all rows into one five-tuple,
  and a window partition is never split by AQE. Rows are windowed per
  (flow, time chunk) instead; the first row of each chunk takes its
  predecessor from the previous non-empty chunk of the flow, found from a
  per-chunk tail table (one row per chunk, much smaller than the data).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FEATURE_COLS, FLOW_KEY
from ..functions.bytes import hamming_hex
from .payload import score_payloads

#: Width of the time chunks a flow is cut into; any width gives the same result.
CHUNK_SECONDS = 60.0


def previous_rows(df: DataFrame, cols: list[str], flow_cols: list[str] = FLOW_KEY,
                  ts: str = "ts_s", tie: str = "pkt_no", mode: str = "chunked",
                  chunk_seconds: float | None = None,
                  prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` for each of ``cols``: the value on the previous
    packet of the same flow (null on a flow's first packet).

    One plan at every size: rows are windowed per (flow, time chunk) and a
    table of one row per flow and chunk carries the last row before each
    chunk, so a flow with a third of all rows is many small groups. Null
    keys are one flow, as in a window. ``plain`` is a single window by flow,
    for comparison.
    """
    if mode == "auto":
        mode = "chunked"
    if chunk_seconds is None:
        chunk_seconds = CHUNK_SECONDS
    prev = F.struct(*[F.col(c) for c in cols])
    if mode == "plain":
        w = Window.partitionBy(*flow_cols).orderBy(ts, tie)
        out = df.withColumn("_prev", F.lag(prev).over(w))
    elif mode == "chunked":
        d = df.withColumn("_chunk", F.floor(F.col(ts) / F.lit(chunk_seconds)))
        wc = Window.partitionBy(*flow_cols, "_chunk").orderBy(ts, tie)
        d = (d.withColumn("_lagc", F.lag(prev).over(wc))
             .withColumn("_first", F.row_number().over(wc) == 1))
        tails = df.withColumn("_chunk", F.floor(F.col(ts) / F.lit(chunk_seconds))) \
            .groupBy(*flow_cols, "_chunk") \
            .agg(F.max_by(prev, F.struct(F.col(ts), F.col(tie))).alias("_last"))
        wt = Window.partitionBy(*flow_cols).orderBy("_chunk")
        carry = tails.select(*flow_cols, "_chunk", F.lag("_last").over(wt).alias("_carry"))
        keys = flow_cols + ["_chunk"]
        carry = carry.select(*[F.col(k).alias("_of_" + k) for k in keys], "_carry")
        same = [F.col(k).eqNullSafe(F.col("_of_" + k)) for k in keys]
        out = (d.join(carry, functools.reduce(lambda a, b: a & b, same), "left")
               .drop(*["_of_" + k for k in keys])
               .withColumn("_prev", F.when(F.col("_first"), F.col("_carry"))
                           .otherwise(F.col("_lagc")))
               .drop("_chunk", "_lagc", "_first", "_carry"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    for c in cols:
        out = out.withColumn(prefix + c, F.col("_prev")[c])
    return out.drop("_prev")


def delta(cur: str, prev: str):
    """Difference to the previous value; 0.0 when either side is missing."""
    return F.coalesce(F.col(cur).cast("double") - F.col(prev).cast("double"), F.lit(0.0))


def binary_label(label_col: str = "label_str"):
    """0 iff the class name is 'normal' (any case), else 1."""
    return F.when(F.lower(F.col(label_col)) == "normal", F.lit(0)).otherwise(F.lit(1))


def flow_features(pk: DataFrame, model_vec: DataFrame, flow_cols: list[str] = FLOW_KEY,
                  ts: str = "ts_s", tie: str = "pkt_no", hex_col: str = "payload_hex",
                  label_col: str = "label_str", id_cols: list[str] | None = None,
                  mode: str = "auto", chunk_seconds: float | None = None,
                  tcpudp_vec: DataFrame | None = None) -> DataFrame:
    """The nine features per packet plus id columns, ``label_str`` and ``label``.

    Compatibility: both likelihood/entropy pairs use the same benign model
    unless ``tcpudp_vec`` is given, and f07 equals f06.
    """
    ids = id_cols if id_cols is not None else [
        c for c in [tie, ts] + flow_cols + ["is_sd", "service_id", "method_id", "msg_type"]
        if c in pk.columns]
    p = previous_rows(pk, [ts, "ip_len", "transport_len", hex_col], flow_cols, ts, tie,
                      mode, chunk_seconds)
    return feature_columns(p, model_vec, ids, ts, hex_col, label_col, tcpudp_vec)


def payload_change(hex_col: str = "payload_hex"):
    """Bits that differ from the previous payload; 0.0 when either is missing."""
    return F.when(F.col("prev_" + hex_col).isNull() | F.col(hex_col).isNull(), F.lit(0.0)) \
        .otherwise(hamming_hex("prev_" + hex_col, hex_col))


def feature_columns(p: DataFrame, model_vec: DataFrame, ids: list[str], ts: str = "ts_s",
                    hex_col: str = "payload_hex", label_col: str = "label_str",
                    tcpudp_vec: DataFrame | None = None) -> DataFrame:
    """The nine features of rows that carry their ``prev_`` values, batch or stream."""
    s = score_payloads(p, model_vec, hex_col, "_lik", "_ent")
    if tcpudp_vec is not None:
        s = score_payloads(s, tcpudp_vec, hex_col, "_lik2", "_ent2")
        lik2, ent2 = F.col("_lik2"), F.col("_ent2")
    else:
        lik2, ent2 = F.col("_lik"), F.col("_ent")
    f06 = payload_change(hex_col)
    feats = [
        delta(ts, "prev_" + ts),
        F.col("_lik"), lik2, F.col("_ent"), ent2,
        f06, f06,
        delta("ip_len", "prev_ip_len"),
        delta("transport_len", "prev_transport_len"),
    ]
    return s.select(*ids, *[f.alias(n) for f, n in zip(feats, FEATURE_COLS)],
                    F.col(label_col).alias("label_str"), binary_label(label_col).alias("label"))


def layered_features(pk: DataFrame, someip_vec: DataFrame, sd_vec: DataFrame,
                     tcpudp_vec: DataFrame, flow_cols: list[str] = FLOW_KEY,
                     ts: str = "ts_s", tie: str = "pkt_no", hex_col: str = "payload_hex",
                     tcpudp_hex_col: str | None = None, sd_col: str = "is_sd",
                     label_col: str = "label_str", mode: str = "auto",
                     chunk_seconds: float | None = None) -> DataFrame:
    """Twelve features with separate byte models per layer.

    SOME/IP and SOME/IP-SD packets are scored only by their own layer's
    model, and payload change is measured against the previous packet of
    the same flow and layer; the transport layer is scored on every packet.
    """
    from ..schemas import LAYERED_FEATURE_COLS
    thex = tcpudp_hex_col or hex_col
    d = pk.withColumn("_layer", F.when(F.col(sd_col), F.lit("sd")).otherwise(F.lit("someip")))
    cols = [ts, "ip_len", "transport_len"] + ([thex] if thex != hex_col else [hex_col])
    d = previous_rows(d, cols, flow_cols, ts, tie, mode, chunk_seconds)
    d = previous_rows(d, [hex_col], flow_cols + ["_layer"], ts, tie, mode, chunk_seconds,
                      prefix="lprev_")
    d = score_payloads(d, someip_vec, hex_col, "_l_someip", "_e_someip")
    d = score_payloads(d, sd_vec, hex_col, "_l_sd", "_e_sd")
    d = score_payloads(d, tcpudp_vec, thex, "_l_tcpudp", "_e_tcpudp")
    is_sd = F.col("_layer") == "sd"

    def chg(prev, cur):
        return F.when(F.col(prev).isNull() | F.col(cur).isNull(), F.lit(0.0)) \
            .otherwise(hamming_hex(prev, cur))

    zero = F.lit(0.0)
    layer_chg = chg("lprev_" + hex_col, hex_col)
    feats = [
        F.when(~is_sd, F.col("_l_someip")).otherwise(zero),
        F.when(~is_sd, F.col("_e_someip")).otherwise(zero),
        F.when(is_sd, F.col("_l_sd")).otherwise(zero),
        F.col("_l_tcpudp"),
        F.when(is_sd, F.col("_e_sd")).otherwise(zero),
        F.col("_e_tcpudp"),
        F.when(~is_sd, layer_chg).otherwise(zero),
        F.when(is_sd, layer_chg).otherwise(zero),
        chg("prev_" + thex, thex),
        delta(ts, "prev_" + ts),
        delta("ip_len", "prev_ip_len"),
        delta("transport_len", "prev_transport_len"),
    ]
    ids = [c for c in [tie, ts] + flow_cols + [sd_col] if c in pk.columns]
    return d.select(*ids, *[f.alias(n) for f, n in zip(feats, LAYERED_FEATURE_COLS)],
                    F.col(label_col).alias("label_str"), binary_label(label_col).alias("label"))
