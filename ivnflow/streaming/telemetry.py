"""Telemetry per ECU/service: rates, totals, history, fan-out, periods, availability.

The same column logic serves batch DataFrames and streaming ones
(``window``/``session_window`` with a watermark); time is event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SERVICES, SUBSCRIPTIONS


def event_time(ts_s: str = "ts_s") -> F.Column:
    """Timestamp from epoch seconds, exact to the microsecond."""
    return F.timestamp_micros(F.round(F.col(ts_s) * 1_000_000).cast("long"))


def with_service(df: DataFrame, port_col: str = "src_port") -> DataFrame:
    """Publisher service name from its port (bounded dimension, broadcast)."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(name, port) for name, _, _, port, _, _ in SERVICES],
                                "service string, port int")
    return df.join(F.broadcast(dim), F.col(port_col) == F.col("port"), "inner").drop("port")


def rate_per_window(df: DataFrame, window: str = "1 second", key: str = "service",
                    ts: str = "ts", cap: int | None = None) -> DataFrame:
    """Events per tumbling window per key. ``cap`` reproduces a bounded
    counter (the reference dashboard saturates at 10)."""
    g = df.groupBy(key, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    n = F.least(F.col("n"), F.lit(cap)) if cap else F.col("n")
    return g.select(key, F.unix_seconds(F.col("w.start")).alias("window_start"), n.alias("n"))


def totals_and_last(df: DataFrame, key: str = "service", payload: str = "payload_hex",
                    ts: str = "ts_s", tie: str = "pkt_no") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total"),
                               F.max_by(payload, F.struct(ts, tie)).alias("last_payload"))


def rate_history(rates: DataFrame, window_seconds: int, length: int = 60,
                 key: str = "service", chunk: int = 3600) -> DataFrame:
    """For each key and window: the last ``length`` rates, zeros included.

    Windows without events are filled from a dense grid between each key's
    first and last window (its size follows the time range, not the data).
    The grid is laid out in chunks of ``chunk`` windows, each with the
    ``length - 1`` windows before it, so neither the grid nor the history of
    a key is held in one array or one task.
    """
    w_s, span = window_seconds, window_seconds * chunk
    rng = rates.groupBy(key).agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    starts = rng.withColumn("_at", F.explode(F.expr(f"sequence(lo, hi, {span}L)"))) \
        .repartition(key, "_at")
    grid = starts.select(key, "_at", F.explode(F.expr(
        f"sequence(greatest(lo, _at - {(length - 1) * w_s}L), least(hi, _at + {span - w_s}L), {w_s}L)")).alias("window_start"))
    dense = grid.join(rates, [key, "window_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(key, "_at").orderBy("window_start").rowsBetween(-(length - 1), 0)
    return (dense.withColumn("history", F.collect_list("n").over(w)).where(F.col("window_start") >= F.col("_at"))
            .select(key, "window_start", "n", "history"))


def subscription_fanout(df: DataFrame, key: str = "service") -> DataFrame:
    """Notifications delivered per subscriber ECU (broadcast join with the
    seven-row subscription table)."""
    spark = df.sparkSession
    subs = spark.createDataFrame(SUBSCRIPTIONS, "subscriber string, service string")
    return df.join(F.broadcast(subs), key).groupBy("subscriber", key).agg(F.count(F.lit(1)).alias("n"))


def period_check(df: DataFrame, key: str = "service", ts: str = "ts_s", tie: str = "pkt_no",
                 time_scale: float = 1.0) -> DataFrame:
    """Observed mean interval per service vs its nominal period.

    The gaps of a service add up to its last time less its first, so one
    partial aggregate gives their mean. ``time_scale`` maps data seconds to
    simulated seconds.
    """
    spark = df.sparkSession
    nominal = spark.createDataFrame([(n, int(ms)) for n, _, _, _, ms, _ in SERVICES],
                                    "service string, nominal_ms int")
    g = (df.groupBy(key).agg((F.count(ts) - 1).alias("n_gaps"), (F.max(ts) - F.min(ts)).alias("_span"))
         .where("n_gaps > 0").withColumn("mean_gap_s", F.col("_span") / F.col("n_gaps")).drop("_span"))
    return g.join(F.broadcast(nominal), key).withColumn(
        "ratio", F.col("mean_gap_s") * F.lit(1000.0 / time_scale) / F.col("nominal_ms"))


def availability_sessions(df: DataFrame, gap: str, key: str = "service", ts: str = "ts") -> DataFrame:
    """Intervals in which a service kept being offered: a session closes when
    no offer arrives within ``gap`` (TTL x offer cycle). The session setting
    ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` merges
    offers into sessions before the shuffle, so a hot service sends sessions,
    not offers."""
    s = df.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n_offers"))
    return s.select(key, (F.unix_micros(F.col("s.start")) / 1_000_000.0).alias("session_start"),
                    (F.unix_micros(F.col("s.end")) / 1_000_000.0).alias("session_end"), "n_offers")
