"""Live telemetry as streams: rate history per service and closed sessions.

The history is a chain of two streaming jobs. The first closes event-time
windows under a watermark and appends each window's rate once. The second
keeps, per service, the last rates and the last window in state
(``applyInPandasWithState``): windows without events are filled with zeros, and
each window is emitted with the ``length`` rates up to it. State is ``length``
numbers per service, whatever the stream; a service that falls silent gets its
empty windows when it is heard again.

Sessions are Spark's ``session_window`` in append mode: a session is emitted once
no offer can extend it any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package
from .telemetry import event_time, with_service

HISTORY_SCHEMA = "service string, window_start long, n long, history array<long>"
_STATE = "last long, history array<long>"


def closed_rates(packets: DataFrame, window: str, watermark: str) -> DataFrame:
    """service, window_start, n of every window that the watermark has closed."""
    s = with_service(packets).withColumn("ts", event_time())
    agg = s.withWatermark("ts", watermark).groupBy("service", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select("service", F.unix_seconds(F.col("w.start")).alias("window_start"), "n")


def advanced(last: int | None, history: list[int], rates: dict[int, int], until: int, step: int, length: int):
    """Rows (window_start, n, history) of the windows after ``last`` up to ``until``, and the new history."""
    out = []
    at = min(rates) if last is None else last + step
    while at <= until:
        n = rates.get(at, 0)
        history = (history + [n])[-length:]
        out.append((at, n, list(history)))
        at += step
    return out, history


def _history(step: int, length: int):
    def carry(key, batches, state: GroupState):
        import pandas as pd

        last, history = state.get if state.exists else (None, [])
        history = [int(x) for x in history]
        rates: dict[int, int] = {}
        for b in batches:
            rates.update(zip(b["window_start"].astype(int), b["n"].astype(int)))
        # windows at or before the last one were emitted with their batch already
        rates = {int(w): int(n) for w, n in rates.items() if last is None or w > last}
        if not rates:
            return
        until = max(rates)
        rows, history = advanced(last, history, rates, until, step, length)
        state.update((until, history))
        yield pd.DataFrame({"service": key[0], "window_start": [r[0] for r in rows], "n": [r[1] for r in rows],
                            "history": [r[2] for r in rows]})

    return carry


def rate_histories(rates: DataFrame, window_seconds: int, length: int = 60) -> DataFrame:
    """service, window_start, n, history for a stream of ``closed_rates`` rows: zeros
    between a service's windows included, in state of ``length`` numbers per service."""
    ship_package(rates.sparkSession)
    return rates.select("service", "window_start", "n").groupBy("service").applyInPandasWithState(
        _history(window_seconds, length), HISTORY_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def closed_sessions(packets: DataFrame, gap: str, watermark: str) -> DataFrame:
    """service, session_start, session_end, n_offers of every session that no offer can
    extend any more: its end lies behind the watermark."""
    s = with_service(packets).withColumn("ts", event_time()).where("is_sd")
    agg = s.withWatermark("ts", watermark).groupBy("service", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n_offers"))
    return agg.select("service", (F.unix_micros(F.col("s.start")) / 1_000_000.0).alias("session_start"),
                      (F.unix_micros(F.col("s.end")) / 1_000_000.0).alias("session_end"), "n_offers")
