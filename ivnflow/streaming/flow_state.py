"""Structured Streaming forms of the flow features and telemetry.

Flow deltas need the previous packet of each five-tuple across micro-
batches: ``applyInPandasWithState`` keeps (ts, ip_len, transport_len,
payload) per flow, sorts each batch's rows of the flow by (ts, pkt_no) and
emits the previous values; payload scores and Hamming distance then run
as native expressions on the output. State is checkpointed with the query
(``checkpointLocation`` under the shared checkpoint folder), so a lost
executor replays from the last committed batch.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import FLOW_KEY
from ..session import scratch_path, ship_package
from ..sinks import emit_live

PREV_SCHEMA = ("pkt_no long, ts_s double, ip_len int, transport_len int, payload_hex string, "
               "label_str string, prev_ts_s double, prev_ip_len int, prev_transport_len int, "
               "prev_payload_hex string, late boolean")
STATE_SCHEMA = "ts_s double, ip_len int, transport_len int, payload_hex string, has_prev boolean"


def _carry_previous(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Previous values per flow across micro-batches.

    Late rows (older than the flow's state, i.e. from an earlier point in
    event time but a later batch) are kept apart and flagged ``late`` for a
    side output: each takes the state as its predecessor, none is the
    predecessor of an on-time row, and none moves the state backwards.
    """
    every = pd.concat(list(pdfs), ignore_index=True)
    every = every.sort_values(["ts_s", "pkt_no"], kind="mergesort").reset_index(drop=True)
    first = tuple(state.get)[:4] if state.exists else (None, None, None, None)
    late = every["ts_s"] < first[0] if first[0] is not None else pd.Series(False, index=every.index)
    kinds = {"ts_s": "float64", "ip_len": "Int64", "transport_len": "Int64", "payload_hex": "object"}

    def with_previous(rows: pd.DataFrame, chained: bool, flag: bool) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        out = rows[["pkt_no", "ts_s", "ip_len", "transport_len", "payload_hex", "label_str"]].copy()
        for value, (c, kind) in zip(first, kinds.items()):
            own = rows[c].astype(kind)
            out["prev_" + c] = (pd.concat([pd.Series([value], dtype=kind), own.iloc[:-1]], ignore_index=True)
                                if chained else pd.Series([value] * len(rows), dtype=kind))
        out["late"] = flag
        return out

    if late.any():
        yield with_previous(every[late], False, True)
    pdf = every[~late]
    if pdf.empty:
        return
    out = with_previous(pdf, True, False)
    last = pdf.iloc[-1]
    if first[0] is None or float(last["ts_s"]) >= first[0]:
        pl = last["payload_hex"]
        state.update((float(last["ts_s"]), int(last["ip_len"]), int(last["transport_len"]),
                      None if pd.isna(pl) else str(pl), True))
    yield out


def stateful_previous(stream: DataFrame, flow_cols: list[str] = FLOW_KEY) -> DataFrame:
    """Per-flow previous values carried across micro-batches.

    State is one small row per five-tuple, so it is bounded by the number
    of distinct flows, not by the stream length.
    """
    ship_package(stream.sparkSession)
    cols = flow_cols + ["pkt_no", "ts_s", "ip_len", "transport_len", "payload_hex", "label_str"]
    return stream.select(*cols).groupBy(*flow_cols).applyInPandasWithState(
        _carry_previous, PREV_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def stream_source(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1) -> DataFrame:
    """File stream over one driver table (schema taken from the batch table)."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append", fmt: str = "parquet",
                 foreach_batch=None) -> str:
    """Run a streaming DataFrame until its input is drained; results are
    written as a table under the shared checkpoint folder. Returns its path."""
    spark = df.sparkSession
    run = uuid.uuid4().hex[:12]
    out = scratch_path(spark, f"{name}-{run}")
    ck = scratch_path(spark, f"{name}-{run}-checkpoint")
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", ck)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda b, i: foreach_batch(b, i, out)).start()
    else:
        q = w.format(fmt).option("path", out).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def time_slices(df: DataFrame, order_col: str = "ts_s", n: int = 4) -> list[DataFrame]:
    """``df`` as up to ``n`` consecutive slices of near-equal size by ``order_col``
    (nulls in the first), each a filter that reaches the scan."""
    cuts = df.agg(F.percentile_approx(order_col, [k / n for k in range(1, n)], 10_000)).first()[0]
    edges = sorted(set(cuts or []))
    c = F.col(order_col)
    out = []
    for lo, hi in zip([None, *edges], [*edges, None]):
        part = df if hi is None else df.where((c < hi) | c.isNull())
        out.append(part if lo is None else part.where(c >= lo))
    return out


def run_slices(slices: list[DataFrame], build, name: str, output_mode: str = "append", emit=emit_live) -> str:
    """Feed ``slices`` one after the other to the stream ``build(source)``, one
    micro-batch each, and write every batch with ``emit``. The query is stopped
    and restarted from its checkpoint between slices, so state, watermark and
    offsets cross both batches and restarts. Returns the path of the output."""
    spark = slices[0].sparkSession
    run = uuid.uuid4().hex[:12]
    source, out, ck = (scratch_path(spark, f"{name}-{run}{k}") for k in ("-source", "", "-checkpoint"))
    for s in slices:
        s.write.mode("append").parquet(source)
        stream = spark.readStream.schema(slices[0].schema).parquet(source)
        (build(stream).writeStream.outputMode(output_mode).option("checkpointLocation", ck)
         .trigger(availableNow=True).foreachBatch(lambda b, i: emit(b, i, out)).start().awaitTermination())
    return out


def complete_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Complete-mode sink: the latest full result replaces the table."""
    batch.write.mode("overwrite").parquet(out)


def ingest_capture_stream(spark: SparkSession, directory: str, name: str = "captures",
                          glob: str = "*.pcap") -> str:
    """Rotated captures arriving in ``directory`` -> packet table.

    Each micro-batch frames and decodes its new files and writes them
    under its own batch folder (overwrite), so a replayed batch after a
    failure rewrites the same rows instead of duplicating them. Returns the
    table path.
    """
    from ..sources.capture import decode_frames, read_frames, stream_captures

    def ingest(batch: DataFrame, batch_id: int, out: str) -> None:
        pk = decode_frames(read_frames(batch.select("path")))
        pk.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    return run_to_table(stream_captures(spark, directory, glob), name, "append", foreach_batch=ingest)
