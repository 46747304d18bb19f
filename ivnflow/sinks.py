"""Sinks (K1-K7). Every writer overwrites, so a rerun never duplicates rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boosting
from .schemas import PACKET_CSV_COLUMNS


def write_packets(pk: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Packet table (K1): parquet partitioned by capture file, or CSV with a
    header in the fixed column order."""
    if fmt == "csv":
        cols = [c for c in PACKET_CSV_COLUMNS if c in pk.columns]
        pk.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    else:
        pk.write.mode("overwrite").partitionBy("pcap_file").parquet(path)


def write_feature_sets(norm: DataFrame, path: str) -> None:
    """Train and test feature sets (K2) in one table partitioned by split."""
    norm.write.mode("overwrite").partitionBy("split").parquet(path)


def write_metrics(scenarios: DataFrame, path: str, **extra) -> None:
    """Metrics record (K3): one JSON document with one nested struct per scenario."""
    row = scenarios.agg(F.map_from_entries(F.collect_list(F.struct(
        "scenario", F.struct(*[c for c in scenarios.columns if c != "scenario"])))).alias("scenarios"))
    for k, v in extra.items():
        row = row.withColumn(k, F.lit(v))
    row.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """Fitted model (K4): a Spark ML one, or a tree model as its node table."""
    if isinstance(model, boosting.TreeModel):
        boosting.save(model, SparkSession.getActiveSession(), path)
        return
    model.write().overwrite().save(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    """Small report tables (K5 baselines, K6 balanced export) as CSV with a header.

    The baseline table has one row per model; the balanced export is
    written by all tasks in parallel (no single-file funnel).
    """
    df.write.mode("overwrite").option("header", True).csv(path)


def emit_live(batch: DataFrame, batch_id: int, path: str) -> None:
    """Live metrics emit (K7): each micro-batch's per-ECU rows, idempotent per batch id."""
    batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))
