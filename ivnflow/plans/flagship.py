"""Flagship plan: packets -> flow features -> stratified split -> Min-Max.

One shuffle by flow for the features; the split needs no shuffle of the
data (histogram cut); the normalisation statistics are a one-row
aggregate joined back as a broadcast.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flows import flow_features
from ..operators.payload import benign_sample, fit_byte_model, model_vector
from ..operators.prepare import minmax_apply, minmax_fit, stratified_split
from ..schemas import FEATURE_COLS
from ..session import cut_lineage, scratch_path
from ..sources.fixtures import packets


def feature_table(pk: DataFrame, mode: str = "auto") -> DataFrame:
    # the fitted model is one bounded row; checkpoint it so every branch
    # reads it instead of refitting
    vec = cut_lineage(model_vector(fit_byte_model(benign_sample(pk))))
    return flow_features(pk, vec, mode=mode)


def normalised_split(f: DataFrame) -> DataFrame:
    sp = stratified_split(f, "pkt_no", "label")
    st = minmax_fit(sp.where(F.col("split") == "train"), FEATURE_COLS)
    return minmax_apply(sp, st, FEATURE_COLS, clip=True)


def flagship(spark: SparkSession, sf_dir: str, materialize: bool = False,
             mode: str = "auto") -> DataFrame:
    f = feature_table(packets(spark, sf_dir), mode)
    if materialize:
        # the split reads the features three times: cut lineage once
        f = cut_lineage(f)
    return normalised_split(f)


def write_feature_sets(spark: SparkSession, pk: DataFrame, out_dir: str) -> dict[str, str]:
    """Production form: raw features and the normalised train/test sets as
    parquet (overwrite, so a rerun never duplicates rows)."""
    raw = os.path.join(out_dir, "features_raw")
    feature_table(pk).write.mode("overwrite").parquet(raw)
    f = spark.read.parquet(raw)
    out = os.path.join(out_dir, "features_norm")
    normalised_split(f).write.mode("overwrite").partitionBy("split").parquet(out)
    return {"raw": raw, "normalised": out}


def capture_feature_sets(spark: SparkSession, capture_dir: str, out_dir: str,
                         flow_scope: str = "global") -> dict[str, str]:
    """Captures -> packet table -> features -> normalised split, written as
    parquet under ``out_dir``.

    ``flow_scope="global"`` keys flows by the five-tuple only (state runs on
    across captures, as in the reference); ``"capture"`` adds the file.
    """
    from ..schemas import FLOW_KEY
    from ..sinks import write_packets
    from ..sources.capture import FRAME_SCHEMA, capture_errors, capture_paths, decode_frames, read_frames

    # captures are framed once: packets and errors both read the written frames
    frames_at = scratch_path(spark, f"frames-{uuid.uuid4().hex}")
    read_frames(capture_paths(spark, capture_dir)).write.parquet(frames_at)
    frames = spark.read.schema(FRAME_SCHEMA).parquet(frames_at)
    pk_path = os.path.join(out_dir, "packets")
    write_packets(decode_frames(frames), pk_path)
    errors = os.path.join(out_dir, "capture_errors")
    capture_errors(frames).write.mode("overwrite").parquet(errors)
    pk = spark.read.parquet(pk_path).withColumnRenamed("label", "label_str")
    flow = FLOW_KEY + (["pcap_file"] if flow_scope == "capture" else [])
    vec = cut_lineage(model_vector(fit_byte_model(benign_sample(pk, order_col="order_key"))))
    ids = ["pcap_file", "pkt_no", "order_key", "timestamp"] + FLOW_KEY + \
        ["is_sd", "service_id", "method_id", "msg_type"]
    from ..operators.flows import flow_features as ff
    raw = os.path.join(out_dir, "features_raw")
    ff(pk, vec, flow_cols=flow, ts="timestamp", tie="order_key", id_cols=ids) \
        .write.mode("overwrite").parquet(raw)
    f = spark.read.parquet(raw)
    sp = stratified_split(f, "order_key", "label")
    st = minmax_fit(sp.where(F.col("split") == "train"), FEATURE_COLS)
    out = os.path.join(out_dir, "features_norm")
    minmax_apply(sp, st, FEATURE_COLS, clip=True).write.mode("overwrite").partitionBy("split").parquet(out)
    return {"packets": pk_path, "errors": errors, "raw": raw, "normalised": out}
