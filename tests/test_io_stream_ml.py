"""Sinks, stream sources, service payload decode and ML helpers."""

import json
import os
import struct

from pyspark.ml.classification import DecisionTreeClassifier, DecisionTreeClassificationModel

from ivnflow import sinks
from ivnflow.functions.someip import decode_service_payload
from ivnflow.operators import models as md
from ivnflow.operators.prepare import available_columns
from ivnflow.plans import QUERIES
from ivnflow.schemas import PACKET_CSV_COLUMNS
from ivnflow.sources.fixtures import VECTOR_COLS, packets, vectors
from ivnflow.streaming import flow_state as fs

from conftest import SF001


def test_packet_and_metric_sinks(spark, tmp_path):
    pk = packets(spark, SF001).withColumnRenamed("ts_s", "timestamp").withColumnRenamed("label_str", "label")
    sinks.write_packets(pk, str(tmp_path / "pk"))
    sinks.write_packets(pk, str(tmp_path / "pk"))  # rerun overwrites
    assert spark.read.parquet(str(tmp_path / "pk")).count() == pk.count()
    assert any(p.startswith("pcap_file=") for p in os.listdir(tmp_path / "pk"))
    sinks.write_packets(pk, str(tmp_path / "csv"), fmt="csv")
    head = spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    assert head == [c for c in PACKET_CSV_COLUMNS if c in pk.columns]
    sc = QUERIES["q_scenarios"](spark, SF001)
    sinks.write_metrics(sc, str(tmp_path / "m"), threshold_source="paper")
    doc = [json.loads(line) for f in os.listdir(tmp_path / "m") if f.endswith(".json")
           for line in open(tmp_path / "m" / f)]
    assert len(doc) == 1 and set(doc[0]["scenarios"]) == {"imbalanced", "balanced"}


def test_model_save_and_tables(spark, tmp_path):
    v = md.assemble(vectors(spark, SF001), VECTOR_COLS)
    m = DecisionTreeClassifier(featuresCol="features", labelCol="y_true", maxDepth=3).fit(v)
    sinks.save_model(m, str(tmp_path / "dt"))
    m2 = DecisionTreeClassificationModel.load(str(tmp_path / "dt"))
    a = m.transform(v).select("prediction").collect()
    assert a == m2.transform(v).select("prediction").collect()
    t = spark.createDataFrame([("DT", 0.8, 0.9, 0.85, 0.8)], "model string, precision double, recall double, "
                              "f1 double, pr_auc double")
    sinks.write_table_csv(t, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).count() == 1


def test_service_payload_decode(spark):
    imu = struct.pack("<6f", 0.5, -1.25, 9.75, 0.0, 2.5, -3.0)
    vde = struct.pack("<4f", 88.5, -12.0, 40.25, 0.0)
    df = spark.createDataFrame([(0x1235, bytearray(imu)), (0x1236, bytearray(vde)), (0x1236, bytearray(vde[:8])),
                                (0x1234, bytearray(imu[:8]))], "s int, p binary")
    got = [r[0] for r in df.select(decode_service_payload("s", "p")).collect()]
    assert got[0] == list(struct.unpack("<6f", imu)) and got[1] == list(struct.unpack("<4f", vde))
    assert got[2] is None and got[3] == list(struct.unpack("<2f", imu[:8]))


def test_column_fallback_and_stack(spark):
    v = vectors(spark, SF001)
    assert available_columns(v, ["x01_norm"], ["x01"]) == ["x01"]
    a = md.assemble(v, VECTOR_COLS).select("features").first()[0]
    assert len(a) == len(VECTOR_COLS)


def test_log_stream(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "ecu-gps.log").write_text("[GPS] lat=48.1 lon=11.5\nstarting\n")
    (d / "ecu-tel.log").write_text("[TEL] GPS  lat=48.1  lon=11.5\n[TEL] idle\n")
    from ivnflow.sources.logs import log_stream, parse_logs
    out = fs.run_to_table(parse_logs(log_stream(spark, str(d))).drop("ts"), "logs", "append")
    rows = sorted((r.container, r.last_payload) for r in spark.read.parquet(out).collect())
    assert rows == [("ecu-gps", "lat=48.1 lon=11.5"), ("ecu-tel", "GPS  lat=48.1  lon=11.5")]


def test_capture_stream(spark, tmp_path):
    from test_capture import frame, someip, udp, write_pcap
    d = tmp_path / "rot"
    d.mkdir()
    write_pcap(d / "benign_traffic.pcap", [frame(udp(30501, 30490, someip(0x1234, 0x8001, 2)))] * 3)
    write_pcap(d / "dos_noti_flood.pcap", [frame(udp(30501, 30490, someip(0x1234, 0x8001, 2)))] * 2)

    out = fs.ingest_capture_stream(spark, str(d))
    got = spark.read.parquet(out).groupBy("pcap_file").count().collect()
    assert {r.pcap_file: r["count"] for r in got} == {"benign_traffic.pcap": 3, "dos_noti_flood.pcap": 2}


def test_early_stopping_learning_curve_grid(spark):
    v = vectors(spark, SF001)
    assert md.fit_trees(v, VECTOR_COLS[:6], "vec_id", "y_true", rounds=12, depth=2).num_trees == 12  # every round asked for
    m, losses = md.fit_with_patience(v, VECTOR_COLS[:6], "vec_id", "y_true", patience=3, rounds=60, depth=4, eta=1.0)
    assert len(losses) < 60 and m.num_trees == losses.index(min(losses)) + 1 == len(losses) - 3
    tr_, te_ = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    lc = md.learning_curve(tr_, te_, VECTOR_COLS, "vec_id", "y_true", fractions=[0.3, 0.6, 1.0]).collect()
    assert [r.fraction for r in lc] == [0.3, 0.6, 1.0] and lc[0].n_train <= lc[-1].n_train
    cv = md.grid_search(v, VECTOR_COLS, "y_true", folds=2, grid={"maxDepth": [2, 3], "maxIter": [3]})
    assert len(cv.avgMetrics) == 2


def test_stream_late_rows(spark, tmp_path):
    import time as _t
    d = tmp_path / "pk"
    d.mkdir()
    cols = "src_ip string, dst_ip string, src_port int, dst_port int, transport string, pkt_no long, " \
           "ts_s double, ip_len int, transport_len int, payload_hex string, label_str string"
    flow = ("a", "b", 30501, 30490, "UDP")
    first = [flow + (i, 10.0 + i, 60, 40, "ab", "normal") for i in range(3)]
    late = [flow + (10 + i, 5.0 + i, 60, 40, "cd", "normal") for i in range(2)]
    spark.createDataFrame(first, cols).coalesce(1).write.parquet(str(d / "b1"))
    _t.sleep(1.1)
    spark.createDataFrame(late, cols).coalesce(1).write.parquet(str(d / "b2"))
    schema = spark.createDataFrame(first, cols).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True) \
        .parquet(str(d))
    out = fs.run_to_table(fs.stateful_previous(src), "late", "append")
    rows = {r.pkt_no: r for r in spark.read.parquet(out).collect()}
    assert not any(rows[i].late for i in range(3))
    assert rows[10].late and rows[11].late and rows[10].prev_ts_s == 12.0


def test_train_and_evaluate(spark, tmp_path):
    from ivnflow.plans.flagship import flagship
    from ivnflow.plans.training import train_and_evaluate
    feats = flagship(spark, SF001, materialize=True)
    out = train_and_evaluate(spark, feats, str(tmp_path / "run"), gbt_overrides={"rounds": 20})
    assert 0.0 < out["threshold"] < 1.0
    assert set(out["scenarios"]) == {"imbalanced", "balanced"}
    for m in out["scenarios"].values():
        assert all(0.0 <= m[k] <= 1.0 for k in ("precision", "recall", "f1", "pr_auc", "roc_auc"))
    doc = [json.loads(line) for f in os.listdir(tmp_path / "run" / "metrics") if f.endswith(".json")
           for line in open(tmp_path / "run" / "metrics" / f)]
    assert doc[0]["threshold"] == out["threshold"] and "balanced" in doc[0]["scenarios"]
    assert doc[0]["n_trees"] == 20
    grown = train_and_evaluate(spark, feats, str(tmp_path / "run2"), gbt_overrides={"rounds": 3},
                               augment=2.0, class_weight=True)
    assert 0.0 < grown["threshold"] < 1.0


def test_augment_positive_counts(spark):
    from ivnflow.operators.prepare import augment_positive
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(13)], "pkt_no long, label int")
    got = {r["label"]: r["count"] for r in augment_positive(df, 2.0).groupBy("label").count().collect()}
    assert got == {0: 10, 1: 20}
    assert augment_positive(df, 0.1).count() == 13 and augment_positive(df.where("label = 0")).count() == 10


def test_online_alerts_equal_batch_scoring(spark):
    from ivnflow.operators.flows import flow_features
    from ivnflow.plans import q_stream as qs
    from ivnflow.plans.q_features import fitted_vector
    pk = qs.packets(spark, SF001)
    slices = fs.time_slices(pk)
    assert len(slices) == 4 and sum(s.count() for s in slices) == pk.count()
    got = spark.read.parquet(qs.online_alerts(spark, slices[0], slices, 0.0))
    assert got.select("batch").distinct().count() == 4
    train = flow_features(slices[0], fitted_vector(slices[0]))
    stats = qs.minmax_fit(train, qs.FEATURE_COLS)
    rows = qs.md.assemble(qs.minmax_apply(train, stats, qs.FEATURE_COLS), qs.NORM_COLS)
    model = qs.md.logistic(rows.count(), "label").fit(rows)
    every = flow_features(pk, fitted_vector(slices[0]))
    want = qs.md.score(model, qs.md.assemble(qs.minmax_apply(every, stats, qs.FEATURE_COLS), qs.NORM_COLS), "pkt_no", "label")
    a = {r["pkt_no"]: r["y_prob"] for r in got.collect()}
    b = {r["pkt_no"]: r["y_prob"] for r in want.collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_log_totals_stream(spark, tmp_path):
    from ivnflow.sources.logs import log_stream, log_totals, parse_logs
    d = tmp_path / "logs2"
    d.mkdir()
    (d / "ecu-imu.log").write_text("[IMU] accel=(1,2,3)\n[IMU] accel=(4,5,6)\nboot\n")
    (d / "ecu-nav.log").write_text("[NAV] GPS  lat=1  lon=2\n")
    out = fs.run_to_table(log_totals(parse_logs(log_stream(spark, str(d)))), "log_totals", "complete",
                          foreach_batch=fs.complete_batch)
    rows = {r.container: r.total for r in spark.read.parquet(out).collect()}
    assert rows == {"ecu-imu": 2, "ecu-nav": 1}
