"""Numeric rules checked against small independent Python calculations."""

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from ivnflow.functions.bytes import float32_at, hamming_hex
from ivnflow.operators import evaluate as ev
from ivnflow.operators.flows import flow_features, previous_rows
from ivnflow.operators.payload import fit_byte_model, model_vector, score_payloads
from ivnflow.operators.prepare import stratified_split
from ivnflow.sources.fixtures import packets

from conftest import SF001


def py_hamming(a, b):
    try:
        x, y = bytes.fromhex(a), bytes.fromhex(b)
    except (TypeError, ValueError):
        return 0.0
    n = min(len(x), len(y))
    return float(sum(bin(x[i] ^ y[i]).count("1") for i in range(n)))


def test_hamming_cases(spark):
    cases = [("deadbeef", "deadbeef"), ("ff", "00"), ("ff00ff00aa", "0f"), ("abc", "ab"), ("zz", "00"),
             ("", "ff"), ("00" * 40, "ff" * 37), ("0123456789abcdef" * 5, "fedcba9876543210" * 4)]
    df = spark.createDataFrame(cases, "a string, b string")
    got = [r[0] for r in df.select(hamming_hex("a", "b")).collect()]
    assert got == [py_hamming(a, b) for a, b in cases]
    # symmetry and H(x, x) = 0
    sym = df.select(hamming_hex("a", "b").alias("x"), hamming_hex("b", "a").alias("y"),
                    hamming_hex("a", "a").alias("z")).collect()
    assert all(r.x == r.y and r.z == 0.0 for r in sym)


def test_likelihood_matches_python(spark):
    sample = ["0a0b0c", "0a0b", "0aff0c0d", "zz", "abc", "0a" * 40]
    rows = [(i, h) for i, h in enumerate(sample)]
    s = spark.createDataFrame(rows, "pkt_no long, payload_hex string")
    vec = model_vector(fit_byte_model(s))
    got = {r.pkt_no: (r.likelihood, r.entropy) for r in score_payloads(s, vec).collect()}
    counts = np.zeros((256, 256))
    for h in sample:
        try:
            raw = bytes.fromhex(h)
        except ValueError:
            continue
        for i, b in enumerate(raw[:256]):
            counts[i, b] += 1
    probs = (counts + 1) / (counts.sum(axis=1, keepdims=True) + 256)
    for i, h in rows:
        try:
            raw = bytes.fromhex(h)
        except ValueError:
            raw = b""
        ll = sum(math.log(probs[j, b] + 1e-12) for j, b in enumerate(raw[:256]))
        ent = -ll / len(raw) if raw else 0.0
        assert abs(got[i][0] - ll) < 1e-9 and abs(got[i][1] - ent) < 1e-9
        if raw:  # entropy * L = -likelihood
            assert abs(got[i][1] * len(raw) + got[i][0]) < 1e-9


def test_float32(spark):
    vals = [48.1, -11.5, 0.0, 1e-40, float("inf"), 3.4e38]
    hexes = [struct.pack("<f", v).hex() for v in vals]
    df = spark.createDataFrame([(h,) for h in hexes], "h string").select(float32_at(F.unhex("h"), 0).alias("v"))
    got = [r.v for r in df.collect()]
    want = [struct.unpack("<f", struct.pack("<f", v))[0] for v in vals]
    assert got == want


def test_average_precision_hand_example(spark):
    # step sum by hand: 0.8056 (Spark's areaUnderPR interpolates and differs)
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (0, 0.4)]
    df = spark.createDataFrame(rows, "y_true int, y_prob double")
    ap = ev.average_precision(df).first()[0]
    assert round(ap, 4) == round((1 / 3) * (1 + 2 / 3 + 3 / 4), 4) == 0.8056
    auc = ev.roc_auc(df).first()[0]
    assert abs(auc - 7 / 9) < 1e-12  # 7 of 9 positive/negative pairs ordered


def test_constant_classifier_and_prf(spark):
    n_attack, n = 5848823, 6944213
    p = n_attack / n
    assert (round(p, 4), 1.0, round(2 * p / (1 + p), 4)) == (0.8423, 1.0, 0.9144)
    df = spark.createDataFrame([(1, 0.9)] * 97 + [(0, 0.9)] * 3 + [(1, 0.1)] * 3, "y_true int, y_prob double")
    r = ev.prf(df, 0.5).first()
    assert round(r.precision, 2) == 0.97 and round(r.recall, 2) == 0.97
    c = ev.confusion(df, 0.5).first()
    assert c.tn + c.fp + c.fn + c.tp == 103


def test_gini_example(spark):
    # parent 0.42 with 70/30; a split into pure children gains 0.42
    rows = [(1, 1)] * 30 + [(2, 0)] * 70
    g = ev.gini_splits(spark.createDataFrame(rows, "v int, label int"), "v", "label") \
        .where("split_value = 1").first()
    assert abs(g.gain - 0.42) < 1e-12 and g.gini_weighted == 0.0


def test_threshold_grids():
    assert ev.arange(0.01, 0.99, 0.01) == list(np.arange(0.01, 0.99, 0.01))
    assert ev.arange(0.01, 0.99, 0.005) == list(np.arange(0.01, 0.99, 0.005))


def test_hot_flow_plan_equals_plain(spark):
    pk = packets(spark, SF001)
    cols = ["ts_s", "ip_len", "payload_hex"]
    a = previous_rows(pk, cols, mode="plain").select("pkt_no", *[f"prev_{c}" for c in cols])
    b = previous_rows(pk, cols, mode="chunked", chunk_seconds=3600.0) \
        .select("pkt_no", *[f"prev_{c}" for c in cols])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_split_sizes(spark):
    pk = packets(spark, SF001).withColumn("label", (F.col("label_str") != "normal").cast("int"))
    s = stratified_split(pk, "pkt_no", "label").groupBy("label", "split").count().collect()
    by = {(r.label, r.split): r["count"] for r in s}
    for lab in (0, 1):
        tr, te = by.get((lab, "train"), 0), by.get((lab, "test"), 0)
        assert abs(tr - te) <= 1


def test_features_invariants(spark):
    pk = packets(spark, SF001)
    from ivnflow.plans.flagship import feature_table
    f = feature_table(pk)
    r = f.agg(F.max("f02_someip_likelihood"), F.min("f04_someip_entropy"),
              F.min("f06_someip_payload_changes"), F.max("f06_someip_payload_changes"),
              F.min("f01_ip_time_interval")).first()
    assert r[0] <= 0 and r[1] >= 0 and r[2] >= 0 and r[3] <= 256 and r[4] >= 0


def test_stream_equals_batch(spark):
    from ivnflow.plans.q_stream import stream_features
    from ivnflow.plans.q_features import features
    s = stream_features(spark, SF001).select("pkt_no", "f01_ip_time_interval", "f06_someip_payload_changes",
                                             "f08_ip_length_changes")
    b = features(spark, SF001).select("pkt_no", "f01_ip_time_interval", "f06_someip_payload_changes",
                                      "f08_ip_length_changes")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_scoring_engines_agree(spark):
    from ivnflow.sources.fixtures import payloads
    p = payloads(spark, SF001)
    vec = model_vector(fit_byte_model(p.where("label_str = 'normal'")))
    a = score_payloads(p, vec, engine="arrow").select("pkt_no", "likelihood", "entropy").collect()
    b = {r.pkt_no: r for r in score_payloads(p, vec, engine="sql").collect()}
    assert len(a) == len(b)
    for r in a:
        assert abs(r.likelihood - b[r.pkt_no].likelihood) < 1e-9
        assert abs(r.entropy - b[r.pkt_no].entropy) < 1e-9


def test_replicate_large_factor(spark):
    from ivnflow.operators.prepare import replicate
    df = spark.createDataFrame([(1,), (2,)], "id long")
    r = replicate(df, 3000, chunk=256)
    assert r.count() == 6000
    g = r.groupBy("id").agg(F.min("copy_no"), F.max("copy_no"), F.countDistinct("copy_no")).collect()
    assert sorted(tuple(x) for x in g) == [(1, 1, 3000, 3000), (2, 1, 3000, 3000)]


def test_hot_flow_adaptive_chunks(spark):
    pk = packets(spark, SF001)
    cols = ["ts_s", "payload_hex"]
    a = previous_rows(pk, cols, mode="plain").select("pkt_no", *[f"prev_{c}" for c in cols])
    # a tiny hot threshold forces the chunked plan with widths sized from the data
    b = previous_rows(pk, cols, mode="auto", chunk_seconds=5.0).select("pkt_no", *[f"prev_{c}" for c in cols])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_benign_sample_of_repeated_keys(spark):
    from ivnflow.operators.payload import benign_sample
    rows = [(k // 3, "normal" if k % 5 else "dos", f"{k:04x}") for k in range(900)] + [(2, "normal", None), (None, "normal", "ff")]
    pk = spark.createDataFrame(rows, "pkt_no long, label_str string, payload_hex string")
    benign = sorted((n, h) for n, label, h in rows if label == "normal" and h is not None and n is not None)
    for n in (0, 1, 7, 200, 719, 720):
        for width in (4, 64, 1 << 16):
            got = sorted(map(tuple, benign_sample(pk, sample_size=n, bucket_width=width).collect()))
            assert got == benign[:n], (n, width)
    assert benign_sample(pk, sample_size=721).count() == 721  # fewer keys than asked: all payloads


def test_benign_sample_cut(spark):
    from ivnflow.operators.payload import benign_sample
    pk = packets(spark, SF001)
    ben = pk.where((F.lower("label_str") == "normal") & F.col("payload_hex").isNotNull())
    for n in (1, 37, 100):
        got = sorted(r.pkt_no for r in benign_sample(pk, sample_size=n, bucket_width=16).collect())
        want = [r.pkt_no for r in ben.orderBy("pkt_no").limit(n).collect()]
        assert got == want
    allrows = benign_sample(pk, sample_size=10 ** 6).count()
    assert allrows == ben.count()


def test_feature_plan_has_one_shuffle(spark):
    from ivnflow.operators.payload import benign_sample
    from ivnflow.session import cut_lineage
    pk = packets(spark, SF001)
    vec = cut_lineage(model_vector(fit_byte_model(benign_sample(pk))))
    f = flow_features(pk, vec, mode="plain")
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        f.explain()
    plan = buf.getvalue()
    exchanges = [ln for ln in plan.splitlines() if "Exchange" in ln and "hashpartitioning" in ln
                 or "Exchange rangepartitioning" in ln or "Exchange SinglePartition" in ln]
    assert len(exchanges) == 1 and "hashpartitioning(src_ip" in exchanges[0]
    assert "NestedLoopJoin" not in plan


def test_hamming_of_long_payloads_takes_linear_time(spark):
    """A 1 MB payload took a walk from its begin for each of 250,000 words."""
    import random
    import time
    r = random.Random(5)
    sizes = [(33, 33), (40, 33), (500_000, 500_000), (70_001, 70_000), (39, 1)]
    rows = [(r.randbytes(m), r.randbytes(n)) for m, n in sizes]
    want = [float(sum((x ^ y).bit_count() for x, y in zip(a, b))) for a, b in rows]
    df = spark.createDataFrame([(k, a.hex(), b.hex().upper()) for k, (a, b) in enumerate(rows)] + [(9, "ab" * 50 + "g0", "00" * 60)],
                               "k int, a string, b string")
    t0 = time.time()
    got = [x[1] for x in df.select("k", hamming_hex("a", "b")).orderBy("k").collect()]
    assert got == want + [0.0] and time.time() - t0 < 20


def test_workers_get_no_more_of_a_payload_than_is_scored(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ivnflow.operators import payload as pl
    df = spark.createDataFrame([(1, "ab" * 50_000, "normal"), (2, "abcd", "normal"), (3, None, "dos")], "pkt_no long, payload_hex string, label_str string")
    vec = pl.model_vector(pl.fit_byte_model(pl.benign_sample(df)))
    scores = [{r["pkt_no"]: r["likelihood"] for r in pl.score_payloads(df, vec, engine=e).collect()} for e in ("arrow", "sql")]
    assert all(abs(scores[0][k] - scores[1][k]) < 1e-9 for k in (1, 2, 3)) and scores[0][1] < -100 and scores[0][3] == 0.0
    monkeypatch.setattr(pl, "_arrow_loglik", lambda *a: lambda h: F.length(h).cast("double"))
    assert {r["pkt_no"]: r["likelihood"] for r in pl.score_payloads(df, vec).collect()} == {1: 512.0, 2: 4.0, 3: 0.0}
