"""Queries: byte model, payload scores and flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bytes import bytes_to_hex, hamming_hex, hex_to_bytes, hex_valid
from ..functions.someip import payload_prefix_hex, someip_payload_len
from ..operators.flows import delta, flow_features, payload_change, previous_rows
from ..operators.payload import (benign_sample, fit_byte_model, model_vector,
                                 score_payloads)
from ..schemas import FEATURE_COLS
from ..session import cut_lineage
from ..sources.fixtures import packets, payloads, table
from .catalog import register

R = 6  # decimals kept for summed floating-point results on both engines


def byte_model(df):
    return fit_byte_model(benign_sample(df))


def fitted_vector(df):
    # one bounded row, reused by every scoring branch: computed once
    return cut_lineage(model_vector(byte_model(df)))


def features(spark, sf):
    pk = packets(spark, sf)
    return flow_features(pk, fitted_vector(pk))


def rounded(df, cols, r=R):
    return df.select(*[F.round(c, r).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- DuckDB building blocks -------------------------------------------------

def duck_model(view: str, where: str = "TRUE", p: str = "bm") -> str:
    return f"""
{p}_sample AS (
  SELECT payload_hex AS h FROM {view}
  WHERE lower(label_str) = 'normal' AND payload_hex IS NOT NULL AND {where}
),
{p}_valid AS (
  SELECT h FROM {p}_sample
  WHERE length(h) % 2 = 0 AND length(h) >= 2 AND regexp_full_match(h, '[0-9a-fA-F]*')),
{p}_pairs AS (
  SELECT CAST(i AS INTEGER) AS pos, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS byte
  FROM {p}_valid, range(0, least(length(h) // 2, 256)) t(i)),
{p}_counts AS (SELECT pos, byte, count(*) AS cnt FROM {p}_pairs GROUP BY pos, byte),
{p}_totals AS (SELECT pos, CAST(sum(cnt) AS BIGINT) AS n_pos FROM {p}_counts GROUP BY pos)"""


def duck_bytes(view: str) -> str:
    return f"""
sc_bytes AS (
  SELECT pkt_no, CAST(i AS INTEGER) AS pos,
         CAST(('0x' || substr(payload_hex, 2 * i + 1, 2)) AS INTEGER) AS byte
  FROM {view}, range(0, least(length(payload_hex) // 2, 256)) t(i)
  WHERE payload_hex IS NOT NULL AND length(payload_hex) % 2 = 0 AND length(payload_hex) >= 2
    AND regexp_full_match(payload_hex, '[0-9a-fA-F]*'))"""


def duck_ll(p: str = "bm", out: str = "sc_ll") -> str:
    return f"""
{out} AS (
  SELECT b.pkt_no, sum(ln((coalesce(c.cnt, 0) + 1.0e0) / (coalesce(t.n_pos, 0) + 256.0e0) + 1e-12)) AS ll
  FROM sc_bytes b
  LEFT JOIN {p}_counts c ON b.pos = c.pos AND b.byte = c.byte
  LEFT JOIN {p}_totals t ON b.pos = t.pos
  GROUP BY b.pkt_no)"""


def duck_loglik(view: str) -> str:
    return duck_bytes(view) + "," + duck_ll()


def duck_hamming(a: str, b: str) -> str:
    """Bytewise popcount-of-xor over the shorter length (independent of the
    Spark word-wise form)."""
    valid = lambda h: (f"({h} IS NOT NULL AND length({h}) % 2 = 0 "  # noqa: E731
                       f"AND regexp_full_match({h}, '[0-9a-fA-F]*'))")
    m = f"least(length({a}), length({b})) // 2"
    s = (f"list_sum([bit_count(xor(CAST(('0x' || substr({a}, 2 * i + 1, 2)) AS INTEGER), "
         f"CAST(('0x' || substr({b}, 2 * i + 1, 2)) AS INTEGER))) for i in range(0, {m})])")
    return f"CASE WHEN {valid(a)} AND {valid(b)} AND {m} > 0 THEN CAST({s} AS DOUBLE) ELSE 0.0e0 END"


FLOW_W = ("WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port, transport "
          "ORDER BY ts_s, pkt_no)")

DUCK_PREV = f"""
pv AS (
  SELECT *, lag(ts_s) OVER w AS p_ts, lag(ip_len) OVER w AS p_ip,
         lag(transport_len) OVER w AS p_tl, lag(payload_hex) OVER w AS p_pl
  FROM packets {FLOW_W})"""


# ---- W1-W4 --------------------------------------------------------------------

@register("q_f01_time_interval", views=("packets",), sql=f"""
WITH {DUCK_PREV}
SELECT pkt_no, coalesce(ts_s - p_ts, 0.0e0) AS f01_ip_time_interval FROM pv""")
def q_f01_time_interval(spark, sf):
    p = previous_rows(packets(spark, sf), ["ts_s"])
    return p.select("pkt_no", delta("ts_s", "prev_ts_s").alias("f01_ip_time_interval"))


@register("q_f08_ip_length", views=("packets",), sql=f"""
WITH {DUCK_PREV}
SELECT pkt_no, coalesce(CAST(ip_len AS DOUBLE) - p_ip, 0.0e0) AS f08_ip_length_changes FROM pv""")
def q_f08_ip_length(spark, sf):
    p = previous_rows(packets(spark, sf), ["ip_len"])
    return p.select("pkt_no", delta("ip_len", "prev_ip_len").alias("f08_ip_length_changes"))


@register("q_f09_transport_length", views=("packets",), sql=f"""
WITH {DUCK_PREV}
SELECT pkt_no, coalesce(CAST(transport_len AS DOUBLE) - p_tl, 0.0e0) AS f09_tcpudp_length_changes
FROM pv""")
def q_f09_transport_length(spark, sf):
    p = previous_rows(packets(spark, sf), ["transport_len"])
    return p.select("pkt_no", delta("transport_len", "prev_transport_len").alias("f09_tcpudp_length_changes"))


@register("q_f06_payload_change", views=("packets",), sql=f"""
WITH {DUCK_PREV}
SELECT pkt_no, {duck_hamming('p_pl', 'payload_hex')} AS f06_someip_payload_changes,
       {duck_hamming('p_pl', 'payload_hex')} AS f07_tcpudp_payload_changes FROM pv""")
def q_f06_payload_change(spark, sf):
    p = previous_rows(packets(spark, sf), ["payload_hex"])
    return p.select("pkt_no", payload_change().alias("f06_someip_payload_changes"),
                    payload_change().alias("f07_tcpudp_payload_changes"))


# ---- W5 flagship ------------------------------------------------------------------

FLOW_FEATURES_SQL = f"""
WITH {duck_model('packets')}, {duck_loglik('packets')}, {DUCK_PREV}
SELECT pv.pkt_no, ts_s, src_ip, dst_ip, src_port, dst_port, transport, is_sd,
  coalesce(ts_s - p_ts, 0.0e0) AS f01_ip_time_interval,
  round(coalesce(ll, 0.0e0), {R}) AS f02_someip_likelihood,
  round(coalesce(ll, 0.0e0), {R}) AS f03_tcpudp_likelihood,
  round(coalesce(-ll / (length(payload_hex) // 2), 0.0e0), {R}) AS f04_someip_entropy,
  round(coalesce(-ll / (length(payload_hex) // 2), 0.0e0), {R}) AS f05_tcpudp_entropy,
  {duck_hamming('p_pl', 'payload_hex')} AS f06_someip_payload_changes,
  {duck_hamming('p_pl', 'payload_hex')} AS f07_tcpudp_payload_changes,
  coalesce(CAST(ip_len AS DOUBLE) - p_ip, 0.0e0) AS f08_ip_length_changes,
  coalesce(CAST(transport_len AS DOUBLE) - p_tl, 0.0e0) AS f09_tcpudp_length_changes,
  label_str, CASE WHEN lower(label_str) = 'normal' THEN 0 ELSE 1 END AS label
FROM pv LEFT JOIN sc_ll ON pv.pkt_no = sc_ll.pkt_no"""


@register("q_flow_features", views=("packets",), sql=FLOW_FEATURES_SQL)
def q_flow_features(spark, sf):
    return rounded(features(spark, sf), FEATURE_COLS[1:5])


# ---- X0-X4, X6 on payloads ----------------------------------------------------------

@register("q_byte_model", views=("payloads",), sql=f"""
WITH {duck_model('payloads')}
SELECT c.pos, c.byte, c.cnt, t.n_pos, (c.cnt + 1.0e0) / (t.n_pos + 256.0e0) AS prob
FROM bm_counts c JOIN bm_totals t ON c.pos = t.pos""")
def q_byte_model(spark, sf):
    return byte_model(payloads(spark, sf)).select("pos", "byte", "cnt", "n_pos", "prob")


def payload_scores(spark, sf):
    p = payloads(spark, sf)
    return score_payloads(p, fitted_vector(p))


@register("q_f02_likelihood", views=("payloads",), sql=f"""
WITH {duck_model('payloads')}, {duck_loglik('payloads')}
SELECT p.pkt_no, round(coalesce(ll, 0.0e0), {R}) AS likelihood
FROM payloads p LEFT JOIN sc_ll s ON p.pkt_no = s.pkt_no""")
def q_f02_likelihood(spark, sf):
    return rounded(payload_scores(spark, sf).select("pkt_no", "likelihood"), ["likelihood"])


@register("q_f04_entropy", views=("payloads",), sql=f"""
WITH {duck_model('payloads')}, {duck_loglik('payloads')}
SELECT p.pkt_no, round(coalesce(-ll / (length(payload_hex) // 2), 0.0e0), {R}) AS entropy
FROM payloads p LEFT JOIN sc_ll s ON p.pkt_no = s.pkt_no""")
def q_f04_entropy(spark, sf):
    return rounded(payload_scores(spark, sf).select("pkt_no", "entropy"), ["entropy"])


@register("q_top_anomalous", views=("payloads",), sql=f"""
WITH {duck_model('payloads')}, {duck_loglik('payloads')}
SELECT p.pkt_no, round(coalesce(ll, 0.0e0), {R}) AS likelihood
FROM payloads p LEFT JOIN sc_ll s ON p.pkt_no = s.pkt_no
ORDER BY likelihood, p.pkt_no LIMIT 20""")
def q_top_anomalous(spark, sf):
    s = rounded(payload_scores(spark, sf).select("pkt_no", "likelihood"), ["likelihood"])
    return s.orderBy("likelihood", "pkt_no").limit(20)


@register("q_hamming", views=("payloads",), sql=f"""
WITH pv AS (SELECT pkt_no, payload_hex,
  lag(payload_hex) OVER (PARTITION BY source ORDER BY pkt_no) AS p_pl FROM payloads)
SELECT pkt_no, CASE WHEN p_pl IS NULL OR payload_hex IS NULL THEN 0.0e0
  ELSE {duck_hamming('p_pl', 'payload_hex')} END AS hamming FROM pv""")
def q_hamming(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("source").orderBy("pkt_no")
    p = payloads(spark, sf).withColumn("p_pl", F.lag("payload_hex").over(w))
    return p.select("pkt_no", hamming_hex("p_pl", "payload_hex").alias("hamming"))


@register("q_hex_codec", views=("payloads",), sql="""
SELECT pkt_no,
  (payload_hex IS NOT NULL AND length(payload_hex) % 2 = 0
   AND regexp_full_match(payload_hex, '[0-9a-fA-F]*')) AS is_valid,
  CASE WHEN payload_hex IS NOT NULL AND length(payload_hex) % 2 = 0
   AND regexp_full_match(payload_hex, '[0-9a-fA-F]*')
   THEN CAST(octet_length(unhex(payload_hex)) AS INTEGER) END AS n_bytes,
  CASE WHEN payload_hex IS NOT NULL AND length(payload_hex) % 2 = 0
   AND regexp_full_match(payload_hex, '[0-9a-fA-F]*')
   THEN lower(hex(unhex(payload_hex))) END AS roundtrip
FROM payloads""")
def q_hex_codec(spark, sf):
    p = payloads(spark, sf)
    b = hex_to_bytes("payload_hex")
    return p.select("pkt_no", F.coalesce(hex_valid("payload_hex"), F.lit(False)).alias("is_valid"),
                    F.length(b).alias("n_bytes"), bytes_to_hex(b).alias("roundtrip"))


@register("q_payload_prefix", sql="""
SELECT doc_id AS pkt_no,
  CASE WHEN octet_length(encode(text)) >= 16 THEN lower(substr(hex(text), 33, 64)) END AS payload_hex,
  CASE WHEN octet_length(encode(text)) >= 16
       THEN CAST(octet_length(encode(text)) - 16 AS INTEGER) END AS someip_payload_len
FROM documents""")
def q_payload_prefix(spark, sf):
    d = table(spark, sf, "documents")
    b = F.col("text").cast("binary")
    return d.select(F.col("doc_id").alias("pkt_no"), payload_prefix_hex(b).alias("payload_hex"),
                    someip_payload_len(b).alias("someip_payload_len"))
