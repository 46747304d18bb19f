"""Queries: SOME/IP header and payload decode (D1, D2, D10), table scans (S3, S4), layered features."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bytes import be_uint, float32_at
from ..functions.someip import msg_type_name, payload_prefix_hex, someip_header, someip_payload_len
from ..operators.flows import layered_features
from ..operators.payload import benign_sample, fit_byte_model, model_vector
from ..schemas import FEATURE_COLS, LAYERED_FEATURE_COLS, MSG_TYPE_NAMES
from ..session import cut_lineage, scratch_path, ship_package
from ..sources.capture import capture_paths, decode_frames, read_frames
from ..sources.fixtures import packets, table
from ..sources.ranges import RANGE_BYTES
from .catalog import register
from .q_features import FLOW_FEATURES_SQL, features, rounded

R = 6
CODES = [0x00, 0x01, 0x02, 0x80, 0x81, 0x7F]


def _hexw(c, nbytes):
    return F.lpad(F.hex(c.cast("long")), 2 * nbytes, "0")


def header_source(li):
    """Header fields taken from lineitem numbers (the values to encode)."""
    codes = F.array(*[F.lit(c) for c in CODES])
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_partkey") % 65536).cast("int").alias("s_service_id"),
        (F.col("l_suppkey") % 65536).cast("int").alias("s_method_id"),
        (F.col("l_orderkey") % 4294967296).alias("s_someip_len"),
        F.col("l_linenumber").cast("int").alias("s_client_id"),
        (F.col("l_orderkey") % 65536).cast("int").alias("s_session_id"),
        F.lit(1).alias("s_proto_ver"),
        (F.col("l_quantity").cast("int") % 256).alias("s_iface_ver"),
        F.element_at(codes, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("s_msg_type"),
        (F.round(F.col("l_tax") * 100).cast("int") % 256).alias("s_return_code"),
        F.concat("l_returnflag", "l_linestatus").alias("s_payload"))


def _msg_name_sql(c: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in MSG_TYPE_NAMES.items())
    return f"CASE {c} {cases} ELSE printf('0x%02X', {c}) END"


HDR_FIELDS = ["service_id", "method_id", "someip_len", "client_id", "session_id", "proto_ver",
              "iface_ver", "msg_type", "return_code"]


@register("q_someip_header", sql=f"""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 65536 AS INTEGER) AS service_id,
  CAST(l_suppkey % 65536 AS INTEGER) AS method_id, CAST(l_orderkey % 4294967296 AS BIGINT) AS someip_len,
  CAST(l_linenumber AS INTEGER) AS client_id, CAST(l_orderkey % 65536 AS INTEGER) AS session_id,
  1 AS proto_ver, CAST(CAST(trunc(l_quantity) AS INTEGER) % 256 AS INTEGER) AS iface_ver,
  {[c for c in CODES]}[l_linenumber % 6 + 1] AS msg_type,
  CAST(CAST(round(l_tax * 100) AS INTEGER) % 256 AS INTEGER) AS return_code,
  l_returnflag || l_linestatus AS p, l_linenumber = 7 AS short FROM lineitem)
SELECT l_orderkey, l_linenumber,
  {', '.join(f'CASE WHEN short THEN NULL ELSE {c} END AS {c}' for c in HDR_FIELDS)},
  CASE WHEN short THEN NULL ELSE {_msg_name_sql('msg_type')} END AS msg_type_name,
  CASE WHEN short THEN NULL ELSE service_id = 65535 END AS is_sd, NOT short AS someip_valid,
  CASE WHEN short THEN NULL ELSE lower(hex(p)) END AS payload_hex,
  CASE WHEN short THEN NULL ELSE CAST(octet_length(encode(p)) AS INTEGER) END AS someip_payload_len
FROM s""")
def q_someip_header(spark, sf):
    s = header_source(table(spark, sf, "lineitem"))
    enc = F.concat(_hexw(F.col("s_service_id"), 2), _hexw(F.col("s_method_id"), 2),
                   _hexw(F.col("s_someip_len"), 4), _hexw(F.col("s_client_id"), 2),
                   _hexw(F.col("s_session_id"), 2), _hexw(F.col("s_proto_ver"), 1),
                   _hexw(F.col("s_iface_ver"), 1), _hexw(F.col("s_msg_type"), 1),
                   _hexw(F.col("s_return_code"), 1), F.hex(F.col("s_payload").cast("binary")))
    msg = F.unhex(enc)
    msg = F.when(F.col("l_linenumber") == 7, F.substring(msg, 1, 15)).otherwise(msg)
    d = s.select("l_orderkey", "l_linenumber", msg.alias("m"))
    return d.select("l_orderkey", "l_linenumber", *someip_header("m"),
                    payload_prefix_hex("m").alias("payload_hex"),
                    someip_payload_len("m").alias("someip_payload_len"))


def encoded_frames(li):
    """One Ethernet frame per lineitem row: every second one with a VLAN tag, UDP
    or TCP (with options), padded; line 6 is a later fragment, line 7 is ICMP."""
    line, part, supp, order = (F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"))
    tcp = line % 3 == 0
    proto = F.when(line == 7, 1).when(tcp, 6).otherwise(17)
    someip = F.concat(_hexw(part % 65536, 2), _hexw(supp % 65536, 2), F.lit("0000000A00010002010102"), F.lit("00"),
                      F.hex(F.concat("l_returnflag", "l_linestatus").cast("binary")))
    ports = F.concat(_hexw(30501 + supp % 20, 2), _hexw(30480 + part % 40, 2))
    l4 = F.when(tcp, F.concat(ports, _hexw(order % 4294967296, 4), _hexw(part, 4), F.lit("6018020000000000"),
                              F.lit("01010101"), someip)).otherwise(F.concat(ports, F.lit("001A0000"), someip))
    frag = F.when(line == 6, F.lit(0x2001)).when(supp % 2 == 0, F.lit(0x4000)).otherwise(F.lit(0))
    ip = F.concat(F.lit("4500"), _hexw(F.when(tcp, 62).otherwise(46), 2), _hexw(order % 65536, 2), _hexw(frag, 2),
                  _hexw(part % 256, 1), _hexw(proto, 1), F.lit("0000AC1E"), _hexw(supp % 256, 1), _hexw(line, 1),
                  F.lit("0A00"), _hexw(part % 256, 1), _hexw(order % 256, 1))
    eth = F.concat(F.lit("020202020202040404040404"), F.when(line % 2 == 0, "81000005").otherwise(""), F.lit("0800"))
    return li.select(
        F.when(line < 4, "benign_traffic.pcap").otherwise("other.pcap").alias("pcap_file"),
        (order * 8 + line).alias("pkt_no"), (supp * 4294967296 + part).alias("tie"), F.lit(0.0).alias("ts"),
        F.unhex(F.concat(eth, ip, l4, F.lit("000000000000"))).alias("frame"),
        F.lit(None).cast("int").alias("orig_len"), F.lit(None).cast("string").alias("error"))


FRAME_FIELDS = ["pcap_file", "pkt_no", "src_ip", "dst_ip", "ip_proto", "ip_ttl", "ip_len", "ip_id", "ip_flags",
                "transport", "src_port", "dst_port", "transport_len", "tcp_seq", "tcp_ack", "tcp_flags",
                "service_id", "method_id", "payload_hex", "label"]


@register("q_frame_decode", sql=f"""
WITH s AS (SELECT *, l_linenumber % 3 = 0 AS tcp, CAST(30501 + l_suppkey % 20 AS INTEGER) AS src_port,
  CAST(30480 + l_partkey % 40 AS INTEGER) AS dst_port FROM lineitem),
r AS (SELECT CASE WHEN l_linenumber < 4 THEN 'benign_traffic.pcap' ELSE 'other.pcap' END AS pcap_file,
  l_orderkey * 8 + l_linenumber AS pkt_no,
  '172.30.' || (l_suppkey % 256) || '.' || l_linenumber AS src_ip,
  '10.0.' || (l_partkey % 256) || '.' || (l_orderkey % 256) AS dst_ip,
  CAST(CASE WHEN tcp THEN 6 ELSE 17 END AS INTEGER) AS ip_proto, CAST(l_partkey % 256 AS INTEGER) AS ip_ttl,
  CAST(CASE WHEN tcp THEN 62 ELSE 46 END AS INTEGER) AS ip_len, CAST(l_orderkey % 65536 AS INTEGER) AS ip_id,
  CAST(CASE WHEN l_suppkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS ip_flags,
  CASE WHEN tcp THEN 'TCP' ELSE 'UDP' END AS transport, src_port, dst_port,
  CAST(CASE WHEN tcp THEN 42 ELSE 26 END AS INTEGER) AS transport_len,
  CAST(CASE WHEN tcp THEN l_orderkey % 4294967296 END AS BIGINT) AS tcp_seq,
  CAST(CASE WHEN tcp THEN l_partkey END AS BIGINT) AS tcp_ack, CAST(CASE WHEN tcp THEN 24 END AS INTEGER) AS tcp_flags,
  CAST(l_partkey % 65536 AS INTEGER) AS service_id, CAST(l_suppkey % 65536 AS INTEGER) AS method_id,
  lower(hex(l_returnflag || l_linestatus)) AS payload_hex,
  CASE WHEN l_linenumber < 4 THEN 'normal' ELSE 'unknown' END AS label
  FROM s WHERE l_linenumber NOT IN (6, 7) AND (src_port BETWEEN 30490 AND 30510 OR dst_port BETWEEN 30490 AND 30510))
SELECT {', '.join(FRAME_FIELDS)} FROM r""")
def q_frame_decode(spark, sf):
    """Ethernet/VLAN/IPv4/TCP/UDP/SOME-IP layers read back from frames encoded from lineitem."""
    return decode_frames(encoded_frames(table(spark, sf, "lineitem"))).select(*FRAME_FIELDS)


#: Frames that one task of ``write_captures`` sorts, about.
CAPTURE_ROWS = 1 << 20


def write_captures(frames, path):
    """Classic captures under ``path``, one per ``pcap_file``, its frames ordered by ``pkt_no`` and
    ``tie``. Tasks sort and encode ranges of about ``CAPTURE_ROWS`` frames; running sums of their
    sizes say where in its file each range begins, and tasks copy them there."""
    import shutil

    import pyarrow as pa

    ship_package(frames.sparkSession)
    pieces = path + "-pieces"

    def encode(batches):
        import os
        import struct

        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, name, found = None, None, []

        def close():
            out.close()
            piece = os.path.join(pieces, f"{part:08d}-{name}")
            os.replace(out.name, piece)
            found.append((name, part, piece, os.path.getsize(piece)))

        for b in batches:
            for file, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != name:
                    if out:
                        close()
                    os.makedirs(pieces, exist_ok=True)
                    out, name = open(os.path.join(pieces, f".{attempt}-{file}"), "wb"), file
                out.write(struct.pack("<IIII", 1700000000, 0, len(frame), len(frame)) + frame)
        if out:
            close()
        types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], ["pcap_file", "part", "piece", "size"])

    def copy(batches):
        import os
        import shutil
        import struct

        for b in batches:
            for file, piece, begin in zip(*(c.to_pylist() for c in b.columns)):
                os.makedirs(path, exist_ok=True)
                with os.fdopen(os.open(os.path.join(path, file), os.O_RDWR | os.O_CREAT, 0o644), "r+b") as out, open(piece, "rb") as f:
                    if begin == 0:
                        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
                    out.seek(24 + begin)
                    shutil.copyfileobj(f, out, 1 << 20)
            yield b

    keys = ["pcap_file", "pkt_no", "tie"]
    n = max(1, -(-frames.count() // CAPTURE_ROWS))
    found = cut_lineage(frames.select("pcap_file", "frame", "pkt_no", "tie").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                        .select("pcap_file", "frame").mapInArrow(encode, "pcap_file string, part long, piece string, size long"))
    # a row per range and file
    before = Window.partitionBy("pcap_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select("pcap_file", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("begin"))
    placed.repartition(n, "piece").mapInArrow(copy, "pcap_file string, piece string, begin long").write.format("noop").mode("overwrite").save()
    shutil.rmtree(pieces, ignore_errors=True)


@register("q_capture_ranges", sql="""
SELECT CASE WHEN l_linenumber < 4 THEN 'benign_traffic.pcap' ELSE 'other.pcap' END AS pcap_file,
  row_number() OVER (PARTITION BY l_linenumber < 4 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) - 1 AS pkt_no,
  CAST(l_orderkey % 65536 AS INTEGER) AS ip_id, '172.30.' || (l_suppkey % 256) || '.' || l_linenumber AS src_ip
FROM lineitem""")
def q_capture_ranges(spark, sf):
    """Two captures encoded from lineitem, each framed by sixteen byte ranges or more (S1):
    record numbers, and two header fields of every frame."""
    path = scratch_path(spark, f"captures-{uuid.uuid4().hex}")
    write_captures(encoded_frames(table(spark, sf, "lineitem")), path)
    paths = capture_paths(spark, path)
    smallest = paths.agg(F.min("size").alias("size")).first()["size"]
    f = read_frames(paths, max(min(smallest // 16, RANGE_BYTES), 1))
    l3 = F.when(be_uint("frame", 12, 2) == 0x8100, 18).otherwise(14)
    byte = lambda k: F.conv(F.hex(F.substr("frame", l3 + k + 1, F.lit(1))), 16, 10)
    return f.where("error is null").select(
        "pcap_file", "pkt_no", F.conv(F.hex(F.substr("frame", l3 + 5, F.lit(2))), 16, 10).cast("int").alias("ip_id"),
        F.concat_ws(".", *(byte(k) for k in range(12, 16))).alias("src_ip"))


@register("q_msg_type_name", sql=f"""
SELECT code AS msg_type, {_msg_name_sql('code')} AS msg_type_name, count(*) AS n FROM (
  SELECT CAST((l_orderkey * 7 + l_linenumber) % 256 AS INTEGER) AS code FROM lineitem) GROUP BY code""")
def q_msg_type_name(spark, sf):
    li = table(spark, sf, "lineitem")
    c = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 256).cast("int")
    return li.groupBy(c.alias("msg_type")).agg(F.count(F.lit(1)).alias("n")) \
        .select("msg_type", msg_type_name("msg_type").alias("msg_type_name"), "n")


def _bits_sql(expr: str) -> str:
    b = f"({expr})"
    sign = f"CASE WHEN ({b} >> 31) & 1 = 1 THEN -1.0e0 ELSE 1.0e0 END"
    e = f"(({b} >> 23) & 255)"
    m = f"CAST({b} & 8388607 AS DOUBLE)"
    return (f"CASE WHEN {e} = 0 THEN {sign} * ({m} / 8388608.0e0) * pow(2.0e0, -126) "
            f"WHEN {e} = 255 THEN CASE WHEN {m} = 0 THEN {sign} * CAST('inf' AS DOUBLE) ELSE NULL END "
            f"ELSE {sign} * (1.0e0 + {m} / 8388608.0e0) * pow(2.0e0, {e} - 127) END")


LAT_BITS = "(l_orderkey * 2654435761 + l_linenumber * 40503) % 4294967296"
LON_BITS = "(l_partkey * 2246822519 + l_suppkey) % 4294967296"


@register("q_float32_decode", sql=f"""
SELECT l_orderkey, l_linenumber, {_bits_sql(LAT_BITS)} AS lat, {_bits_sql(LON_BITS)} AS lon FROM lineitem""")
def q_float32_decode(spark, sf):
    """GPS payload (two little-endian float32) encoded from lineitem bit
    patterns, then decoded from the binary payload."""
    li = table(spark, sf, "lineitem")

    def le_hex(bits):
        h = F.lpad(F.hex(bits), 8, "0")
        return F.concat(*[F.substr(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)])

    lat_b = F.expr(LAT_BITS)
    lon_b = F.expr(LON_BITS)
    p = li.select("l_orderkey", "l_linenumber", F.unhex(F.concat(le_hex(lat_b), le_hex(lon_b))).alias("pl"))
    v = [float32_at(F.col("pl"), 0), float32_at(F.col("pl"), 4)]
    return p.select("l_orderkey", "l_linenumber",
                    *[F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x).alias(n)
                      for x, n in zip(v, ["lat", "lon"])])


# ---- S3, S4: CSV and parquet scans with explicit schemas --------------------------------------------

PK_COLS = ["pkt_no", "ts_s", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "ip_len",
           "transport_len", "payload_hex", "is_sd", "label_str", "pcap_file"]


@register("q_packet_scan", views=("packets",), sql="""
SELECT pkt_no, ts_s, src_port, dst_port, payload_hex, label_str FROM packets""")
def q_packet_scan(spark, sf):
    """Packets written as CSV (header, fixed column order), read back with an
    explicit schema and a column subset."""
    pk = packets(spark, sf)
    path = scratch_path(spark, f"packets_csv_{uuid.uuid4().hex}")
    pk.write.mode("overwrite").option("header", True).csv(path)
    schema = pk.schema
    return spark.read.schema(schema).option("header", True).csv(path) \
        .select("pkt_no", "ts_s", "src_port", "dst_port", "payload_hex", "label_str")


@register("q_feature_scan", views=("packets",),
          sql=f"SELECT pkt_no, {', '.join(FEATURE_COLS)}, label FROM ({FLOW_FEATURES_SQL})")
def q_feature_scan(spark, sf):
    """Feature table written as parquet and scanned back with a column subset
    (pruned at the scan)."""
    path = scratch_path(spark, f"features_{uuid.uuid4().hex}")
    rounded(features(spark, sf), FEATURE_COLS[1:5]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("pkt_no", *FEATURE_COLS, "label")


def _layered_sql() -> str:
    from .q_features import duck_bytes, duck_hamming, duck_ll, duck_model
    w = "PARTITION BY src_ip, dst_ip, src_port, dst_port, transport"
    o = "ORDER BY ts_s, pkt_no"
    nb = "(length(payload_hex) // 2)"

    def ent(ll):
        return f"coalesce(-{ll} / {nb}, 0.0e0)"
    feats = [
        ("f_someip_likelihood", "CASE WHEN NOT is_sd THEN coalesce(l1.ll, 0.0e0) ELSE 0.0e0 END"),
        ("f_someip_entropy", f"CASE WHEN NOT is_sd THEN {ent('l1.ll')} ELSE 0.0e0 END"),
        ("f_sd_likelihood", "CASE WHEN is_sd THEN coalesce(l2.ll, 0.0e0) ELSE 0.0e0 END"),
        ("f_tcpudp_likelihood", "coalesce(l3.ll, 0.0e0)"),
        ("f_sd_entropy", f"CASE WHEN is_sd THEN {ent('l2.ll')} ELSE 0.0e0 END"),
        ("f_tcpudp_entropy", ent("l3.ll")),
        ("f_someip_payload_changes", f"CASE WHEN NOT is_sd AND lp IS NOT NULL AND payload_hex IS NOT NULL "
                                     f"THEN {duck_hamming('lp', 'payload_hex')} ELSE 0.0e0 END"),
        ("f_sd_payload_changes", f"CASE WHEN is_sd AND lp IS NOT NULL AND payload_hex IS NOT NULL "
                                 f"THEN {duck_hamming('lp', 'payload_hex')} ELSE 0.0e0 END"),
        ("f_tcpudp_payload_changes", f"CASE WHEN pp IS NOT NULL AND payload_hex IS NOT NULL "
                                     f"THEN {duck_hamming('pp', 'payload_hex')} ELSE 0.0e0 END"),
        ("f_ip_time_interval", "coalesce(ts_s - pt, 0.0e0)"),
        ("f_ip_length_changes", "coalesce(CAST(ip_len AS DOUBLE) - pi, 0.0e0)"),
        ("f_tcpudp_length_changes", "coalesce(CAST(transport_len AS DOUBLE) - pl, 0.0e0)"),
    ]
    sel = ",\n  ".join(f"round({e}, {R}) AS {n}" for n, e in feats)
    return f"""
WITH {duck_model('packets', 'NOT is_sd', 'm1')}, {duck_model('packets', 'is_sd', 'm2')},
{duck_model('packets', 'TRUE', 'm3')}, {duck_bytes('packets')},
{duck_ll('m1', 'll1')}, {duck_ll('m2', 'll2')}, {duck_ll('m3', 'll3')},
pv AS (SELECT *, lag(ts_s) OVER ({w} {o}) AS pt, lag(ip_len) OVER ({w} {o}) AS pi,
  lag(transport_len) OVER ({w} {o}) AS pl, lag(payload_hex) OVER ({w} {o}) AS pp,
  lag(payload_hex) OVER ({w}, is_sd {o}) AS lp FROM packets)
SELECT pv.pkt_no, ts_s, src_ip, dst_ip, src_port, dst_port, transport, is_sd,
  {sel},
  label_str, CASE WHEN lower(label_str) = 'normal' THEN 0 ELSE 1 END AS label
FROM pv LEFT JOIN ll1 l1 ON pv.pkt_no = l1.pkt_no LEFT JOIN ll2 l2 ON pv.pkt_no = l2.pkt_no
  LEFT JOIN ll3 l3 ON pv.pkt_no = l3.pkt_no"""


@register("q_layered_features", views=("packets",), sql=_layered_sql())
def q_layered_features(spark, sf):
    """Twelve features with separate SOME/IP, SD and transport byte models."""
    pk = packets(spark, sf)
    someip = model_vector(fit_byte_model(benign_sample(pk.where(~F.col("is_sd")))))
    sd = model_vector(fit_byte_model(benign_sample(pk.where(F.col("is_sd")))))
    tcpudp = model_vector(fit_byte_model(benign_sample(pk)))
    f = layered_features(pk, someip, sd, tcpudp)
    return f.select(*[F.round(c, R).alias(c) if c in LAYERED_FEATURE_COLS else F.col(c) for c in f.columns])
