"""Table schemas, feature names and fixed dimension values."""

from __future__ import annotations

from pyspark.sql import types as T

# Flow key: the five-tuple every per-flow feature is computed over.
FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "transport"]

# Packet table written by the capture job (one row per kept frame).
PACKET_SCHEMA = T.StructType([
    T.StructField("pcap_file", T.StringType()),
    T.StructField("pkt_no", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("ip_ttl", T.IntegerType()),
    T.StructField("ip_len", T.IntegerType()),
    T.StructField("ip_id", T.IntegerType()),
    T.StructField("ip_flags", T.IntegerType()),
    T.StructField("transport", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("transport_len", T.IntegerType()),
    T.StructField("tcp_seq", T.LongType()),
    T.StructField("tcp_ack", T.LongType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("someip_valid", T.BooleanType()),
    T.StructField("service_id", T.IntegerType()),
    T.StructField("method_id", T.IntegerType()),
    T.StructField("someip_len", T.LongType()),
    T.StructField("client_id", T.IntegerType()),
    T.StructField("session_id", T.IntegerType()),
    T.StructField("proto_ver", T.IntegerType()),
    T.StructField("iface_ver", T.IntegerType()),
    T.StructField("msg_type", T.IntegerType()),
    T.StructField("msg_type_name", T.StringType()),
    T.StructField("return_code", T.IntegerType()),
    T.StructField("is_sd", T.BooleanType()),
    T.StructField("payload_hex", T.StringType()),
    T.StructField("someip_payload_len", T.IntegerType()),
    T.StructField("label", T.StringType()),
])

# Column order of the packet CSV (compatibility sink / scan).
PACKET_CSV_COLUMNS = [
    "timestamp", "src_ip", "dst_ip", "ip_proto", "ip_ttl", "ip_len", "ip_id",
    "ip_flags", "transport", "src_port", "dst_port", "transport_len", "tcp_seq",
    "tcp_ack", "tcp_flags", "someip_valid", "service_id", "method_id",
    "someip_len", "client_id", "session_id", "proto_ver", "iface_ver", "msg_type",
    "msg_type_name", "return_code", "is_sd", "payload_hex", "someip_payload_len",
    "label", "pcap_file",
]

# The nine behavioural feature names (output names kept so
# results are comparable with the published tables).
FEATURE_COLS = [
    "f01_ip_time_interval",
    "f02_someip_likelihood",
    "f03_tcpudp_likelihood",
    "f04_someip_entropy",
    "f05_tcpudp_entropy",
    "f06_someip_payload_changes",
    "f07_tcpudp_payload_changes",
    "f08_ip_length_changes",
    "f09_tcpudp_length_changes",
]
NORM_COLS = [c + "_norm" for c in FEATURE_COLS]

# The twelve-column layered feature set, in published order.
LAYERED_FEATURE_COLS = [
    "f_someip_likelihood", "f_someip_entropy", "f_sd_likelihood",
    "f_tcpudp_likelihood", "f_sd_entropy", "f_tcpudp_entropy",
    "f_someip_payload_changes", "f_sd_payload_changes",
    "f_tcpudp_payload_changes", "f_ip_time_interval", "f_ip_length_changes",
    "f_tcpudp_length_changes",
]

# SOME/IP protocol constants.
SOMEIP_HEADER_LEN = 16
SOMEIP_SD_SERVICE = 0xFFFF
SOMEIP_PORT_MIN = 30490
SOMEIP_PORT_MAX = 30510
PAYLOAD_PREFIX_BYTES = 32

# SOME/IP message type code -> name.
MSG_TYPE_NAMES = {
    0x00: "REQUEST",
    0x01: "REQUEST_NO_RETURN",
    0x02: "NOTIFICATION",
    0x80: "RESPONSE",
    0x81: "ERROR",
}

# Capture file name -> class, in file order.
PCAP_LABELS = [
    ("benign_traffic.pcap", "normal"),
    ("dos_noti_flood.pcap", "dos"),
    ("fuzzy_sd_offer_rand_noti(1).pcap", "fuzzy"),
    ("fuzzy_sd_offer_rand_noti(2).pcap", "fuzzy"),
    ("fuzzy_sd_offer_rand_noti(3).pcap", "fuzzy"),
    ("mitm_multi_attacker.pcap", "mitm"),
    ("mitm_single_attacker.pcap", "mitm"),
]

# Simulated services (name, service id, event id, port,
# nominal period in ms, float32 count in the payload).
SERVICES = [
    ("GPS", 0x1234, 0x8001, 30501, 100, 2),
    ("IMU", 0x1235, 0x8002, 30502, 50, 6),
    ("VDE", 0x1236, 0x8003, 30503, 50, 4),
]

# Subscriber ECU -> subscribed services.
SUBSCRIPTIONS = [
    ("ADAS", "VDE"),
    ("CLU", "GPS"),
    ("NAV", "GPS"),
    ("PT", "VDE"),
    ("STE", "IMU"),
    ("TEL", "GPS"),
    ("TEL", "IMU"),
]

# Monitored ECUs (container, label, role).
ECUS = [
    ("ecu-gps", "GPS", "publisher"),
    ("ecu-imu", "IMU", "publisher"),
    ("ecu-vde", "VDE", "publisher"),
    ("ecu-adas", "ADAS", "subscriber"),
    ("ecu-clu", "CLU", "subscriber"),
    ("ecu-nav", "NAV", "subscriber"),
    ("ecu-pt", "PT", "subscriber"),
    ("ecu-ste", "STE", "subscriber"),
    ("ecu-tel", "TEL", "subscriber"),
]

# Service-discovery offer cycle (ms) and TTL (cycles).
SD_OFFER_CYCLE_MS = 1000
SD_TTL = 3

# Published metrics per scenario (precision, recall, f1,
# pr_auc, roc_auc) and the tolerance used to compare with them.
PAPER_METRICS = [
    ("imbalanced", 0.97, 0.97, 0.97, 0.93, 0.99),
    ("balanced", 0.97, 0.97, 0.90, 0.97, 0.97),
]
PAPER_TOLERANCE = 0.02
PAPER_THRESHOLD = 0.36

# Thresholds of the threshold list report.
THRESHOLD_LIST = [0.30, 0.32, 0.34, 0.36, 0.38, 0.40, 0.42, 0.43, 0.45, 0.50]

# Boosted-tree profile of the reference (trees, learning rate,
# depth, row and column sampling per tree in thousandths, L2, gain and child
# weight thresholds, seed) and of its leaf-wise second one.
GBT_PARAMS = dict(rounds=1000, eta=0.05, depth=6, rows=800, columns=800, l2=1.0, min_gain=0.0,
                  min_child_weight=1.0, seed=42)
GBT2_PARAMS = dict(rounds=1000, eta=0.05, depth=30, max_leaves=31, l2=0.0, min_child_weight=1e-3, seed=42)
