"""SOME/IP column functions over binary messages (all Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (MSG_TYPE_NAMES, PAYLOAD_PREFIX_BYTES, SOMEIP_HEADER_LEN,
                       SOMEIP_PORT_MAX, SOMEIP_PORT_MIN, SOMEIP_SD_SERVICE)
from .bytes import be_uint, float32_at

HEADER_FIELDS = [
    # name, offset, bytes, type
    ("service_id", 0, 2, "int"),
    ("method_id", 2, 2, "int"),
    ("someip_len", 4, 4, "long"),
    ("client_id", 8, 2, "int"),
    ("session_id", 10, 2, "int"),
    ("proto_ver", 12, 1, "int"),
    ("iface_ver", 13, 1, "int"),
    ("msg_type", 14, 1, "int"),
    ("return_code", 15, 1, "int"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def header_valid(msg) -> Column:
    return F.coalesce(F.length(_c(msg)) >= SOMEIP_HEADER_LEN, F.lit(False))


def msg_type_name(t) -> Column:
    """Known message type names; unknown codes print as ``0x%02X``."""
    t = _c(t)
    m = F.create_map(*[x for k, v in MSG_TYPE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.when(t.isNotNull(), F.coalesce(F.try_element_at(m, t),
                                            F.format_string("0x%02X", t)))


def someip_header(msg) -> list[Column]:
    """Header fields of a binary SOME/IP message, big-endian; all NULL when
    the message is shorter than 16 bytes. Returns named columns."""
    b = _c(msg)
    ok = header_valid(b)
    cols = [F.when(ok, be_uint(b, off, n).cast(tp)).alias(name)
            for name, off, n, tp in HEADER_FIELDS]
    mt = F.when(ok, be_uint(b, 14, 1).cast("int"))
    sid = F.when(ok, be_uint(b, 0, 2).cast("int"))
    return cols + [
        msg_type_name(mt).alias("msg_type_name"),
        F.when(ok, sid == SOMEIP_SD_SERVICE).alias("is_sd"),
        ok.alias("someip_valid"),
    ]


def payload_prefix_hex(msg, nbytes: int = PAYLOAD_PREFIX_BYTES) -> Column:
    """Lowercase hex of the first ``nbytes`` payload bytes after the header."""
    b = _c(msg)
    return F.when(header_valid(b), F.lower(F.hex(F.substring(b, SOMEIP_HEADER_LEN + 1, nbytes))))


def someip_payload_len(msg) -> Column:
    b = _c(msg)
    return F.when(header_valid(b), F.length(b) - SOMEIP_HEADER_LEN)


def someip_port(src, dst) -> Column:
    """Either port inside the SOME/IP range (inclusive)."""
    return _c(src).between(SOMEIP_PORT_MIN, SOMEIP_PORT_MAX) | \
        _c(dst).between(SOMEIP_PORT_MIN, SOMEIP_PORT_MAX)


def float32_values(payload, count: int, endian: str = "little") -> list[Column]:
    """``count`` float32 values from the start of a binary payload."""
    return [float32_at(payload, 4 * i, endian) for i in range(count)]


def decode_service_payload(service_id, payload, endian: str = "little") -> Column:
    """Array of floats for the simulated services (GPS 2, IMU 6, VDE 4
    values), NULL when the service is unknown or the payload too short."""
    from ..schemas import SERVICES
    s, p = _c(service_id), _c(payload)
    out = None
    for _, sid, _, _, _, n in SERVICES:
        arr = F.array(*float32_values(p, n, endian))
        cond = (s == sid) & (F.length(p) >= 4 * n)
        out = F.when(cond, arr) if out is None else out.when(cond, arr)
    return out


# Log patterns of the telemetry monitor (publisher send
# patterns by container, and the receive pattern for all others).
SEND_PATTERNS = {
    "ecu-gps": r"\[GPS\].*lat=",
    "ecu-imu": r"\[IMU\].*accel=",
    "ecu-vde": r"\[VDE\].*speed=",
}
RECV_PATTERN = r"lat=|accel=|speed="


def log_match(container, line) -> Column:
    c, ln = _c(container), _c(line)
    expr = None
    for name, pat in SEND_PATTERNS.items():
        expr = F.when(c == name, ln.rlike(pat)) if expr is None else expr.when(c == name, ln.rlike(pat))
    return expr.otherwise(ln.rlike(RECV_PATTERN))


def log_payload(line, width: int = 60) -> Column:
    """Up to ``width`` characters starting two after the first ']'."""
    ln = _c(line)
    return F.substr(ln, F.instr(ln, "]") + 2, F.lit(width))
