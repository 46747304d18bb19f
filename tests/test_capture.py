"""Byte-level capture decode against captures built with struct.pack."""

import struct

import pytest
from pyspark.sql import functions as F

from ivnflow.schemas import FEATURE_COLS

from ivnflow.sources.capture import capture_counts, decode_frames, read_frames, capture_paths


def ip4(s):
    return bytes(int(x) for x in s.split("."))


def someip(service, method, msg_type, payload=b"", length=None):
    length = 8 + len(payload) if length is None else length
    return struct.pack(">HHIHHBBBB", service, method, length, 0x0001, 0x0002, 1, 1, msg_type, 0) + payload


def frame(l4, proto=17, vlan=False, ip_opts=b"", frag=0, pad_to=0, src="172.30.0.10", dst="172.30.0.20",
          ethertype=0x0800):
    ihl = (20 + len(ip_opts)) // 4
    total = 20 + len(ip_opts) + len(l4)
    ip = struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, 0, total, 7, frag, 64, proto, 0, ip4(src), ip4(dst)) + ip_opts + l4
    eth = b"\x02" * 6 + b"\x04" * 6
    eth += (struct.pack(">HH", 0x8100, 5) if vlan else b"") + struct.pack(">H", ethertype)
    f = eth + ip
    return f + b"\x00" * max(0, pad_to - len(f))


def udp(sport, dport, payload):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def tcp(sport, dport, payload, opts=b""):
    doff = (20 + len(opts)) // 4
    return struct.pack(">HHIIBBHHH", sport, dport, 1000, 2000, doff << 4, 0x18, 512, 0, 0) + opts + payload


def write_pcap(path, frames, big=False, nano=False, truncate=False):
    o = ">" if big else "<"
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    with open(path, "wb") as f:
        f.write(struct.pack(o + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1))
        for i, fr in enumerate(frames):
            f.write(struct.pack(o + "IIII", 1700000000 + i, 500, len(fr), len(fr)))
            f.write(fr)
        if truncate:
            f.write(struct.pack(o + "IIII", 1700000999, 0, 100, 100) + b"\x00" * 10)


@pytest.fixture(scope="module")
def capdir(tmp_path_factory):
    d = tmp_path_factory.mktemp("caps")
    gps = someip(0x1234, 0x8001, 0x02, struct.pack("<ff", 48.1, 11.5))
    frames = [
        frame(udp(30501, 30490, gps)),                                   # 0 kept
        frame(udp(30501, 30490, gps), vlan=True),                        # 1 kept, VLAN
        frame(udp(30489, 40000, gps)),                                   # 2 dropped (port)
        frame(udp(40000, 30510, someip(0xFFFF, 0x8100, 0x02))),          # 3 kept, SD, boundary
        frame(udp(30511, 40000, gps)),                                   # 4 dropped (port)
        frame(udp(30502, 30490, someip(0x1235, 0x8002, 0x7F, b"\x01" * 40))),  # 5 unknown type, 40-byte payload
        frame(udp(30502, 30490, b"\x01" * 15)),                          # 6 short header, kept invalid
        frame(udp(30502, 30490, b"")),                                   # 7 no payload
        frame(tcp(30503, 50000, someip(0x1236, 0x8003, 0x80), opts=b"\x01\x01\x01\x01"),
              proto=6, ip_opts=b"\x01\x01\x01\x01"),                     # 8 TCP with options
        frame(udp(30501, 30490, someip(0x1234, 0x8001, 0x00)), pad_to=80),  # 9 padded, 16-byte message
        frame(udp(30501, 30490, gps), frag=0x0010),                      # 10 non-first fragment: dropped
        frame(b"\x00" * 28, ethertype=0x0806),                           # 11 ARP: dropped
        frame(b"\x08\x00" + b"\x00" * 6, proto=1),                       # 12 ICMP: dropped
    ]
    write_pcap(d / "benign_traffic.pcap", frames)
    write_pcap(d / "dos_noti_flood.pcap", frames[:2], big=True, nano=True, truncate=True)
    return str(d)


def test_decode(spark, capdir):
    fr = read_frames(capture_paths(spark, capdir))
    pk = decode_frames(fr)
    rows = {(r.pcap_file, r.pkt_no): r for r in pk.collect()}
    b = lambda n: rows[("benign_traffic.pcap", n)]
    assert sorted(n for f, n in rows if f == "benign_traffic.pcap") == [0, 1, 3, 5, 6, 7, 8, 9]
    r = b(0)
    assert (r.src_ip, r.dst_ip, r.ip_proto, r.ip_ttl, r.ip_id, r.transport) == \
        ("172.30.0.10", "172.30.0.20", 17, 64, 7, "UDP")
    assert (r.service_id, r.method_id, r.msg_type, r.msg_type_name, r.is_sd, r.someip_valid) == \
        (0x1234, 0x8001, 2, "NOTIFICATION", False, True)
    assert r.payload_hex == struct.pack("<ff", 48.1, 11.5).hex() and r.someip_payload_len == 8
    assert r.transport_len == 8 + 16 + 8 and r.label == "normal"
    assert b(1).service_id == 0x1234
    assert b(3).is_sd is True and b(3).dst_port == 30510
    assert b(5).msg_type_name == "0x7F" and len(b(5).payload_hex) == 64 and b(5).someip_payload_len == 40
    assert b(6).someip_valid is False and b(6).service_id is None and b(6).payload_hex is None
    assert b(7).someip_valid is False
    t = b(8)
    assert (t.transport, t.tcp_seq, t.tcp_ack, t.tcp_flags, t.msg_type_name) == ("TCP", 1000, 2000, 0x18, "RESPONSE")
    assert t.transport_len == 24 + 16
    p = b(9)
    assert p.someip_payload_len == 0 and p.payload_hex is None and p.msg_type_name == "REQUEST"
    dos = sorted(n for f, n in rows if f == "dos_noti_flood.pcap")
    assert dos == [0, 1] and rows[("dos_noti_flood.pcap", 0)].label == "dos"
    counts = {r.pcap_file: r for r in capture_counts(fr, pk).collect()}
    assert counts["dos_noti_flood.pcap"].error == "truncated record"
    assert counts["benign_traffic.pcap"].n_read == 13 and counts["benign_traffic.pcap"].n_kept == 8


def test_captures_to_features(spark, capdir, tmp_path):
    from ivnflow.plans.flagship import capture_feature_sets
    paths = capture_feature_sets(spark, capdir, str(tmp_path / "out"))
    pk = spark.read.parquet(paths["packets"])
    keys = {(r.pcap_file, r.order_key) for r in pk.select("pcap_file", "order_key").collect()}
    assert ("dos_noti_flood.pcap", (1 << 40) + 1) in keys and ("benign_traffic.pcap", 0) in keys
    f = spark.read.parquet(paths["normalised"])
    assert f.count() == pk.count() == 10
    assert [r.error for r in spark.read.parquet(paths["errors"]).collect()] == ["truncated record"]
    assert {r.split for r in f.select("split").distinct().collect()} <= {"train", "test"}
    r = f.agg(*[F.min(c + "_norm") for c in FEATURE_COLS], *[F.max(c + "_norm") for c in FEATURE_COLS]).first()
    assert all(0.0 <= v <= 1.0 for v in r)


def ng_block(order, code, body):
    body += b"\0" * (-len(body) % 4)
    n = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", code) + n + body + n


@pytest.mark.parametrize("order", ["<", ">"])
def test_pcapng_records(tmp_path, order):
    from ivnflow.sources.capture import _frames_of
    f0, f1 = frame(udp(30501, 30490, b"abc")), frame(udp(30502, 30490, b"abcd"))
    raw = f0[14:]
    nano = struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0)

    def packet(iface, ticks, data):
        return ng_block(order, 6, struct.pack(order + "5I", iface, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)

    blocks = [ng_block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)),
              ng_block(order, 1, struct.pack(order + "HHI", 1, 0, 0)),
              ng_block(order, 1, struct.pack(order + "HHI", 101, 0, 0) + nano),
              ng_block(order, 1, struct.pack(order + "HHI", 147, 0, 0)),
              packet(0, 1_700_000_000_500_000, f0), packet(1, 1_700_000_001_000_000_000, raw),
              ng_block(order, 5, b"\0" * 12), packet(2, 0, f1), packet(2, 0, f1),
              ng_block(order, 3, struct.pack(order + "I", len(f1)) + f1)]
    path = tmp_path / "a.pcapng"
    path.write_bytes(b"".join(blocks))
    got = list(_frames_of(str(path)))
    assert [(g[0], g[4]) for g in got] == [(0, None), (1, None), (2, "link type 147"), (4, None)]
    assert got[0][2] == f0 and got[1][2][12:] == b"\x08\x00" + raw and got[3][2] == f1
    assert abs(got[0][1] - 1700000000.5) < 1e-6 and abs(got[1][1] - 1700000001.0) < 1e-6 and got[3][1] is None
    path.write_bytes(b"".join(blocks)[:-9])
    assert list(_frames_of(str(path)))[-1][4] == "truncated record"
    path.write_bytes(b"")
    assert list(_frames_of(str(path))) == []


def test_link_types(spark, tmp_path):
    import shutil

    from ivnflow.sources.capture import capture_errors
    f0 = frame(udp(30501, 30490, someip(0x1234, 0x8001, 0x02)))
    for name, link, data in [("raw.pcap", 101, f0[14:]), ("sll.pcap", 113, b"\0" * 14 + f0[12:]),
                             ("sll2.pcap", 276, f0[12:14] + b"\0" * 18 + f0[14:]), ("usb.pcap", 189, f0)]:
        write_pcap(tmp_path / "eth", [data])
        whole = (tmp_path / "eth").read_bytes()
        (tmp_path / name).write_bytes(whole[:20] + struct.pack("<I", link) + whole[24:])
    d = tmp_path / "in"
    d.mkdir()
    for f in tmp_path.glob("*.pcap"):
        shutil.copy(f, d)
    fr = read_frames(capture_paths(spark, str(d)))
    assert {r.pcap_file: r.service_id for r in decode_frames(fr).collect()} == {
        "raw.pcap": 0x1234, "sll.pcap": 0x1234, "sll2.pcap": 0x1234}
    assert [tuple(r) for r in capture_errors(fr).collect()] == [("usb.pcap", -1, "link type 189")]


def _split_rows(spark, directory, range_bytes):
    paths = capture_paths(spark, str(directory))
    fr = read_frames(paths, range_bytes).cache()
    from ivnflow.sources.capture import capture_errors
    return (sorted(tuple(r) for r in fr.where("frame is not null").select("pcap_file", "pkt_no", "ts", "frame", "orig_len").collect()),
            sorted(tuple(r) for r in capture_errors(fr).collect()))


@pytest.mark.parametrize("range_bytes", [97, 777])
def test_ranges_of_one_file_give_the_same_rows(spark, tmp_path, range_bytes):
    import random
    r = random.Random(3)
    payload = lambda n: bytes(r.choice([0, 1, 255, r.randrange(256)]) for _ in range(n))
    frames = [frame(udp(30501, 30490, payload(r.choice([0, 3, 40, 700])))) for _ in range(30)]
    # frames whose contents look like records: guesses inside them are wrong
    decoy = b"".join(struct.pack("<IIII", 1700000000, 0, 4, 4) + b"abcd" for _ in range(40))
    frames += [frame(udp(30501, 30490, decoy)) for _ in range(2)] + frames[:8]
    d = tmp_path / "in"
    d.mkdir()
    write_pcap(d / "benign_traffic.pcap", frames)
    write_pcap(d / "cut.pcap", frames[:20], big=True, nano=True, truncate=True)
    (d / "junk.pcap").write_bytes(b"not a capture" * 200)
    (d / "empty.pcap").write_bytes(b"")
    ng = [ng_block("<", 0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)), ng_block("<", 1, struct.pack("<HHI", 1, 0, 0))]
    for k, f in enumerate(frames):
        ng.append(ng_block("<", 6, struct.pack("<5I", 0, 0, k, len(f), len(f)) + f))
        if k == 15:  # a second section of the other byte order, with interfaces of its own
            ng += [ng_block(">", 0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1)), ng_block(">", 1, struct.pack(">HHI", 147, 0, 0)),
                   ng_block(">", 1, struct.pack(">HHI", 1, 0, 0))]
            ng += [ng_block(">", 6, struct.pack(">5I", k % 2, 0, k, len(f), len(f)) + f) for k, f in enumerate(frames[:20])]
            ng += [ng_block("<", 0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)), ng_block("<", 1, struct.pack("<HHI", 1, 0, 0))]
    (d / "many.pcapng").write_bytes(b"".join(ng))
    whole = _split_rows(spark, d, 1 << 30)
    assert len(whole[0]) == 40 + 20 + 40 + 10 and ("cut.pcap", 20, "truncated record") in whole[1]
    assert _split_rows(spark, d, range_bytes) == whole


def test_captures_are_written_in_ranges(spark, tmp_path, monkeypatch):
    """No task sorts a whole file: ranges of a few frames are laid side by side."""
    import os
    import random

    from ivnflow.plans import q_decode as qd
    r = random.Random(2)
    rows = [(r.choice(["a.pcap", "b.pcap"]), r.randint(0, 90), k, r.randbytes(r.randint(0, 40))) for k in range(700)] + [("c.pcap", 1, 1, b"x")]
    monkeypatch.setattr(qd, "CAPTURE_ROWS", 60)
    seen = []
    plain = qd.cut_lineage
    monkeypatch.setattr(qd, "cut_lineage", lambda d: seen.append(plain(d)) or seen[-1])
    at = str(tmp_path / "caps")
    qd.write_captures(spark.createDataFrame(r.sample(rows, len(rows)), "pcap_file string, pkt_no long, tie long, frame binary"), at)
    for name in "abc":
        want = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(
            struct.pack("<IIII", 1700000000, 0, len(f), len(f)) + f for n, _, _, f in sorted(rows) if n == f"{name}.pcap")
        assert open(f"{at}/{name}.pcap", "rb").read() == want
    assert os.listdir(tmp_path) == ["caps"] and seen[0].select("part").distinct().count() > 5
