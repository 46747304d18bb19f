"""Capture files -> packet table.

Only record framing runs in Python: one task per byte range of a capture file
(``ranges``) streams its records through ``mapInArrow`` in bounded batches (a
capture is never held in memory whole). Every protocol layer is then decoded with Catalyst
expressions over the binary frame; with fewer files than task slots the
frames are spread round-robin first so the decode runs in parallel.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bytes import be_uint
from ..functions.someip import (payload_prefix_hex, someip_header, someip_payload_len,
                                someip_port)
from ..schemas import PCAP_LABELS

FRAME_SCHEMA = "pcap_file string, pkt_no long, ts double, frame binary, orig_len int, error string"
BATCH_ROWS = 8192

# Classic capture magic numbers (byte order, ts resolution).
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e-6),
    b"\xa1\xb2\xc3\xd4": (">", 1e-6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e-9),
    b"\xa1\xb2\x3c\x4d": (">", 1e-9),
}

#: Block type that opens a pcapng section.
NG_MAGIC = b"\x0a\x0d\x0d\x0a"


def _open(path: str):
    """Local paths with ``open``; other URIs (hdfs://, s3://, ...) through
    pyarrow's filesystem layer, as seen from the worker."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs as pafs
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_stream(inner)


def _as_ethernet(link: int, data: bytes) -> bytes | None:
    """The frame with an Ethernet header: raw IPv4 and Linux cooked captures get
    one in place of their own; None for link types that are not decoded."""
    if link == 1:
        return data
    if link in (12, 14, 101, 228):  # raw IP
        return b"\0" * 12 + b"\x08\x00" + data
    if link == 113:  # Linux cooked, version 1
        return b"\0" * 12 + data[14:]
    if link == 276:  # Linux cooked, version 2
        return b"\0" * 12 + data[:2] + data[20:]
    return None


def _frames_of(path: str) -> Iterator[tuple]:
    """Yield (pkt_no, ts, frame, orig_len, error) records of one capture.

    A truncated last record ends the file with one error row; the records
    before it are kept. A classic capture of an undecoded link type is one
    error row; in a pcapng capture its records are left out after one such row.
    """
    with _open(path) as f:
        magic = f.read(4)
        if magic == NG_MAGIC:
            yield from _ng_frames(f)
            return
        head = magic + f.read(20)
        if len(head) < 24 or head[:4] not in MAGICS:
            if head:
                yield (-1, None, None, None, "bad header")
            return
        order, res = MAGICS[head[:4]]
        link = struct.unpack(order + "I", head[20:])[0] & 0xFFFF
        if _as_ethernet(link, b"\0" * 32) is None:
            yield (-1, None, None, None, f"link type {link}")
            return
        rec = struct.Struct(order + "IIII")
        n = 0
        while True:
            h = f.read(16)
            if not h:
                return
            if len(h) < 16:
                yield (n, None, None, None, "truncated record header")
                return
            sec, frac, incl, orig = rec.unpack(h)
            data = f.read(incl)
            if len(data) < incl:
                yield (n, None, None, None, "truncated record")
                return
            yield (n, sec + frac * res, _as_ethernet(link, data), orig, None)
            n += 1


def _ng_frames(f, n: int = 0, begin: int | None = None, stop: int | None = None, known: list[bytes] = ()) -> Iterator[tuple]:
    """Records of a pcapng capture whose first four bytes are read. Simple packet
    blocks have no time of their own (null). With ``begin`` only the blocks that
    begin from there to ``stop``, under the section and interface blocks before
    them (``known``), numbered from ``n``."""
    order, links, refused = "<", [], set()
    kind = NG_MAGIC
    for block in known:
        if block[:4] == NG_MAGIC:
            order, links = ("<" if block[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        else:
            links.append((struct.unpack(order + "H", block[8:10])[0], _ng_resolution(order, block[16:-4])))
    if begin is not None:
        f.seek(begin)
        kind = f.read(4)
    while kind:
        head = f.read(8 if kind == NG_MAGIC else 4)
        if len(kind) < 4 or len(head) < 4:
            yield (n, None, None, None, "truncated record header")
            return
        if kind == NG_MAGIC:  # a new section: byte order, then its own interfaces
            order, links = ("<" if head[4:] == b"\x4d\x3c\x2b\x1a" else ">"), []
        left = struct.unpack(order + "I", head[:4])[0] - 4 - len(head)
        body = f.read(max(left, 0))
        if left < 4 or len(body) < left:
            yield (n, None, None, None, "truncated record")
            return
        code = struct.unpack(order + "I", kind)[0]
        if code == 1:
            links.append((struct.unpack(order + "H", body[:2])[0], _ng_resolution(order, body[8:-4])))
        elif code in (3, 6):
            at, high, low, size, orig = (struct.unpack(order + "5I", body[:20]) if code == 6
                                         else (0, None, None, None, *struct.unpack(order + "I", body[:4])))
            data = body[20:20 + size] if code == 6 else body[4:-4][:orig]
            link, res = links[at] if at < len(links) else (-1, 1e-6)
            frame = _as_ethernet(link, data)
            if frame is not None:
                yield (n, None if high is None else ((high << 32) + low) * res, frame, orig, None)
            elif link not in refused:
                refused.add(link)
                yield (n, None, None, None, f"link type {link}")
            n += 1
        if stop is not None and f.tell() >= stop:
            return
        kind = f.read(4)


def _ng_resolution(order: str, options: bytes) -> float:
    """Seconds per tick of an interface (option 9), microseconds when not given."""
    while len(options) >= 4:
        code, size = struct.unpack(order + "HH", options[:4])
        if code == 9 and size:
            v = options[4]
            return 2.0 ** -(v & 0x7F) if v & 0x80 else 10.0 ** -v
        if not code:
            break
        options = options[4 + (size + 3) // 4 * 4:]
    return 1e-6


def _frame_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["pcap_file", "pkt_no", "ts", "frame", "orig_len", "error"]
    types = [pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.int32(), pa.string()]
    for batch in it:
        for path in batch.column(0).to_pylist():
            fname = os.path.basename(path)
            cols = [[] for _ in names]
            for rec in _frames_of(path):
                for c, v in zip(cols, (fname,) + rec):
                    c.append(v)
                if len(cols[0]) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                    cols = [[] for _ in names]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def capture_paths(spark: SparkSession, directory: str, names: list[str] | None = None) -> DataFrame:
    """The capture files found in ``directory``, one row each with its number in
    file order: the expected names first, then any others by path (labelled
    unknown downstream). With ``names`` only those are taken.

    Files are listed by Spark's ``binaryFile`` source with only ``path`` and
    ``length`` selected (contents are not read), so any filesystem the cluster can
    read works; the expected names are a small fixed dimension.
    """
    only = names is not None
    names = names or [n for n, _ in PCAP_LABELS]
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, file_no int")
    listed = spark.read.format("binaryFile").load(directory).select("path", F.col("length").alias("size")) \
        .withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    known = listed.join(F.broadcast(dim), "name", "inner" if only else "left")
    # a listing of files, not of rows
    other = F.row_number().over(Window.partitionBy(F.col("file_no").isNull()).orderBy("path")) + len(names)
    return known.select("path", F.coalesce("file_no", other - 1).alias("file_no"), "size")


def read_frames(paths: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Frames of every capture (S1). With a ``size`` column (``capture_paths``) a file
    is read by one task per ``range_bytes``; without it by one task per file.

    Tasks are range-partitioned on file and range number (hashing paths could
    put two captures into one task).
    """
    from ..session import ship_package
    from .ranges import RANGE_BYTES, read_ranges

    if "size" in paths.columns:
        return read_ranges(paths, range_bytes or RANGE_BYTES)
    ship_package(paths.sparkSession)
    n = max(paths.count(), 1)
    key = "file_no" if "file_no" in paths.columns else "path"
    return paths.repartitionByRange(n, key).select("path").mapInArrow(_frame_batches, FRAME_SCHEMA)


def _u8(b: Column, off: Column) -> Column:
    return F.conv(F.hex(F.substr(b, off + 1, F.lit(1))), 16, 10).cast("int")


def _u16(b: Column, off: Column) -> Column:
    return F.conv(F.hex(F.substr(b, off + 1, F.lit(2))), 16, 10).cast("int")


def _u32(b: Column, off: Column) -> Column:
    return F.conv(F.hex(F.substr(b, off + 1, F.lit(4))), 16, 10).cast("long")


def _ipv4(b: Column, off: Column) -> Column:
    return F.concat_ws(".", *[_u8(b, off + k).cast("string") for k in range(4)])


def decode_frames(frames: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Ethernet (+802.1Q) / IPv4 / TCP|UDP / SOME/IP decode and port filter.

    Non-IPv4, non-TCP/UDP, non-first fragments and packets with neither
    port in the SOME/IP range are dropped. Ethernet padding is trimmed by
    the IP total length.
    """
    spark = frames.sparkSession
    b = F.col("frame")
    ok = frames.where(F.col("error").isNull())
    et0 = be_uint(b, 12, 2)
    vlan = et0 == 0x8100
    d = ok.withColumn("_l3", F.when(vlan, F.lit(18)).otherwise(F.lit(14))) \
        .withColumn("_et", F.when(vlan, be_uint(b, 16, 2)).otherwise(et0))
    l3 = F.col("_l3")
    vihl = _u8(b, l3)
    d = d.where((F.col("_et") == 0x0800) & (F.shiftright(vihl, 4) == 4)) \
        .withColumn("_ihl", vihl.bitwiseAND(15) * 4) \
        .withColumn("ip_len", _u16(b, l3 + 2)) \
        .withColumn("_fragw", _u16(b, l3 + 6)) \
        .withColumn("ip_proto", _u8(b, l3 + 9))
    d = d.where((F.col("_fragw").bitwiseAND(0x1FFF) == 0) & F.col("ip_proto").isin(6, 17))
    l4 = l3 + F.col("_ihl")
    seg_len = F.col("ip_len") - F.col("_ihl")
    tcp = F.col("ip_proto") == 6
    doff = F.shiftright(_u8(b, l4 + 12), 4) * 4
    d = d.select(
        "pcap_file", "pkt_no", F.col("ts").alias("timestamp"),
        _ipv4(b, l3 + 12).alias("src_ip"), _ipv4(b, l3 + 16).alias("dst_ip"),
        "ip_proto", _u8(b, l3 + 8).alias("ip_ttl"), "ip_len", _u16(b, l3 + 4).alias("ip_id"),
        F.shiftright(F.col("_fragw"), 13).alias("ip_flags"),
        F.when(tcp, F.lit("TCP")).otherwise(F.lit("UDP")).alias("transport"),
        _u16(b, l4).alias("src_port"), _u16(b, l4 + 2).alias("dst_port"),
        F.when(tcp, seg_len).otherwise(_u16(b, l4 + 4)).alias("transport_len"),
        F.when(tcp, _u32(b, l4 + 4)).alias("tcp_seq"), F.when(tcp, _u32(b, l4 + 8)).alias("tcp_ack"),
        F.when(tcp, _u8(b, l4 + 13) + F.shiftleft(_u8(b, l4 + 12).bitwiseAND(1), 8)).alias("tcp_flags"),
        F.when(tcp, F.substr(b, l4 + doff + 1, seg_len - doff))
        .otherwise(F.substr(b, l4 + 9, seg_len - 8)).alias("transport_payload"))
    d = d.where(someip_port("src_port", "dst_port"))
    msg = F.when(F.length("transport_payload") > 0, F.col("transport_payload"))
    out = d.select("*", *someip_header(msg), payload_prefix_hex(msg).alias("payload_hex"),
                   someip_payload_len(msg).alias("someip_payload_len"))
    out = out.withColumn("payload_hex", F.nullif(F.col("payload_hex"), F.lit("")))
    if labels is None:
        labels = spark.createDataFrame([(f, lab, i) for i, (f, lab) in enumerate(PCAP_LABELS)],
                                       "pcap_file string, label string, file_no int")
    # the class dimension has one row per capture file: bounded broadcast
    out = out.join(F.broadcast(labels), "pcap_file", "left") \
        .withColumn("label", F.coalesce(F.col("label"), F.lit("unknown")))
    # file order across captures: (file number, packet number) as one key
    fno = F.coalesce(F.col("file_no"), F.lit(len(PCAP_LABELS))).cast("long") if "file_no" in labels.columns \
        else F.lit(0).cast("long")
    return out.withColumn("order_key", F.shiftleft(fno, 40) + F.col("pkt_no")).drop("file_no")


def read_packets(spark: SparkSession, directory: str, spread: int | None = None) -> DataFrame:
    """Packet table of the captures in ``directory``.

    Framing is one task per byte range of a file; when there are fewer files than
    task slots the frames are spread round-robin (``spread`` partitions) so the
    column decode runs in parallel instead of inside each file's task.
    """
    paths = capture_paths(spark, directory)
    frames = read_frames(paths)
    slots = spark.sparkContext.defaultParallelism
    if spread is None and paths.count() < slots:
        spread = slots * 2
    if spread:
        frames = frames.repartition(spread)
    return decode_frames(frames)


def capture_errors(frames: DataFrame) -> DataFrame:
    """Captures that end early or cannot be read: file, record number, reason.
    A link type is reported once per file, at its first record."""
    return frames.where(F.col("error").isNotNull()).groupBy("pcap_file", "error").agg(F.min("pkt_no").alias("pkt_no")) \
        .select("pcap_file", "pkt_no", "error")


def capture_counts(frames: DataFrame, packets: DataFrame) -> DataFrame:
    """Frames read and packets kept per file, with read errors."""
    r = frames.groupBy("pcap_file").agg(F.count(F.col("frame")).alias("n_read"),
                                        F.max("error").alias("error"))
    k = packets.groupBy("pcap_file").agg(F.count(F.lit(1)).alias("n_kept"))
    return r.join(k, "pcap_file", "left").fillna(0, ["n_kept"]) \
        .withColumn("pct_kept", F.when(F.col("n_read") > 0, F.col("n_kept") * 100.0 / F.col("n_read")))


def stream_captures(spark: SparkSession, directory: str, glob: str = "*.pcap") -> DataFrame:
    """Rotated capture files as a stream (S2, T1): file names arrive through
    a binaryFile stream (schema given, as streams require); frames are
    decoded by ``read_frames``/``decode_frames`` in each micro-batch."""
    from pyspark.sql.types import (BinaryType, LongType, StringType, StructField, StructType,
                                   TimestampType)
    schema = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()),
                         StructField("length", LongType()), StructField("content", BinaryType())])
    return (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
            .load(directory).select(F.regexp_replace("path", "^file:", "").alias("path")))
