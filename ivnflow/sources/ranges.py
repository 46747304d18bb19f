"""Byte-range scan of large captures (S1): one file is framed by many tasks.

A capture has no index, so a range of it does not know where its first record
begins. Every range guesses: the first offset from which a chain of plausible
record headers follows. It then walks the headers to the first record that
begins behind the range and reports where that is. The guesses are checked
against each other: a range must begin where the one before it ended. Ranges
that do not are walked again from the true place until all agree, so a wrong
guess costs time and never a row. Counts by range, added up, give the record
numbers, and each range is read once more for its frames.

The table of ranges has a row per ``range_bytes`` of capture; its running sums are
windows over these rows. Files of one range are read directly.
"""

from __future__ import annotations

import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

RANGE_BYTES = 128 << 20
#: Plausible headers in a row that make a guess.
CHAIN = 6
#: Largest record or block that a guess believes in.
LARGEST = 1 << 20
_REPORT = "path string, file_no long, range_no long, lo long, hi long, size long, begin long, stop long, records long, order_in string, order string, events array<string>"


def open_at(path: str):
    """A seekable file: local paths with ``open``, other URIs through pyarrow."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs as pafs
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def ranges_of(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, file_no, range_no, lo, hi, size per range of each file."""
    n = F.greatest(F.ceil(F.col("size") / F.lit(range_bytes)), F.lit(1)).cast("long")
    return paths.select("path", F.col("file_no").cast("long").alias("file_no"), "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("range_no")) \
        .select("path", "file_no", "range_no", (F.col("range_no") * range_bytes).alias("lo"),
                F.least((F.col("range_no") + 1) * range_bytes, F.col("size")).alias("hi"), "size")


# ---- record headers ------------------------------------------------------------------------------

class Classic:
    """Record headers of a classic capture."""

    first = 24

    def __init__(self, head: bytes, order: str, fraction: int):
        self.order, self.fraction = order, fraction
        self.rec = struct.Struct(order + "IIII")

    def header(self, f, at: int, size: int):
        """(next offset, is a record, plausible) of the header at ``at``; None where it is cut off."""
        f.seek(at)
        h = f.read(16)
        if len(h) < 16:
            return None
        _, frac, incl, orig = self.rec.unpack(h)
        return at + 16 + incl, True, frac < self.fraction and incl <= LARGEST and incl <= orig <= LARGEST << 4

    def event(self, f, at: int):
        return None


class Blocks:
    """Block headers of a pcapng capture."""

    first = 0

    def __init__(self, order: str):
        self.order = order

    def header(self, f, at: int, size: int):
        f.seek(at)
        h = f.read(12)
        if len(h) < 12:
            return None
        if h[:4] == b"\x0a\x0d\x0d\x0a":
            self.order = "<" if h[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, total = struct.unpack(self.order + "II", h[:8])
        ok = 12 <= total <= LARGEST and total % 4 == 0 and (kind < 0x100 or h[:4] == b"\x0a\x0d\x0d\x0a")
        if ok and at + total <= size:
            f.seek(at + total - 4)
            ok = f.read(4) == h[4:8]
        return at + max(total, 12), kind in (3, 6), ok

    def event(self, f, at: int):
        """A section or interface block, which later packets need: ``offset:hex``."""
        f.seek(at)
        h = f.read(12)
        section = h[:4] == b"\x0a\x0d\x0d\x0a"
        if section:
            self.order = "<" if h[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, total = struct.unpack(self.order + "II", h[:8])
        if section or kind == 1:
            f.seek(at)
            return f"{at}:{f.read(total).hex()}"
        return None


def layout(f, order: str | None = None):
    """How the file's records lie, or None for files that are no captures."""
    from .capture import MAGICS, NG_MAGIC

    f.seek(0)
    head = f.read(24)
    if head[:4] == NG_MAGIC and len(head) >= 12:
        return Blocks(order or ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"))
    if len(head) < 24 or head[:4] not in MAGICS:
        return None
    o, res = MAGICS[head[:4]]
    return Classic(head, o, round(1 / res))


def guess(f, kind, lo: int, hi: int, size: int):
    """First offset in [lo, hi) from which ``CHAIN`` plausible headers follow (or all up
    to the file's end); None if there is none."""
    step = 4 if isinstance(kind, Blocks) else 1
    at = lo + -lo % step
    keep = kind.order
    while at < min(hi, lo + LARGEST):
        p, seen = at, 0
        while seen < CHAIN and p < size:
            kind.order = keep
            h = kind.header(f, p, size)
            if h is None or not h[2] or h[0] > size:
                break
            p, seen = h[0], seen + 1
        if seen == CHAIN or seen and p == size:
            kind.order = keep
            return at
        at += step
    kind.order = keep
    return None


def walk(path: str, lo: int, hi: int, size: int, begin: int | None, order: str | None):
    """(begin, stop, records, byte order at the begin and the end, events) of a range.
    Without ``begin`` it is guessed; a range without records has neither end nor byte order."""
    with open_at(path) as f:
        kind = layout(f, order)
        if kind is None:
            return 0, size, 0, None, None, []
        if begin is None:
            begin = kind.first if lo == 0 else guess(f, kind, lo, hi, size)
        if begin is None or begin >= hi:
            return begin, None, 0, None, None, []
        at, records, events, order = begin, 0, [], kind.order
        while at < hi:
            e = kind.event(f, at) if at + 12 <= size else None
            if e:
                events.append(e)
            h = kind.header(f, at, size)
            if h is None or h[0] > size:  # cut off: the reader reports it
                at = size
                break
            at, records = h[0], records + int(h[1])
        return begin, at, records, order, kind.order, events


def _walked(ranges: DataFrame) -> DataFrame:
    """The reports of ranges (with ``begin`` and ``order`` where they are known)."""
    def run(batches):
        kinds = [pa.string()] + [pa.int64()] * 8 + [pa.string()] * 2 + [pa.list_(pa.string())]
        names = ["path", "file_no", "range_no", "lo", "hi", "size", "begin", "stop", "records", "order_in", "order", "events"]
        for b in batches:
            rows = []
            for path, file_no, no, lo, hi, size, begin, order in zip(*(b.column(k).to_pylist() for k in range(8))):
                rows.append((path, file_no, no, lo, hi, size, *walk(path, lo, hi, size, begin, order)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return ranges.select("path", "file_no", "range_no", "lo", "hi", "size", "begin", "order").mapInArrow(run, _REPORT)


def _written(df: DataFrame, name: str) -> DataFrame:
    import uuid

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stitched(ranges: DataFrame) -> DataFrame:
    """Reports of all ranges whose begins and ends agree, with ``base``, the number of the
    range's first record, and ``known``, the file's section and interface blocks."""
    spread = ranges.count()
    null = F.lit(None)
    report = _written(_walked(ranges.repartitionByRange(max(spread, 1), "file_no", "range_no")
                              .withColumn("begin", null.cast("long")).withColumn("order", null.cast("string"))), "capture-ranges")
    before = Window.partitionBy("file_no", "path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        due = report.withColumn("_due", F.coalesce(F.max("stop").over(before), F.col("begin"))).withColumn(
            "_order", F.last("order", ignorenulls=True).over(before))
        wrong = F.when(F.col("_due") < F.col("hi"), ~F.col("begin").eqNullSafe(F.col("_due")) | ~F.col("order_in").eqNullSafe(F.col("_order"))).otherwise(F.col("records") > 0)
        due = _written(due.withColumn("_wrong", wrong & (F.col("lo") > 0)), "capture-due")
        if due.where("_wrong").isEmpty():
            report = due.withColumn("begin", F.coalesce("_due", "begin")).drop("_wrong", "_order", "_due")
            break
        # only the first wrong range of a file surely has its true place; the others follow in the next pass
        redo = due.where("_wrong").select("path", "file_no", "range_no", "lo", "hi", "size", F.col("_due").alias("begin"), F.col("_order").alias("order"))
        again = _walked(redo.repartition(max(min(spread, 64), 1)))
        report = _written(due.where("not _wrong").select(*report.columns).unionByName(again), "capture-ranges")
    base = F.coalesce(F.sum("records").over(before), F.lit(0))
    every = Window.partitionBy("file_no", "path")
    return report.withColumn("base", base).withColumn("known", F.flatten(F.collect_list("events").over(every))).drop("events")


def frames_of_range(path: str, begin: int, hi: int, base: int, known: list[str]):
    """Records (pkt_no, ts, frame, orig_len, error) that begin in [begin, hi)."""
    from .capture import MAGICS, NG_MAGIC, _as_ethernet, _ng_frames

    with open_at(path) as f:
        magic = f.read(4)
        if magic == NG_MAGIC:
            events = sorted((int(e.split(":")[0]), bytes.fromhex(e.split(":")[1])) for e in known)
            yield from _ng_frames(f, base, begin, hi, [block for at, block in events if at < begin])
            return
        head = magic + f.read(20)
        if len(head) < 24 or magic not in MAGICS:
            yield (-1, None, None, None, "bad header")
            return
        order, res = MAGICS[magic]
        link = struct.unpack(order + "I", head[20:])[0] & 0xFFFF
        if _as_ethernet(link, b"\0" * 32) is None:
            if begin == 24:
                yield (-1, None, None, None, f"link type {link}")
            return
        rec = struct.Struct(order + "IIII")
        f.seek(begin)
        at, n = begin, base
        while at < hi:
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
            at += 16 + incl


def range_batches(it):
    """Arrow batches of frames for rows (path, begin, hi, base, known, whole)."""
    from .capture import BATCH_ROWS, _frames_of

    names = ["pcap_file", "pkt_no", "ts", "frame", "orig_len", "error"]
    types = [pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.int32(), pa.string()]
    for batch in it:
        for path, begin, hi, base, known, whole in zip(*(c.to_pylist() for c in batch.columns)):
            fname = os.path.basename(path)
            cols = [[] for _ in names]
            for rec in _frames_of(path) if whole else frames_of_range(path, begin, hi, base, known):
                for c, v in zip(cols, (fname,) + rec):
                    c.append(v)
                if len(cols[0]) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                    cols = [[] for _ in names]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def read_ranges(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of every capture (path, file_no, size), a task per range."""
    from .capture import FRAME_SCHEMA

    ship_package(paths.sparkSession)
    ranges = _written(ranges_of(paths, range_bytes), "capture-listing")
    columns = ["path", "begin", "hi", "base", "known", "whole"]
    zero = F.lit(0).cast("long")
    whole = ranges.where(F.col("size") <= range_bytes).select(
        "file_no", "range_no", "path", zero.alias("begin"), "hi", zero.alias("base"), F.array().cast("array<string>").alias("known"), F.lit(True).alias("whole"))
    many = ranges.where(F.col("size") > range_bytes)
    every = whole
    if not many.isEmpty():
        parts = stitched(many).where("begin is not null and begin < hi")
        every = whole.unionByName(parts.select("file_no", "range_no", "path", "begin", "hi", "base", "known", F.lit(False).alias("whole")))
    every = _written(every, "capture-tasks")
    n = max(every.count(), 1)
    frames = every.repartitionByRange(n, "file_no", "range_no").select(*columns).mapInArrow(range_batches, FRAME_SCHEMA)
    return frames
