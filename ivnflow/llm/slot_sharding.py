"""Sharding by fixed virtual slots (operator 7), DataFrame functions only.

A record's hash names one of ``SLOTS`` slots for good. Bytes are summed per
slot, and a versioned table says which shard holds each slot. Rebalancing
edits that map: it moves and swaps slots between the fullest and the emptiest
shard until no move makes them more equal, and stores the result as the next
version. A record finds its shard through its slot, so only edited slots move.

The map has SLOTS rows whatever the corpus, so it is edited on the driver
and broadcast. A record's place within its shard is the number of records in
the shard's earlier slots plus its place in its own slot: no task sorts more
than a slot.

Defined results: null text has no bytes; null ids hash like any value;
repeated rows get places of their own; other columns are not read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, table

SLOTS = 8192
SHARDS = 40


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot per row of ``docs``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"),
                        F.crc32(t).alias("text_crc32"))
            .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")))


def slot_sizes(records: DataFrame) -> DataFrame:
    """vslot, n, bytes: one partial aggregate."""
    return records.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def rebalance(assign: list[int], sizes: list[int], shards: int, max_edits: int | None = None) -> list[int]:
    """The map after moving or swapping slots while that brings the fullest and
    the emptiest shard closer together."""
    out, load = list(assign), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += sizes[slot]
        bisect.insort(held[shard], (sizes[slot], slot))

    def move(item, a, b):
        held[a].remove(item)
        bisect.insort(held[b], item)
        load[a] -= item[0]
        load[b] += item[0]
        out[item[1]] = b

    for _ in range(max_edits if max_edits is not None else 50 * shards):
        hi = max(range(shards), key=lambda s: (load[s], -s))
        for lo in sorted(range(shards), key=lambda s: (load[s], s)):
            gap = load[hi] - load[lo]
            if gap <= 1:
                return out
            # a move or swap that shifts d bytes leaves |gap - 2d|; the best d is near gap / 2
            best, choice = gap, None
            at = bisect.bisect_left(held[hi], (gap // 2, -1))
            for item in held[hi][max(0, at - 1):at + 2]:
                if item[0] and abs(gap - 2 * item[0]) < best:
                    best, choice = abs(gap - 2 * item[0]), (item, None)
            if best > 1:
                for item in held[hi]:
                    at = bisect.bisect_left(held[lo], (item[0] - gap // 2, -1))
                    for other in held[lo][max(0, at - 1):at + 2]:
                        d = item[0] - other[0]
                        if 0 < d and abs(gap - 2 * d) < best:
                            best, choice = abs(gap - 2 * d), (item, other)
            if choice:
                move(choice[0], hi, lo)
                if choice[1]:
                    move(choice[1], lo, hi)
                break
        else:
            return out
    return out


def map_frame(spark: SparkSession, assign: list[int], version: int) -> DataFrame:
    """version, vslot, shard."""
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(F.split(F.lit(",".join(map(str, assign))), ","))
                                 .alias("vslot", "shard")).withColumn("shard", F.col("shard").cast("int"))


def store_map(spark: SparkSession, path: str, assign: list[int], version: int) -> None:
    """Add one version to the stored map; a version is written whole or not at all."""
    map_frame(spark, assign, version).drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def shard_records(records: DataFrame, slot_map: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, place (gapless from 0 within the shard)."""
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (slot_map.join(stats, "vslot").withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
              .select("vslot", "shard", "first"))
    own = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (records.withColumn("k", F.row_number().over(own) - 1)
            .join(F.broadcast(starts), "vslot")  # one row per slot
            .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("k")).alias("place")))


def shard_by_bytes(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Records of ``docs`` in shards of near equal bytes. Version 0 of the map
    deals the slots out in turn; version 1 is version 0 edited for the bytes found."""
    spark = docs.sparkSession
    records = materialise(slotted(docs, slots, id_col, text_col), "shard-records")
    stats = materialise(slot_sizes(records), "shard-slots")
    sizes = [0] * slots
    for r in stats.select("vslot", "bytes").collect():  # at most ``slots`` rows
        sizes[r["vslot"]] = r["bytes"]
    first = [s % shards for s in range(slots)]
    store_map(spark, path, first, 0)
    store_map(spark, path, rebalance(first, sizes, shards), 1)
    return shard_records(records, load_map(spark, path, 1), stats)


def op7_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    out = shard_by_bytes(table(spark, sf_dir, "documents"), scratch_path(spark, f"slot-map-{uuid.uuid4().hex}"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
