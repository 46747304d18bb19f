"""SimHash near-duplicates (operator 5): BK-trees over sharded fingerprints.

A text's fingerprint has 64 bits; bit b is one where more than half of its
3-word shingles (repeats counted) have bit b in their XXH64 hash. Two
documents link where their fingerprints differ in at most ``radius`` bits;
a class is a connected set of links.

Plan: equal fingerprints fold into one row. Fingerprints within ``radius``
bits agree on one of ``radius + 1`` blocks of bits, so every fingerprint is
sent to one shard per block value; each shard builds a BK-tree (children
keyed by their Hamming distance to the parent) and a search follows only
the edges within the radius of the query's own distance. A shard over
``shard_limit`` is dealt out again by blocks of its remaining bits; after
four levels at most 14 free bits remain for a radius of 2, so a shard holds
no more than 2**14 fingerprints whatever the data. The trees are not
broadcast: their size grows with the corpus, so the queries travel to the
tree's shard instead. Each shard returns a spanning forest of its links,
never all pairs, and the forest is joined up by star contraction.

Defined results: null text counts as empty; no word gives fingerprint zero,
linked like any other; fewer words than a shingle form one shingle. Repeated
rows return repeated rows. A null doc_id never names a class that has
another id. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship, table

BITS = 64
LEVELS = 4


def fingerprint_bytes(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hash64 = xxhash.xxh64_intdigest
    h = np.fromiter((hash64(g, 42) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    out = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(out.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit), text_hash per row of ``docs``."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint_bytes(t, shingle) for t in map(_as_py, b.column(1))]
            signed = [f - (1 << 64) if f >> 63 else f for f in fps]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.int64()), b.column(2)],
                                             names=["doc_id", "fp", "text_hash"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("fp", T.LongType()),
                           T.StructField("text_hash", T.LongType())])
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("t"),
                       F.xxhash64(text).alias("text_hash")).mapInArrow(run, schema)


def _as_py(scalar) -> bytes:
    return scalar.as_py()


def block_masks(radius: int = 2, levels: int = LEVELS) -> list[int]:
    """Bit masks by shard path: path 0 is the empty mask, child c of path p is
    ``p * (radius + 1) + c + 1`` and fixes one more block of p's free bits."""
    ways = radius + 1
    masks = [0]
    for p in range(sum(ways ** i for i in range(levels))):
        free = [b for b in range(BITS) if not masks[p] >> b & 1]
        for c in range(ways):
            part = free[len(free) * c // ways:len(free) * (c + 1) // ways]
            masks.append(masks[p] | sum(1 << b for b in part))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Burkhard-Keller tree over integers under the Hamming distance."""

    def __init__(self):
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int) -> None:
        """Insert under the chain of edges equal to the distance to each parent."""
        self.keys.append(key)
        self.children.append({})
        new = len(self.keys) - 1
        if not new:
            return
        at = 0
        while True:
            d = (self.keys[at] ^ key).bit_count()
            nxt = self.children[at].setdefault(d, new)
            if nxt == new:
                return
            at = nxt

    def search(self, key: int, radius: int) -> list[int]:
        """Positions of keys within ``radius``; only edges in [d - r, d + r] are followed."""
        found, stack = [], [0] if self.keys else []
        keys, children = self.keys, self.children
        while stack:
            at = stack.pop()
            d = (keys[at] ^ key).bit_count()
            if d <= radius:
                found.append(at)
            kids = children[at]
            if len(kids) > 2 * radius + 1:
                for e in range(d - radius, d + radius + 1):
                    if e in kids:
                        stack.append(kids[e])
            else:
                for e, child in kids.items():
                    if d - radius <= e <= d + radius:
                        stack.append(child)
        return found


def shard_forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one shard: at most len(fps) - 1 edges."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree, edges = BKTree(), []
    for i, f in enumerate(fps):
        for j in tree.search(f, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                edges.append((f, fps[j]))
        tree.add(f)
    return edges


def shards(fps: DataFrame, radius: int = 2, shard_limit: int = 4096) -> DataFrame:
    """path, value, fp: each distinct fingerprint in the shards it belongs to;
    shards of one fingerprint, which hold no link, are left out."""
    masks = [_signed(m) for m in block_masks(radius)]
    ways = radius + 1

    def deal(df: DataFrame) -> DataFrame:
        kids = [f"named_struct('path', path * {ways} + {c + 1}, 'value', fp & element_at(array("
                + ",".join(f"{m}L" if m != -(1 << 63) else "(-9223372036854775807L - 1L)" for m in masks)
                + f"), path * {ways} + {c + 2}))" for c in range(ways)]
        return df.select("fp", F.expr(f"inline(array({', '.join(kids)}))")).select("path", "value", "fp")

    level = deal(fps.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("value"), "fp"))
    done = None
    for i in range(LEVELS):
        level = materialise(level, "simhash-shards")
        sizes = level.groupBy("path", "value").agg(F.count("*").alias("n")).where("n > 1")
        last = i == LEVELS - 1
        sized = level.join(sizes, ["path", "value"])
        ready = sized if last else sized.where(F.col("n") <= shard_limit)
        ready = ready.select("path", "value", "fp")
        done = ready if done is None else done.unionByName(ready)
        if last or sizes.where(F.col("n") > shard_limit).isEmpty():
            return done
        level = deal(sized.where(F.col("n") > shard_limit).select("path", "value", "fp"))
    return done


def shard_links(sharded: DataFrame, radius: int = 2) -> DataFrame:
    """u, v: a spanning forest of the links of every shard."""
    ship(sharded.sparkSession)

    def run(batches):
        import pyarrow as pa

        key, members = None, []
        out_u: list[int] = []
        out_v: list[int] = []

        def close():
            if len(members) > 1:
                for a, b in shard_forest(members, radius):
                    out_u.append(_signed(a))
                    out_v.append(_signed(b))

        for b in batches:
            for k, v, f in zip(*(c.to_pylist() for c in b.columns)):
                if (k, v) != key:
                    close()
                    key, members = (k, v), []
                members.append(f & 0xFFFFFFFFFFFFFFFF)
            if len(out_u) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])
                out_u.clear()
                out_v.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])

    return (sharded.repartition("path", "value").sortWithinPartitions("path", "value", "fp")
            .mapInArrow(run, "u long, v long").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, by alternating star contraction.

    Each round is a grouped minimum joined back to its edges, so a node with
    many neighbours is never gathered in one task; rounds end when the edge
    set (count and hash sum) no longer changes.
    """

    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")).alias("h")).first()
        return r["n"], r["h"]

    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), "simhash-edges")
    last = state(e)
    if not last[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        # large star: greater neighbours move to the least neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: lesser neighbours and the node itself move to the least one
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        nxt = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = materialise(nxt, "simhash-edges")
        now = state(e)
        if now == last:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        last = now
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
            radius: int = 2, shard_limit: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, fp, text_hash; roots: fp, root, least doc_id of the fingerprint), both stored."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = shard_links(shards(distinct.select("fp"), radius, shard_limit), radius)
    comp = components(links)
    roots = materialise(distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                        .select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    return fps, roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 2, shard_limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps, roots = classes(docs, id_col, text_col, shingle, radius, shard_limit)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and others) with one row of each class: the
    smallest doc_id, nulls last. Rows that go are named by id and text hash, so
    texts are shuffled only where those are too many for a broadcast join;
    repeated rows are folded apart from the rest."""
    columns = docs.columns
    fps, roots = classes(docs, shingle=shingle, radius=radius)
    own = fps.join(roots.select("fp", "root"), "fp").select(
        "root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("key"))
    stays = own.groupBy("root").agg(F.min("key").alias("stays"))
    gone = (own.join(stays, "root").where(~F.col("key").eqNullSafe(F.col("stays")))
            .select(F.col("key.doc_id").alias("_id"), F.col("key.text_hash").alias("_hash")).distinct())
    twice = (fps.groupBy("doc_id", "text_hash").count().where("count > 1")
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))

    def matches(keys):
        return docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == keys["_hash"])

    once = docs.join(gone, matches(gone), "left_anti").join(twice, matches(twice), "left_anti")
    folded = docs.join(gone, matches(gone), "left_anti").join(twice, matches(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*columns).unionByName(folded.select(*columns))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
