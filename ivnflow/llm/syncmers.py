"""Document fingerprints by closed syncmers (operator 4), DataFrame functions only.

Units are words. A k-mer of ``k`` words is chosen where the smallest hash
among its inner s-mers of ``s`` words lies at its first or last place. The
choice looks at the k-mer alone, so the same passage gives the same anchors
in every text and at every position. A fingerprint is the anchors' hashes in
text order; two are compared by the Jaccard likeness of their anchors, or
place by place (``positional_matches``).

The next document's start is needed to build the edited text. Documents are
dealt out once by ranges of doc_id, each range also receives the head of the
range after it, and ``lead`` finds the next row inside the range: one shuffle
of the texts, no global sort, no single task.

Defined results: null text counts as empty; a text whose k-mers are too few
to choose one has one anchor for all its words, none without words; two texts
without anchors are alike (1.0). Null ids come last in descending order;
repeated ids are ordered by text, and the next of a repeated row is its
copy; an only document is its own next. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, shuffle_width, table, words

K, S = 8, 2


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Closed-syncmer anchors of a text: array<struct<pos, hash>>, pos the k-mer's first word."""
    inner = k - s + 1

    def whole(h):
        one = F.array(F.struct(F.lit(0).alias("pos"), F.hash(h).alias("hash")))
        return F.when(F.size(h) == 0, F.array().cast("array<struct<pos:int,hash:int>>")).otherwise(one)

    def chosen(h):
        smers = h
        for step in range(1, s):
            smers = F.zip_with(smers, F.slice(h, F.lit(1 + step), F.size(h)), lambda a, b: F.xxhash64(a, b))

        def edges(m):
            at = F.sequence(F.lit(1), F.size(h) - k + 1)
            picked = F.filter(at, lambda i: let(F.array_min(F.slice(m, i, F.lit(inner))), lambda low:
                                                (F.element_at(m, i) == low) | (F.element_at(m, i + (inner - 1)) == low)))
            return F.transform(picked, lambda i: F.struct((i - 1).alias("pos"), F.hash(F.slice(h, i, F.lit(k))).alias("hash")))

        return let(smers, edges)

    hashes = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < k, whole(h)).otherwise(
        let(chosen(h), lambda c: F.when(F.size(c) == 0, whole(h)).otherwise(c))))


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """Hashes of a text's anchors in text order."""
    return F.transform(anchors(text, k, s), lambda a: a["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints (arrays of hashes)."""
    def ratio(x, y):
        both = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))

    return let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: ratio(x, y)))


def hex_fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(F.pmod(h.cast("long"), F.lit(1 << 32))), 8, "0"))), "")


def positional_matches(a: Column, b: Column) -> Column:
    """Places (array<struct<pos_a, pos_b>>) where two anchor lists
    (array<struct<pos, hash>>) agree; of equal anchors in ``b`` the first counts."""
    def pairs(m):
        both = F.transform(a, lambda x: F.struct(x["pos"].alias("pos_a"), F.try_element_at(m, x["hash"]).alias("pos_b")))
        return F.filter(both, lambda p: p["pos_b"].isNotNull())

    def firsts(s):
        # sorted by (hash, pos): the first of every hash
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(F.transform(s, lambda x: x["hash"]), F.lit(1), F.size(s)))
        marked = F.zip_with(s, F.slice(before, F.lit(1), F.size(s)), lambda x, h: F.when(~x["hash"].eqNullSafe(h), x))
        return F.map_from_entries(F.array_compact(marked))

    return let(let(F.array_sort(F.transform(b, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos")))), firsts), pairs)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, hashes and next_text, next_hashes of the next row by descending
    doc_id; the last row's next is the first."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    low = F.lit(-(1 << 63)).cast("long")
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                    F.coalesce(F.col(id_col).cast("long"), low).alias("key")).withColumn("at", F.col("key").cast("double"))
    n = 4 * shuffle_width(spark)
    # range bounds, a few per shuffle partition, as a range shuffle samples them
    cuts = t.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n).alias("q"), F.min("at").alias("m")).first()
    if cuts["m"] is None:
        return t.select("doc_id", "text", fingerprint(F.col("text")).alias("hashes"), F.col("text").alias("next_text"),
                        fingerprint(F.col("text")).alias("next_hashes"))
    splits = [float("-inf"), *sorted({q for q in cuts["q"] if q > cuts["m"]}), float("inf")]
    if len(splits) == 2:
        placed = t.withColumn("part", F.lit(0))
    else:
        placed = Bucketizer(splits=splits, inputCol="at", outputCol="part").transform(t).withColumn("part", F.col("part").cast("int"))
    heads = {r["part"]: r["key"] for r in placed.groupBy("part").agg(F.max("key").alias("key")).collect()}  # one per range
    order = sorted(heads, reverse=True)
    # the head of a range is also a guest at the end of the range before it
    host = {heads[order[(i + 1) % len(order)]]: p for i, p in enumerate(order)}
    guest = F.when(F.col("key").isin(list(host)), F.element_at(
        F.map_from_arrays(F.lit(list(host)), F.lit(list(host.values()))), F.col("key")))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    dealt = (placed.withColumn("hashes", fingerprint(F.col("text")))
             .select("doc_id", "text", "hashes", "key", F.explode(F.when(guest.isNull(), F.array(own)).otherwise(
                 F.array(own, F.struct(guest.alias("part"), F.lit(1).alias("guest"))))).alias("to")))
    flat = dealt.select("doc_id", "text", "hashes", "key", F.col("to.part").alias("part"), F.col("to.guest").alias("guest"))
    w = Window.partitionBy("part").orderBy("guest", F.col("key").desc(), F.col("doc_id").desc_nulls_last(), "text")
    after = F.lead(F.struct("text", "hashes")).over(w)  # one window: the texts move once
    return (flat.select("doc_id", "text", "hashes", "guest", after.alias("after")).where("guest = 0")
            .select("doc_id", "text", "hashes", F.col("after.text").alias("next_text"), F.col("after.hashes").alias("next_hashes")))


def edited_text(text: Column, donor: Column) -> Column:
    """The text with its last third replaced by as much of the donor's start."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(donor, F.lit(1), third))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    out = near.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "hashes",
        "next_hashes", fingerprint(F.col("edited")).alias("edited_hashes"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex_fingerprint(F.col("hashes")).alias("fingerprint"),
        hex_fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
