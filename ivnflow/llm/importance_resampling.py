"""Target-distribution importance resampling (operator 12): array-scored weights,
then a distributed LSD radix sort.

Features of a text (runs of consecutive words) fall into buckets by CRC-32.
Bucket counts of the corpus and of the target texts give a gain per bucket, an
array of ``buckets`` integers whatever the corpus; a document's weight is the
sum of its features' gains, looked up in that array. Weight plus seeded Gumbel
noise is the score, so that the highest scores are a sample without
replacement in proportion to exp(weight).

The rank comes from a least-significant-digit radix sort of (score falling,
id rising), packed in one number where it fits. A pass is a stable counting
sort by one digit: rows lie in blocks of ``BLOCK_ROWS`` positions, counts by
(digit, block) with prefix sums over them give each pair's offset, and a row
goes to the offset plus its number within the pair. A pass shuffles numbers
only, a pair holds a block's rows at most, and no task sees a whole digit.

Defined results: null and empty texts have no features and weight 0; rows of
fewer than ``min_words`` words are scored and never drawn; repeated rows are
ranked one by one, ties of score and id in file order; a null id is noted as
an empty one in the noise and comes last among ties; an empty corpus gives an
empty result, an empty target only lowers the gains; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, ship, table

BUCKETS = 10_000
DIGIT_BITS = 12
BLOCK_ROWS = 1 << 20
#: Words whose buckets a worker remembers before it starts anew.
MEMO_WORDS = 1_000_000
#: Separators become spaces, A-Z become a-z, all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z folded."""
    return raw.translate(_FOLD).split()


class BucketMemo(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        import zlib

        b = zlib.crc32(feature) % self.buckets
        if len(self) < MEMO_WORDS:
            self[feature] = b
        return b


def feature_buckets(raw: bytes, memo: BucketMemo, longest_run: int):
    """(buckets of all features as an array, number of words)."""
    import numpy as np

    words = words_of(raw)
    features = list(words)
    for k in range(2, longest_run + 1):
        features += [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    return np.fromiter(map(memo.__getitem__, features), np.int64, len(features)), len(words)


def bucket_counts(texts: DataFrame, buckets: int, longest_run: int, text_col: str = "text") -> list[int]:
    """Features per bucket over all texts: one array a task, summed by Spark; at
    most ``buckets`` rows reach the driver."""
    ship(texts.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memo, total = BucketMemo(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for v in b.column(0).cast(pa.binary()):
                raw = v.as_py()
                if raw:
                    total += np.bincount(feature_buckets(raw, memo, longest_run)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counts = [0] * buckets
    rows = texts.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: list[int], target: list[int], scale: int = 1000) -> list[int]:
    """floor(scale * ln of the smoothed ratio of target to source share) per bucket."""
    m, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(scale * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m)))) for s, t in zip(source, target)]


def weighted(docs: DataFrame, gains: list[int], longest_run: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight per row of ``docs``."""
    ship(docs.sparkSession)
    buckets, kind = len(gains), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memo, gain = BucketMemo(buckets), np.array(gains, np.int64)
        for b in batches:
            out = []
            for v in b.column(1).cast(pa.binary()):
                at, n = feature_buckets(v.as_py() or b"", memo, longest_run)
                out.append((len(at), n, int(gain[at].sum())))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"doc_id {kind}, n_features long, n_words long, weight long")


def gumbel(id_col: Column, seed: int = 2024, scale: int = 1000) -> Column:
    """Seeded Gumbel noise of an id, scaled and floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def counting_pass(rows: DataFrame, digit: Column, digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (at and others) with ``at`` moved to the row's place in the stable
    order of ``digit``; the new places count from 0 without gaps."""
    others = [c for c in rows.columns if c != "at"]
    r = rows.withColumn("digit", digit.cast("int")).withColumn("block", F.shiftright("at", int(math.log2(block_rows))))
    counts = r.groupBy("digit", "block").agg(F.count("*").alias("n"))
    # at most 2**digit_bits rows
    totals = counts.groupBy("digit").agg(F.sum("n").alias("all"))
    digits = totals.select("digit", (F.sum("all").over(Window.orderBy("digit")) - F.col("all")).alias("digit_at"))
    before = Window.partitionBy("digit").orderBy("block")
    offsets = counts.select("digit", "block", (F.sum("n").over(before) - F.col("n")).alias("block_at")).join(
        F.broadcast(digits), "digit").select("digit", "block", (F.col("digit_at") + F.col("block_at")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("digit", "block").orderBy("at")) - 1
    return (r.withColumn("k", within).join(offsets, ["digit", "block"])
            .select(*others, (F.col("offset") + F.col("k")).cast("long").alias("at")))


def radix_ranks(rows: DataFrame, digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row, at: the place (from 0) of each row (row, score, doc_id) by score
    falling, then id rising (null last), then row."""
    edge = rows.agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.min("doc_id").alias("first"),
                    F.max("doc_id").alias("last")).first()
    if edge["hi"] is None:
        return rows.select("row", F.lit(0).cast("long").alias("at")).limit(0)
    score = (F.lit(edge["hi"]) - F.col("score")).cast("long")
    score_bits = (edge["hi"] - edge["lo"]).bit_length()
    first, last = (edge["first"] or 0), (edge["last"] or 0)
    spread = last - first
    if spread < (1 << 62):
        ident = F.coalesce(F.col("doc_id").cast("long") - F.lit(first), F.lit(spread + 1)).cast("long")
        id_bits = (spread + 1).bit_length()
        keys = [(ident, id_bits), (score, score_bits)]
    else:  # ids over the whole range: as unsigned numbers, nulls by a digit of their own
        ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
        keys = [(ident, 64), (F.col("doc_id").isNull().cast("long"), 1), (score, score_bits)]
    if len(keys) == 2 and id_bits + score_bits <= 62:
        keys = [(F.shiftleft(score, id_bits).bitwiseOR(ident), id_bits + score_bits)]
    at = materialise(rows.select("row", F.col("row").alias("at"), *(k.alias(f"key{i}") for i, (k, _) in enumerate(keys))), "radix-0")
    for i, (_, bits) in enumerate(keys):
        for low in range(0, bits, digit_bits):
            digit = F.shiftrightunsigned(f"key{i}", low).bitwiseAND(F.lit((1 << digit_bits) - 1).cast("long"))
            at = materialise(counting_pass(at, digit, digit_bits, block_rows), "radix-pass")
    return at.select("row", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest_run: int = 1,
             buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank (null where not drawn) per row of ``docs``."""
    gains = bucket_gains(bucket_counts(docs, buckets, longest_run, text_col),
                         bucket_counts(target, buckets, longest_run, target_col))
    scored = materialise(weighted(docs, gains, longest_run, id_col, text_col).withColumn(
        "score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    eligible = scored.where(F.col("n_words") >= min_words)
    drawn = eligible.count() * percent // 100
    ranks = radix_ranks(eligible.select("row", "score", "doc_id"), digit_bits, block_rows).where(F.col("at") < drawn).select(
        "row", (F.col("at") + 1).alias("rank"))
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "n_words", "weight", "score", "rank")


def op12_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS_SQL = (r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

#: The same rows in DuckDB; CRC-32 is worked out per distinct word from its bytes.
OP12_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS_SQL.format('text')}, []) as ws from documents),
w as (select rid, unnest(ws) as w from d),
b as (select unnest(coalesce({_WORDS_SQL.format('text')}, [])) as w from benchmark),
crc as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t
), vocab as (
  select w, list_transform(range(1, 2 * strlen(w), 2), lambda i: ('0x' || substr(hex(w), i, 2))::bigint) as bytes
  from (select w from w union select w from b)
), f as (
  select w, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x:
    xor(t[(xor(c, x) & 255) + 1], c >> 8))) % {BUCKETS} as bucket from vocab, crc
), s as (select bucket, count(*) as n from w join f using (w) group by bucket),
t as (select bucket, count(*) as n from b join f using (w) group by bucket),
g as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {BUCKETS})::double
    / ((s.n + 1)::double * ((select coalesce(sum(n), 0) from t) + {BUCKETS})::double)))::bigint as gain
  from s left join t using (bucket)
), x as (select rid, sum(gain)::bigint as weight from w join f using (w) join g using (bucket) group by rid),
y as (
  select rid, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5)::double
      / 4294967296)))::bigint as score
  from d left join x using (rid)
), z as (
  select rid, row_number() over (order by score desc, doc_id nulls last, rid) as k, count(*) over () as n from y where n_features >= 20
)
select doc_id, n_features, weight, score, case when k <= n * 10 // 100 then k end::bigint as rank from y left join z using (rid)
"""
