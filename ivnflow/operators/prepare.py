"""Split, sampling, normalisation, filters and class balancing (N*, F*, B*).

Every sample is deterministic: rows are ordered by ``md5(id || '|42')``,
and class cuts use ``mark_first_k`` so no class is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_key, mark_first_k, md5_bucket

HK = "_hk"


def _with_key(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn(HK, hash_key(id_col))


def _class_k(df: DataFrame, label_col: str, k_of_n) -> DataFrame:
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.select(label_col, k_of_n(F.col("n")).cast("long").alias("k"))


def stratified_split(df: DataFrame, id_col: str = "pkt_no", label_col: str = "label",
                     split_col: str = "split", digits: int = 4) -> DataFrame:
    """Exact stratified 50/50 split: per class, the first floor(n/2) rows in
    hash order are 'train', the rest 'test'."""
    d = _with_key(df, id_col)
    k = _class_k(d, label_col, lambda n: F.floor(n / 2))
    m = mark_first_k(d, [label_col], [HK, id_col], md5_bucket(HK, digits), k, "_in")
    return m.withColumn(split_col, F.when(F.col("_in"), F.lit("train")).otherwise(F.lit("test"))) \
        .drop("_in", HK)


def _per_class_cut(df, id_col, label_col, k_fn, digits):
    d = _with_key(df, id_col)
    counts = d.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    k = counts.agg(F.min("n").alias("m")).crossJoin(counts.select(label_col)) \
        .select(label_col, k_fn(F.col("m")).cast("long").alias("k"))
    m = mark_first_k(d, [label_col], [HK, id_col], md5_bucket(HK, digits), k, "_in")
    return m.where("_in").drop("_in", HK)


def balanced_sample(df: DataFrame, id_col: str = "pkt_no", label_col: str = "label",
                    digits: int = 4) -> DataFrame:
    """Downsample every class to n = min over classes, in hash order."""
    return _per_class_cut(df, id_col, label_col, lambda m: m, digits)


def capped_sample(df: DataFrame, cap: int, id_col: str = "pkt_no", label_col: str = "label",
                  digits: int = 4) -> DataFrame:
    """Balanced sample with at most ``cap`` rows per class."""
    return _per_class_cut(df, id_col, label_col, lambda m: F.least(m, F.lit(cap)), digits)


def fraction_sample(df: DataFrame, modulus: int = 10, id_col: str = "pkt_no") -> DataFrame:
    """Deterministic 1/modulus sample: first 8 hex digits of the row hash."""
    h = F.conv(F.substr(hash_key(id_col), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return df.where(F.pmod(h, F.lit(modulus)) == 0)


def shuffle_order(df: DataFrame, id_col: str = "pkt_no") -> DataFrame:
    """Reproducible pseudo-random row order."""
    return df.orderBy(hash_key(id_col), F.col(id_col))


# ---- Min-Max ------------------------------------------------------------------

def minmax_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table with ``<c>_min`` / ``<c>_max``. NaN is skipped as pandas does."""
    aggs = []
    for c in cols:
        x = F.when(~F.isnan(F.col(c)), F.col(c))
        aggs += [F.min(x).alias(c + "_min"), F.max(x).alias(c + "_max")]
    return df.agg(*aggs)


def minmax_apply(df: DataFrame, stats: DataFrame, cols: list[str], clip: bool = True,
                 suffix: str = "_norm") -> DataFrame:
    """``(x - min) / (max - min)``; constant column -> 0.0; optional clip to [0, 1].

    ``stats`` is one row, so the broadcast is bounded.
    """
    j = df.crossJoin(F.broadcast(stats))
    out = []
    for c in cols:
        mn, mx = F.col(c + "_min"), F.col(c + "_max")
        v = (F.col(c) - mn) / (mx - mn)
        if clip:
            # null and NaN stay as they are
            v = F.when(v.isNull() | F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
        out.append(F.when(mx - mn == 0, F.lit(0.0)).otherwise(v).alias(c + suffix))
    return j.select(*df.columns, *out)


def stats_long(stats: DataFrame, cols: list[str]) -> DataFrame:
    """Min/max table in long form: (feature, x_min, x_max)."""
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c + "_min").cast("double").alias("x_min"),
                 F.col(c + "_max").cast("double").alias("x_max")) for c in cols])).alias("s")
    ).select("s.*")


# ---- filters and projections --------------------------------------------------

def benign(df: DataFrame, label_col: str = "label_str", hex_col: str = "payload_hex") -> DataFrame:
    return df.where((F.lower(F.col(label_col)) == "normal") & F.col(hex_col).isNotNull())


def class_mask(df: DataFrame, value: int, label_col: str = "label") -> DataFrame:
    return df.where(F.col(label_col) == value)


def available_columns(df: DataFrame, preferred: list[str], fallback: list[str]) -> list[str]:
    """Normalised columns when all present, else the raw ones (schema check only)."""
    return preferred if all(c in df.columns for c in preferred) else fallback


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=cols)


def predict_at(score: Column | str, t: float) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (s >= F.lit(t)).cast("int")


def rescale_scores(df: DataFrame, score_col: str, out_col: str = "score") -> DataFrame:
    """``(s - min) / (max - min + 1e-12)`` for models that give raw scores."""
    st = df.agg(F.min(score_col).alias("_smin"), F.max(score_col).alias("_smax"))
    return df.crossJoin(F.broadcast(st)).withColumn(
        out_col, (F.col(score_col) - F.col("_smin")) /
        (F.col("_smax") - F.col("_smin") + F.lit(1e-12))).drop("_smin", "_smax")


# ---- class balancing ----------------------------------------------------------

def class_weight(df: DataFrame, label_col: str = "label") -> DataFrame:
    """n_normal / n_attack, the weight given to positive rows."""
    return df.agg(F.sum(F.when(F.col(label_col) == 0, 1).otherwise(0)).cast("long").alias("n_normal"),
                  F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("long").alias("n_attack")) \
        .withColumn("weight", F.try_divide(F.col("n_normal").cast("double"), F.col("n_attack")))


def with_weight(df: DataFrame, label_col: str = "label", weight_col: str = "weight") -> DataFrame:
    w = class_weight(df, label_col).select(F.col("weight").alias("_w"))
    return df.crossJoin(F.broadcast(w)).withColumn(
        weight_col, F.when(F.col(label_col) == 1, F.col("_w")).otherwise(F.lit(1.0))).drop("_w")


def augment_counts(df: DataFrame, ratio: float = 1.0, target: str = "balance",
                   label_col: str = "label") -> DataFrame:
    """Rows to add to the positive class: ``int(n0 * ratio) - n1`` ('balance')
    or ``n0`` ('paper'); never negative (no-op when already balanced)."""
    c = class_weight(df, label_col).drop("weight")
    need = (F.floor(F.col("n_normal") * F.lit(ratio)).cast("long") - F.col("n_attack")) \
        if target == "balance" else F.col("n_normal")
    return c.withColumn("n_needed", F.greatest(need, F.lit(0)).cast("long")) \
        .withColumn("n_attack_after", F.col("n_attack") + F.col("n_needed"))


def replicate(df: DataFrame, copies: int, copy_col: str = "copy_no", chunk: int = 1024) -> DataFrame:
    """Rows repeated ``copies`` times with ``copy_col`` = 1..copies.

    Large factors are generated in two steps (chunk ids first, spread by a
    shuffle, then the copies of each chunk), so one input row never makes
    millions of rows inside a single task.
    """
    if copies <= 0:
        return df.withColumn(copy_col, F.lit(1)).limit(0)
    if copies <= chunk:
        return df.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.lit(copies))))
    n_chunks = (copies + chunk - 1) // chunk
    c = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))) \
        .repartition("_chunk")
    lo = F.col("_chunk") * chunk + 1
    return c.withColumn(copy_col, F.explode(F.sequence(lo, F.least(lo + chunk - 1, F.lit(copies))))) \
        .drop("_chunk")


def extra_copies(rows: DataFrame, n_rows: int, need: int, id_col: str = "pkt_no",
                 copy_col: str = "copy_no") -> DataFrame:
    """``need`` further rows made of the ``n_rows`` rows of one class, in hash order.

    With ``c = ceil(need / n_rows)`` copies, copies 1..c-1 are kept whole and
    only copy c is cut, so the exact rank cut runs over these rows alone.
    """
    copies = -(-need // n_rows)
    whole = replicate(rows, copies - 1, copy_col)
    k = rows.sparkSession.range(1).select(F.lit(need - n_rows * (copies - 1)).alias("k"))
    last = mark_first_k(rows.withColumn(HK, hash_key(id_col)), [], [HK, id_col],
                        md5_bucket(HK, 4), k, "_in") \
        .where("_in").drop("_in", HK).withColumn(copy_col, F.lit(copies))
    return whole.unionByName(last)


def augment_positive(df: DataFrame, ratio: float = 1.0, target: str = "balance", id_col: str = "pkt_no",
                     label_col: str = "label", copy_col: str = "copy_no") -> DataFrame:
    """``df`` plus the positive rows that ``augment_counts`` asks for, as copies of
    positive rows in hash order; originals keep ``copy_no = 0``. Without positive
    rows, or when none are needed, only the originals."""
    c = augment_counts(df, ratio, target, label_col).first()
    base = df.withColumn(copy_col, F.lit(0))
    if not c["n_needed"] or not c["n_attack"]:
        return base
    return base.unionByName(extra_copies(df.where(F.col(label_col) == 1), int(c["n_attack"]),
                                         int(c["n_needed"]), id_col, copy_col))


def oversample_minority(df: DataFrame, id_col: str = "pkt_no", label_col: str = "label",
                        copy_col: str = "copy_no") -> DataFrame:
    """Replicate the minority class (in hash order) up to the majority count.

    Originals keep ``copy_no = 0``; see ``extra_copies`` for the others.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    mm = counts.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"),
                    F.min_by(label_col, F.struct("n", label_col)).alias("_minority")).first()
    base = df.withColumn(copy_col, F.lit(0))
    need = int(mm["n_max"] - mm["n_min"]) if mm["n_min"] else 0
    if need <= 0:
        return base
    minority = df.where(F.col(label_col) == mm["_minority"])
    return base.unionByName(extra_copies(minority, int(mm["n_min"]), need, id_col, copy_col))
