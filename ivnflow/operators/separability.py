"""Class separability scores over numeric columns.

All scores but the Euclidean silhouette come from per-class aggregates (counts,
means, variances) joined back to the points as a broadcast of one row per
class, so no pair of points is ever formed. The Euclidean silhouette compares
every point with a bounded set of points, tile by tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_stats(df: DataFrame, cols: list[str], y: str = "y_true") -> DataFrame:
    """Per class: n, mean and population variance of each column."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}")]
    return df.groupBy(y).agg(*aggs)


def fisher_ratio(df: DataFrame, cols: list[str], y: str = "y_true") -> DataFrame:
    """``|mu1 - mu0|^2 / (sum var0 + sum var1 + 1e-12)`` for a binary label."""
    st = class_stats(df, cols, y)
    s0 = st.where(F.col(y) == 0).select(*[F.col(f"_m_{c}").alias(f"a_{c}") for c in cols],
                                        sum((F.col(f"_v_{c}") for c in cols), F.lit(0.0)).alias("va"))
    s1 = st.where(F.col(y) == 1).select(*[F.col(f"_m_{c}").alias(f"b_{c}") for c in cols],
                                        sum((F.col(f"_v_{c}") for c in cols), F.lit(0.0)).alias("vb"))
    num = sum(((F.col(f"b_{c}") - F.col(f"a_{c}")) ** 2 for c in cols), F.lit(0.0))
    return s0.crossJoin(s1).select((num / (F.col("va") + F.col("vb") + F.lit(1e-12))).alias("fisher_ratio"))


def calinski_harabasz(df: DataFrame, cols: list[str], y: str = "y_true") -> DataFrame:
    st = class_stats(df, cols, y)
    tot = df.agg(F.count(F.lit(1)).alias("_ntot"), *[F.avg(c).alias(f"_g_{c}") for c in cols])
    j = st.crossJoin(tot)
    between = F.col("_n") * sum(((F.col(f"_m_{c}") - F.col(f"_g_{c}")) ** 2 for c in cols), F.lit(0.0))
    within = F.col("_n") * sum((F.col(f"_v_{c}") for c in cols), F.lit(0.0))
    a = j.agg(F.sum(between).alias("B"), F.sum(within).alias("W"), F.count(F.lit(1)).alias("k"),
              F.first("_ntot").alias("n"))
    return a.select(F.when((F.col("W") == 0) | (F.col("k") < 2), F.lit(1.0)).otherwise(
        (F.col("B") / (F.col("k") - 1)) / (F.col("W") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, cols: list[str], y: str = "y_true") -> DataFrame:
    st = class_stats(df, cols, y).select(y, *[F.col(f"_m_{c}") for c in cols])
    # one row per class: bounded broadcast
    d = df.join(F.broadcast(st), y).select(y, F.sqrt(sum(
        ((F.col(c) - F.col(f"_m_{c}")) ** 2 for c in cols), F.lit(0.0))).alias("_d"))
    scat = d.groupBy(y).agg(F.avg("_d").alias("_s")).join(st, y)
    a = scat.select(*[F.col(x).alias("a" + x) for x in scat.columns])
    b = scat.select(*[F.col(x).alias("b" + x) for x in scat.columns])
    sep = F.sqrt(sum(((F.col(f"a_m_{c}") - F.col(f"b_m_{c}")) ** 2 for c in cols), F.lit(0.0)))
    r = a.crossJoin(b).where(F.col("a" + y) != F.col("b" + y)).select(
        F.col("a" + y).alias("c"), ((F.col("a_s") + F.col("b_s")) / sep).alias("r"))
    return r.groupBy("c").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def silhouette_sq(df: DataFrame, cols: list[str], y: str = "y_true") -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact.

    The mean squared distance from x to class c is ``|x - mean_c|^2`` plus the
    sum of c's variances (own class: times n / (n - 1)), so one row of class
    means replaces the all-pairs distance matrix, without cancellation for
    data far from 0. Every point is one projection; nothing is shuffled.
    """
    st = class_stats(df, cols, y).select(F.struct(
        F.col(y).alias("c"), F.col("_n").alias("n"), sum((F.col(f"_v_{c}") for c in cols), F.lit(0.0)).alias("v"),
        F.array(*[F.col(f"_m_{c}") for c in cols]).alias("m")).alias("s"))
    # one row with one entry per class
    one = st.agg(F.collect_list("s").alias("_classes"))
    x = F.array(*[F.col(c).cast("double") for c in cols])

    def mean_sq(s):
        sq = F.zip_with(F.col("_x"), s["m"], lambda a, b: (a - b) * (a - b))
        return F.aggregate(sq, F.lit(0.0), lambda acc, d: acc + d) + s["v"]

    own = F.element_at(F.filter("_classes", lambda s: s["c"] == F.col(y)), 1)
    j = df.select(y, x.alias("_x")).crossJoin(F.broadcast(one)).select(
        own["n"].alias("n"), mean_sq(own).alias("d"),
        F.array_min(F.transform(F.filter("_classes", lambda s: s["c"] != F.col(y)), mean_sq)).alias("b"))
    a = F.col("d") * F.col("n") / (F.col("n") - 1)
    s = F.when((F.col("n") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0)))
    return j.agg(F.avg(s).alias("silhouette"))


def silhouette(df: DataFrame, cols: list[str], id_col: str, y: str = "y_true",
               sample_size: int = 10_000) -> DataFrame:
    """Mean silhouette with Euclidean distance over all points.

    Where ``df`` has more than ``sample_size`` rows, a point's mean distance to a
    class is taken over a hash sample of that class: about an equal share of
    ``sample_size`` for each class and at least 32 rows or the whole class, so
    that no class is lost; otherwise the result is exact. The driver holds the
    sample (``sample_size`` or 32 rows a class, whichever is more). A point is
    compared with tiles of the sample and only its distance sums by class are
    kept, so work is rows times sample and memory is one tile.

    A point without another of its class scores 0, as do all points where there
    is one class; null values count as 0; rows with a null label or id are not
    scored; no rows give a null score. Ids are taken to be distinct.
    """
    import numpy as np

    spark = df.sparkSession
    rows = df.where(F.col(y).isNotNull() & F.col(id_col).isNotNull()).select(
        F.xxhash64(F.col(id_col)).alias("_k"), F.col(y).cast("string").alias("_y"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(cols)])
    # one row per class
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(32, sample_size // max(1, len(sizes))) if sum(sizes.values()) > sample_size else max(sizes.values(), default=1)
    parts = spark.createDataFrame([(c, min(1.0, share / n)) for c, n in sizes.items()], "_y string, _part double")
    sample = rows.join(F.broadcast(parts), "_y").where(
        F.pmod("_k", F.lit(1 << 20)) < F.col("_part") * (1 << 20)).select(*rows.columns).toPandas()
    names = sorted(set(sample["_y"]))
    one_hot = np.array([[v == n for n in names] for v in sample["_y"]], dtype=float).reshape(len(sample), len(names))
    held = spark.sparkContext.broadcast((sample["_k"].to_numpy(), names, sample.iloc[:, 2:].to_numpy(dtype=float), one_hot))

    def run(batches):
        import pyarrow as pa

        keys, names, points, one_hot = held.value
        place = {n: k for k, n in enumerate(names)}
        total, count = 0.0, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = part.num_rows
                own = np.array([place.get(v, -1) for v in part.column(1).to_pylist()])
                key = part.column(0).to_numpy()
                x = np.column_stack([part.column(k + 2).to_numpy() for k in range(len(cols))])
                sums, sizes = np.zeros((n, len(names))), np.tile(one_hot.sum(0), (n, 1))
                for lo in range(0, len(points), 2048):
                    tile = points[lo:lo + 2048]
                    sq = np.zeros((n, len(tile)))
                    for k in range(len(cols)):
                        sq += (x[:, k, None] - tile[None, :, k]) ** 2
                    same = key[:, None] == keys[None, lo:lo + 2048]
                    sums += np.where(same, 0.0, np.sqrt(sq)) @ one_hot[lo:lo + 2048]
                    sizes -= same @ one_hot[lo:lo + 2048]
                mean = np.divide(sums, sizes, out=np.full(sums.shape, np.inf), where=sizes > 0)
                known = own >= 0
                a = np.where(known, mean[np.arange(n), own], np.inf)
                mean[np.arange(n)[known], own[known]] = np.inf
                near = mean.min(axis=1)
                ok = np.isfinite(a) & np.isfinite(near) & (np.maximum(a, near) > 0)
                total += ((near[ok] - a[ok]) / np.maximum(a, near)[ok]).sum()
                count += n
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count])], names=["s", "n"])

    return rows.mapInArrow(run, "s double, n long").agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("silhouette"))


def featureset_compare(df: DataFrame, sets: dict[str, list[str]], y: str = "y_true") -> DataFrame:
    out = None
    for name, cols in sets.items():
        r = fisher_ratio(df, cols, y).crossJoin(calinski_harabasz(df, cols, y)) \
            .crossJoin(davies_bouldin(df, cols, y)).select(F.lit(name).alias("feature_set"), "*")
        out = r if out is None else out.unionByName(r)
    return out
