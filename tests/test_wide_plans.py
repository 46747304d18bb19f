"""Plans that replaced row expansion, self-joins and fixed buckets."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from ivnflow.operators import evaluate as ev
from ivnflow.operators import models as md
from ivnflow.operators import profile as pr
from ivnflow.operators import separability as sp
from ivnflow.streaming import telemetry as tm


def test_running_totals_of_saturated_scores(spark):
    rng = random.Random(7)
    vals = sorted({1 / (1 + math.exp(-rng.gauss(6, 2))) for _ in range(20000)}, reverse=True)
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "score double, pos long")
    got = ev.running_totals(df, "score", ["pos"], total_prefix="all_").orderBy(F.desc("score")).collect()
    total, want = 0, []
    for i in range(len(vals)):
        total += i % 3
        want.append(total)
    assert [r["cum_pos"] for r in got] == want
    assert {r["all_pos"] for r in got} == {total}
    # ranges of near-equal size, though most scores are close to 1
    sizes = df.repartitionByRange(8, F.desc("score")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * len(vals) / 8


def test_running_totals_within_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 5), ("b", 2.0, 7), ("b", -1.0, 1)], "k string, v double, n long")
    got = {(r["k"], r["v"]): r["cum_n"] for r in ev.running_totals(df, "v", ["n"], descending=False, within=["k"]).collect()}
    assert got == {("a", 1.0): 2, ("a", 3.0): 7, ("b", -1.0): 1, ("b", 2.0): 8}


def test_auc_of_large_counts(spark, monkeypatch):
    n = 4_000_000_000
    table = spark.createDataFrame([(0.9, n // 2, 0), (0.5, n // 2, n // 2), (0.1, 0, n // 2)],
                                  "score double, pos long, neg long")
    monkeypatch.setattr(ev, "score_table", lambda df, y, s: df)
    assert abs(ev.roc_auc(table).first()["roc_auc"] - 0.875) < 1e-12


def test_describe_with_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (2.0, None), (9.0, None)], "a double, b double")
    got = {r["feature"]: r for r in pr.describe(df, ["a", "b"]).collect()}
    want = pd.Series([1.0, 2.0, 2.0, 9.0]).describe()
    assert [got["a"][c] for c in ("count", "mean", "min", "p25", "p50", "p75", "max")] == [
        want[c] for c in ("count", "mean", "min", "25%", "50%", "75%", "max")]
    assert got["b"]["count"] == 0 and got["b"]["p50"] is None
    assert {r["count"] for r in pr.describe(df.limit(0), ["a", "b"]).collect()} == {0}


def test_naive_bayes_keeps_repeated_ids(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (1, 0.2, 0), (2, 1.0, 1), (2, 1.3, 1)], "id long, x double, label int")
    s = md.gaussian_nb_score(df, md.gaussian_nb_fit(df, ["x"]), ["x"], "id")
    assert s.count() == 4
    assert all((r["y_prob"] > 0.5) == (r["y_true"] == 1) for r in s.collect())


def test_silhouette_far_from_zero(spark):
    pts = [(1e8 + 0.0, 0), (1e8 + 1.0, 0), (1e8 + 10.0, 1), (1e8 + 12.0, 1), (1e8 + 30.0, 2)]
    df = spark.createDataFrame(pts, "x double, y_true int")
    want = []
    for i, (x, c) in enumerate(pts):
        own = [(x - v) ** 2 for j, (v, k) in enumerate(pts) if k == c and j != i]
        other = min(sum((x - v) ** 2 for v, k in pts if k == o) / sum(k == o for _, k in pts) for o in {0, 1, 2} - {c})
        a = sum(own) / len(own) if own else 0.0
        want.append((other - a) / max(a, other) if own else 0.0)
    assert abs(sp.silhouette_sq(df, ["x"]).first()["silhouette"] - sum(want) / len(want)) < 1e-9


def test_rate_history_across_chunks(spark):
    times = {0: 1, 3: 4, 4: 2, 11: 5}
    rates = spark.createDataFrame([("s", 10 * t, n) for t, n in times.items()], "service string, window_start long, n long")
    got = {r["window_start"]: r["history"] for r in tm.rate_history(rates, 10, 4, chunk=3).collect()}
    assert got == {10 * t: [times.get(u, 0) for u in range(max(0, t - 3), t + 1)] for t in range(12)}


def test_euclidean_silhouette(spark):
    import math
    rows = [(k, k % 3 if k < 40 else 7, float(k % 5), 100.0 * (k % 3) + k) for k in range(41)]
    df = spark.createDataFrame(rows + [(99, None, 1.0, 1.0)], "id long, y_true int, a double, b double")

    def brute(i):
        def mean(c):
            d = [math.dist(i[2:], r[2:]) for r in rows if r[1] == c and r[0] != i[0]]
            return sum(d) / len(d) if d else None
        a, b = mean(i[1]), min(mean(c) for c in {r[1] for r in rows} - {i[1]})
        return 0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b)

    want = sum(map(brute, rows)) / len(rows)
    got = sp.silhouette(df, ["a", "b"], "id").first()[0]
    assert abs(got - want) < 1e-12
    # fewer points than rows: no class is lost, the lone row of class 7 included
    many = spark.createDataFrame([(k, 7 if k == 600 else k % 3, float(k % 5), 100.0 * (k % 3) + k % 97) for k in range(601)],
                                 df.schema)
    whole, part = (sp.silhouette(many, ["a", "b"], "id", sample_size=n).first()[0] for n in (1000, 130))
    assert abs(part - whole) < 0.1
    assert sp.silhouette(df.where("false"), ["a", "b"], "id").first()[0] is None
    assert sp.silhouette(df.where("y_true = 1"), ["a", "b"], "id").first()[0] == 0.0
    same = df.where("y_true is not null").withColumn("a", sp.F.lit(1.0)).withColumn("b", sp.F.lit(2.0))
    assert sp.silhouette(same, ["a", "b"], "id").first()[0] == 0.0
