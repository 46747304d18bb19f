"""Queries: evaluation metrics, curves and threshold search on ``scored`` (E*, F8, F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.prepare import balanced_sample, predict_at, rescale_scores
from ..operators.sampling import hash_key
from ..schemas import PAPER_METRICS, PAPER_THRESHOLD, PAPER_TOLERANCE, THRESHOLD_LIST
from ..sources.fixtures import scored
from .catalog import register

R = 6
T = PAPER_THRESHOLD


def rnd(df, cols, r=R):
    return df.select(*[F.round(c, r).alias(c) if c in cols else F.col(c) for c in df.columns])


def _t(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


# ---- DuckDB building blocks ------------------------------------------------------

def duck_counts(src: str, t: str) -> str:
    return f"""
  CAST(sum(CASE WHEN y_true <> 1 AND y_prob < {t} THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN y_true <> 1 AND y_prob >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y_true = 1 AND y_prob < {t} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y_true = 1 AND y_prob >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM {src}"""


def duck_prf(r=R) -> str:
    return f"""
  round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0e0), {r}) AS precision,
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0e0), {r}) AS recall,
  round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0e0), {r}) AS f1"""


def duck_curve(src: str) -> str:
    """Per distinct score (descending) running tp/fp, via a plain window."""
    return f"""
sc_g AS (SELECT y_prob AS score, CAST(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM {src} GROUP BY y_prob),
sc_c AS (SELECT score, pos, neg,
         sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
         sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
         sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc_g)"""


def duck_auc(src: str) -> str:
    """Mann-Whitney with average ranks (independent of the trapezoid form)."""
    return f"""
au_g AS (SELECT y_prob, count(*) AS cnt, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos
         FROM {src} GROUP BY y_prob),
au_r AS (SELECT pos, cnt, coalesce(sum(cnt) OVER (ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0) + (cnt + 1) / 2.0e0 AS avg_rank FROM au_g),
au AS (SELECT (sum(pos * avg_rank) - sum(pos) * (sum(pos) + 1) / 2.0e0)
              / (CAST(sum(pos) AS DOUBLE) * (sum(cnt) - sum(pos))) AS roc_auc FROM au_r)"""


def duck_ap() -> str:
    return """
ap AS (SELECT sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(P) AS average_precision FROM sc_c)"""


def duck_grid(n: int, start: float, step: float) -> str:
    return (f"SELECT CAST(i AS INTEGER) AS i, {_t(start)} + i * (({_t(start)} + {_t(step)}) - {_t(start)}) "
            f"AS threshold FROM range(0, {n}) r(i)")


def duck_sweep(src: str, grid: str) -> str:
    return f"""
gr AS ({grid}),
sw AS (SELECT g.i, g.threshold,
  CAST(sum(CASE WHEN s.y_true = 1 AND s.y_prob >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN s.y_true <> 1 AND s.y_prob >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN s.y_true = 1 AND s.y_prob < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM gr g CROSS JOIN {src} s GROUP BY g.i, g.threshold),
swf AS (SELECT i, threshold, tp, fp, fn,
  coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0e0) AS f1 FROM sw)"""


DUCK_BEST = """
SELECT coalesce((SELECT threshold FROM swf WHERE f1 > 0 ORDER BY f1 DESC, i LIMIT 1), 0.5e0) AS threshold,
       coalesce((SELECT f1 FROM swf WHERE f1 > 0 ORDER BY f1 DESC, i LIMIT 1), 0.0e0) AS f1"""

DUCK_BALANCED_SCORED = """
bs_r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id) AS rn
         FROM scored),
bs AS (SELECT row_id, y_true, y_prob FROM bs_r
       WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM scored GROUP BY y_true)))"""


# ---- E1, E2, E15, F8 -------------------------------------------------------------

@register("q_confusion", views=("scored",), sql=f"SELECT {duck_counts('scored', _t(T))}")
def q_confusion(spark, sf):
    return ev.confusion(scored(spark, sf), T)


@register("q_prf", views=("scored",), sql=f"""
WITH c AS (SELECT {duck_counts('scored', _t(T))})
SELECT tn, fp, fn, tp, {duck_prf()} FROM c""")
def q_prf(spark, sf):
    return rnd(ev.prf(scored(spark, sf), T), ["precision", "recall", "f1"])


@register("q_accuracy", views=("scored",), sql=f"""
WITH c AS (SELECT {duck_counts('scored', _t(T))})
SELECT round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), {R}) AS accuracy FROM c""")
def q_accuracy(spark, sf):
    return rnd(ev.accuracy(scored(spark, sf), T), ["accuracy"])


@register("q_threshold_predict", views=("scored",), sql=f"""
SELECT row_id, CAST(y_prob >= {_t(T)} AS INTEGER) AS y_pred FROM scored""")
def q_threshold_predict(spark, sf):
    return scored(spark, sf).select("row_id", predict_at("y_prob", T).alias("y_pred"))


@register("q_score_rescale", views=("scored",), sql=f"""
SELECT row_id, round((y_prob - min(y_prob) OVER ()) / (max(y_prob) OVER () - min(y_prob) OVER () + 1e-12), {R})
  AS score FROM scored""")
def q_score_rescale(spark, sf):
    return rnd(rescale_scores(scored(spark, sf), "y_prob").select("row_id", "score"), ["score"])


# ---- E3-E7 -------------------------------------------------------------------------

@register("q_roc_auc", views=("scored",), sql=f"""
WITH {duck_auc('scored')} SELECT round(roc_auc, {R}) AS roc_auc FROM au""")
def q_roc_auc(spark, sf):
    return rnd(ev.roc_auc(scored(spark, sf)), ["roc_auc"])


@register("q_average_precision", views=("scored",), sql=f"""
WITH {duck_curve('scored')}, {duck_ap()}
SELECT round(average_precision, {R}) AS average_precision FROM ap""")
def q_average_precision(spark, sf):
    return rnd(ev.average_precision(scored(spark, sf)), ["average_precision"])


@register("q_roc_curve", views=("scored",), sql=f"""
WITH {duck_curve('scored')}
SELECT score AS threshold, round(fp / CAST(N AS DOUBLE), {R}) AS fpr, round(tp / CAST(P AS DOUBLE), {R}) AS tpr
FROM sc_c""")
def q_roc_curve(spark, sf):
    return rnd(ev.roc_curve(scored(spark, sf)), ["fpr", "tpr"])


@register("q_pr_curve", views=("scored",), sql=f"""
WITH {duck_curve('scored')}
SELECT score AS threshold, round(tp / CAST(tp + fp AS DOUBLE), {R}) AS precision,
       round(tp / CAST(P AS DOUBLE), {R}) AS recall FROM sc_c""")
def q_pr_curve(spark, sf):
    return rnd(ev.pr_curve(scored(spark, sf)), ["precision", "recall"])


@register("q_det_curve", views=("scored",), sql=f"""
WITH {duck_curve('scored')}
SELECT score AS threshold, round(fp / CAST(N AS DOUBLE), {R}) AS fpr,
       round((P - tp) / CAST(P AS DOUBLE), {R}) AS fnr FROM sc_c""")
def q_det_curve(spark, sf):
    return rnd(ev.det_curve(scored(spark, sf)), ["fpr", "fnr"])


# ---- E8-E11 ------------------------------------------------------------------------

COARSE = ev.arange(0.01, 0.99, 0.01)
FINE = ev.arange(0.01, 0.99, 0.005)


@register("q_threshold_sweep", views=("scored",), sql=f"""
WITH {duck_sweep('scored', duck_grid(len(COARSE), 0.01, 0.01))}
SELECT round(threshold, 4) AS threshold, round(f1, {R}) AS f1 FROM ({DUCK_BEST})""")
def q_threshold_sweep(spark, sf):
    b = ev.best_threshold(scored(spark, sf), COARSE)
    return b.select(F.round("threshold", 4).alias("threshold"), F.round("f1", R).alias("f1"))


@register("q_f1_curve", views=("scored",), sql=f"""
WITH {duck_sweep('scored', duck_grid(len(FINE), 0.01, 0.005))}
SELECT i, round(threshold, {R}) AS threshold, round(f1, {R}) AS f1 FROM swf""")
def q_f1_curve(spark, sf):
    c = ev.f1_curve(scored(spark, sf), FINE)
    return c.select("i", F.round("threshold", R).alias("threshold"), F.round("f1", R).alias("f1"))


_TLIST = " UNION ALL ".join(f"SELECT {i} AS i, {_t(t)} AS threshold" for i, t in enumerate(THRESHOLD_LIST))


@register("q_threshold_list", views=("scored",), sql=f"""
WITH {duck_sweep('scored', _TLIST)}
SELECT round(threshold, 4) AS threshold, {duck_prf()} FROM swf""")
def q_threshold_list(spark, sf):
    c = ev.threshold_counts(scored(spark, sf), THRESHOLD_LIST)
    return rnd(c.select(F.round("threshold", 4).alias("threshold"), *ev.prf_cols()),
               ["precision", "recall", "f1"])


def _halves(df):
    h = F.substr(hash_key("row_id"), F.lit(1), F.lit(1)) < F.lit("8")
    return df.where(h), df.where(~h)


DUCK_HALVES = """
tr AS (SELECT * FROM scored WHERE substr(md5(CAST(row_id AS VARCHAR) || '|42'), 1, 1) < '8'),
te AS (SELECT * FROM scored WHERE NOT (substr(md5(CAST(row_id AS VARCHAR) || '|42'), 1, 1) < '8'))"""


def _duck_best_on(src: str, name: str) -> str:
    sw = duck_sweep(src, duck_grid(len(COARSE), 0.01, 0.01)).replace("gr AS", f"gr_{name} AS") \
        .replace("sw AS", f"sw_{name} AS").replace("swf AS", f"swf_{name} AS") \
        .replace("FROM gr g", f"FROM gr_{name} g").replace("FROM sw)", f"FROM sw_{name})")
    return sw + f""",
best_{name} AS (SELECT coalesce((SELECT threshold FROM swf_{name} WHERE f1 > 0 ORDER BY f1 DESC, i LIMIT 1), 0.5e0)
  AS threshold)"""


@register("q_threshold_ceiling", views=("scored",), sql=f"""
WITH {DUCK_HALVES}, {_duck_best_on('tr', 'tr')}, {_duck_best_on('te', 'te')},
cand AS (SELECT 'train_best' AS source, threshold FROM best_tr
         UNION ALL SELECT 'test_best', threshold FROM best_te
         UNION ALL SELECT 'paper', {_t(T)}),
cc AS (SELECT c.source, c.threshold,
  CAST(sum(CASE WHEN s.y_true = 1 AND s.y_prob >= c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN s.y_true <> 1 AND s.y_prob >= c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN s.y_true = 1 AND s.y_prob < c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM cand c CROSS JOIN te s GROUP BY c.source, c.threshold)
SELECT source, round(threshold, 4) AS threshold, {duck_prf()} FROM cc""")
def q_threshold_ceiling(spark, sf):
    tr, te = _halves(scored(spark, sf))
    bt = ev.best_threshold(tr, COARSE).select(F.lit("train_best").alias("source"), "threshold")
    bx = ev.best_threshold(te, COARSE).select(F.lit("test_best").alias("source"), "threshold")
    pp = spark.range(1).select(F.lit("paper").alias("source"), F.lit(T).alias("threshold"))
    cand = bt.unionByName(bx).unionByName(pp)
    found = cand.collect()  # three rows
    # one counting pass for all thresholds, on a grid in ascending order
    grid = sorted({float(r["threshold"]) for r in found})
    counts = ev.threshold_counts(te, grid)
    names = spark.createDataFrame([(r["source"], grid.index(float(r["threshold"]))) for r in found], "source string, i int")
    cc = counts.join(F.broadcast(names), "i")
    return rnd(cc.select("source", F.round("threshold", 4).alias("threshold"), *ev.prf_cols()),
               ["precision", "recall", "f1"])


# ---- E12-E14 -----------------------------------------------------------------------

def scenarios(spark, sf):
    s = scored(spark, sf)
    bal = balanced_sample(s, "row_id", "y_true")
    return ev.scenario_metrics(s, T, "imbalanced").unionByName(
        ev.scenario_metrics(bal, T, "balanced"))


def _duck_scenario(src: str, name: str) -> str:
    return f"""
SELECT '{name}' AS scenario, {_t(T)} AS threshold, precision, recall, f1, pr_auc, roc_auc FROM (
  WITH c AS (SELECT {duck_counts(src, _t(T))}), {duck_curve(src)}, {duck_ap()}, {duck_auc(src)}
  SELECT {duck_prf(12)}, (SELECT average_precision FROM ap) AS pr_auc, (SELECT roc_auc FROM au) AS roc_auc
  FROM c)"""


SCEN_METRICS = ["precision", "recall", "f1", "pr_auc", "roc_auc"]

DUCK_SCENARIOS = f"""
{DUCK_BALANCED_SCORED},
scen AS ({_duck_scenario('scored', 'imbalanced')} UNION ALL {_duck_scenario('bs', 'balanced')})"""


@register("q_scenarios", views=("scored",), sql=f"""
WITH {DUCK_SCENARIOS}
SELECT scenario, threshold, {', '.join(f'round({m}, {R}) AS {m}' for m in SCEN_METRICS)} FROM scen""")
def q_scenarios(spark, sf):
    return rnd(scenarios(spark, sf), SCEN_METRICS)


_PAPER = " UNION ALL ".join(
    f"SELECT '{s}' AS scenario, '{m}' AS metric, {_t(v)} AS expected"
    for s, *vals in PAPER_METRICS for m, v in zip(SCEN_METRICS, vals))


@register("q_metric_delta", views=("scored",), sql=f"""
WITH {DUCK_SCENARIOS},
lng AS (UNPIVOT scen ON precision, recall, f1, pr_auc, roc_auc INTO NAME metric VALUE obtained),
paper AS ({_PAPER})
SELECT l.scenario, l.metric, round(obtained, {R}) AS obtained, expected,
       round(obtained - expected, {R}) AS delta, abs(round(obtained - expected, {R})) <= {_t(PAPER_TOLERANCE)} AS within
FROM lng l JOIN paper p ON l.scenario = p.scenario AND l.metric = p.metric""")
def q_metric_delta(spark, sf):
    sc = scenarios(spark, sf)
    lng = sc.select("scenario", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("obtained")) for m in SCEN_METRICS])).alias("m")
    ).select("scenario", "m.metric", "m.obtained")
    paper = spark.createDataFrame([(s, m, float(v)) for s, *vals in PAPER_METRICS
                                   for m, v in zip(SCEN_METRICS, vals)],
                                  "scenario string, metric string, expected double")
    d = F.round(F.col("obtained") - F.col("expected"), R)
    # the published table has ten rows: a bounded broadcast
    return lng.join(F.broadcast(paper), ["scenario", "metric"]).select(
        "scenario", "metric", F.round("obtained", R).alias("obtained"), "expected",
        d.alias("delta"), (F.abs(d) <= PAPER_TOLERANCE).alias("within"))


@register("q_logloss", views=("scored",), sql=f"""
SELECT round(avg(-(y_true * ln(greatest(least(y_prob, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
  + (1 - y_true) * ln(1 - greatest(least(y_prob, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))), {R})
  AS log_loss FROM scored""")
def q_logloss(spark, sf):
    return rnd(ev.log_loss(scored(spark, sf)), ["log_loss"])
