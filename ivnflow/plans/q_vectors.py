"""Queries on numeric vectors: matrix scan, separability, naive Bayes, models (S5, A6, G*, M*)."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import models as md
from ..operators import separability as sp
from ..operators.prepare import stratified_split
from ..operators.profile import pair_sums
from ..sources.fixtures import VECTOR_COLS, table, vectors
from . import model_sql as msql
from .catalog import register

R = 6
X = VECTOR_COLS
HALF = X[:32]
PATIENCE = 50
PAIRS = [("x01", "x02"), ("x03", "x04"), ("x05", "x06")]

VHASH = "md5(CAST(vec_id AS VARCHAR) || '|42')"
DUCK_VSPLIT = f"""
vs AS (SELECT v.*, CASE WHEN rn * 2 <= n THEN 'train' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {VHASH}, vec_id) AS rn,
         count(*) OVER (PARTITION BY y_true) AS n FROM vectors) v)"""


def rnd(df, cols, r=R):
    return df.select(*[F.round(c, r).alias(c) if c in cols else F.col(c) for c in df.columns])


def duck_stats(cols) -> str:
    parts = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in cols)
    return f"st AS (SELECT y_true, count(*) AS n, {parts} FROM vectors GROUP BY y_true)"


def _sum(exprs) -> str:
    return "(" + " + ".join(exprs) + ")"


def duck_fisher(cols) -> str:
    num = _sum(f"pow(b.m_{c} - a.m_{c}, 2)" for c in cols)
    va, vb = _sum(f"a.v_{c}" for c in cols), _sum(f"b.v_{c}" for c in cols)
    return f"""SELECT {num} / ({va} + {vb} + 1e-12) AS fisher_ratio
FROM st a, st b WHERE a.y_true = 0 AND b.y_true = 1"""


def duck_ch(cols) -> str:
    g = ", ".join(f"avg({c}) AS g_{c}" for c in cols)
    b = _sum(f"pow(s.m_{c} - g.g_{c}, 2)" for c in cols)
    w = _sum(f"s.v_{c}" for c in cols)
    return f"""SELECT (sum(s.n * {b}) / (count(*) - 1)) / (sum(s.n * {w}) / (max(g.N) - count(*)))
  AS calinski_harabasz FROM st s, (SELECT count(*) AS N, {g} FROM vectors) g"""


def duck_db(cols) -> str:
    d = _sum(f"pow(v.{c} - s.m_{c}, 2)" for c in cols)
    sep = _sum(f"pow(a.m_{c} - b.m_{c}, 2)" for c in cols)
    return f"""SELECT avg(r) AS davies_bouldin FROM (
  SELECT a.y_true, max((a.sc + b.sc) / sqrt({sep})) AS r
  FROM (SELECT s.*, sc FROM st s JOIN (SELECT v.y_true, avg(sqrt({d})) AS sc FROM vectors v
        JOIN st s ON v.y_true = s.y_true GROUP BY v.y_true) q ON s.y_true = q.y_true) a,
       (SELECT s.*, sc FROM st s JOIN (SELECT v.y_true, avg(sqrt({d})) AS sc FROM vectors v
        JOIN st s ON v.y_true = s.y_true GROUP BY v.y_true) q ON s.y_true = q.y_true) b
  WHERE a.y_true <> b.y_true GROUP BY a.y_true)"""


# ---- S5, A6 ------------------------------------------------------------------------------

@register("q_matrix_scan", sql=f"""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_dims,
  round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), {R}) AS l2_norm,
  label FROM embeddings""")
def q_matrix_scan(spark, sf):
    e = table(spark, sf, "embeddings")
    v = e.select("vec_id", "label", array_to_vector(
        F.transform("embedding", lambda x: x.cast("double"))).alias("vec"))
    a = vector_to_array("vec")
    return v.select("vec_id", F.size(a).alias("n_dims"),
                    F.round(F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)), R).alias("l2_norm"),
                    "label")


@register("q_pair_sum", views=("vectors",), sql=f"""
SELECT pair, round(min(s), {R}) AS s_min, round(max(s), {R}) AS s_max, round(avg(s), {R}) AS s_mean FROM (
  {' UNION ALL '.join(f"SELECT '{a}+{b}' AS pair, {a} + {b} AS s FROM vectors" for a, b in PAIRS)})
GROUP BY pair""")
def q_pair_sum(spark, sf):
    return rnd(pair_sums(vectors(spark, sf), PAIRS), ["s_min", "s_max", "s_mean"])


# ---- G1-G4, G6 -----------------------------------------------------------------------------

@register("q_fisher_ratio", views=("vectors",), sql=f"""
WITH {duck_stats(X)} SELECT round(fisher_ratio, {R}) AS fisher_ratio FROM ({duck_fisher(X)})""")
def q_fisher_ratio(spark, sf):
    return rnd(sp.fisher_ratio(vectors(spark, sf), X), ["fisher_ratio"])


@register("q_calinski_harabasz", views=("vectors",), sql=f"""
WITH {duck_stats(X)} SELECT round(calinski_harabasz, {R}) AS calinski_harabasz FROM ({duck_ch(X)})""")
def q_calinski_harabasz(spark, sf):
    return rnd(sp.calinski_harabasz(vectors(spark, sf), X), ["calinski_harabasz"])


@register("q_davies_bouldin", views=("vectors",), sql=f"""
WITH {duck_stats(X)} SELECT round(davies_bouldin, {R}) AS davies_bouldin FROM ({duck_db(X)})""")
def q_davies_bouldin(spark, sf):
    return rnd(sp.davies_bouldin(vectors(spark, sf), X), ["davies_bouldin"])


def _duck_sil(cols, euclidean: bool = False) -> str:
    d = _sum(f"pow(p.{c} - q.{c}, 2)" for c in cols)
    d = f"sqrt({d})" if euclidean else d
    return f"""SELECT avg(CASE WHEN n_own <= 1 THEN 0.0e0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
  SELECT p.vec_id,
    sum(CASE WHEN p.y_true = q.y_true AND p.vec_id <> q.vec_id THEN {d} ELSE 0 END)
      / nullif(sum(CASE WHEN p.y_true = q.y_true THEN 1 ELSE 0 END) - 1, 0) AS a,
    sum(CASE WHEN p.y_true <> q.y_true THEN {d} ELSE 0 END)
      / sum(CASE WHEN p.y_true <> q.y_true THEN 1 ELSE 0 END) AS b,
    sum(CASE WHEN p.y_true = q.y_true THEN 1 ELSE 0 END) AS n_own
  FROM vectors p, vectors q GROUP BY p.vec_id)"""


@register("q_silhouette", views=("vectors",), sql=f"""
SELECT round(silhouette, {R}) AS silhouette FROM ({_duck_sil(X)})""")
def q_silhouette(spark, sf):
    """Squared-Euclidean silhouette, exact from class aggregates (the oracle
    forms all pairs; the Spark plan never does)."""
    return rnd(sp.silhouette_sq(vectors(spark, sf), X), ["silhouette"])


@register("q_silhouette_euclidean", views=("vectors",), sql=f"""
SELECT round(silhouette, {R}) AS silhouette FROM ({_duck_sil(X, True)})""")
def q_silhouette_euclidean(spark, sf):
    """Every point against up to 10,000 points in tiles (all of them where there are no more)."""
    return rnd(sp.silhouette(vectors(spark, sf), X, "vec_id"), ["silhouette"])


@register("q_featureset_compare", views=("vectors",), sql=f"""
SELECT feature_set, round(fisher_ratio, {R}) AS fisher_ratio, round(calinski_harabasz, {R}) AS calinski_harabasz,
  round(davies_bouldin, {R}) AS davies_bouldin FROM (
  SELECT 'behavioural' AS feature_set, * FROM
    (WITH {duck_stats(HALF)} {duck_fisher(HALF)}), (WITH {duck_stats(HALF)} {duck_ch(HALF)}),
    (WITH {duck_stats(HALF)} {duck_db(HALF)})
  UNION ALL
  SELECT 'header_and_behavioural', * FROM
    (WITH {duck_stats(X)} {duck_fisher(X)}), (WITH {duck_stats(X)} {duck_ch(X)}),
    (WITH {duck_stats(X)} {duck_db(X)}))""")
def q_featureset_compare(spark, sf):
    f = sp.featureset_compare(vectors(spark, sf), {"behavioural": HALF, "header_and_behavioural": X})
    return rnd(f, ["fisher_ratio", "calinski_harabasz", "davies_bouldin"])


@register("q_pca_projection")
def q_pca_projection(spark, sf):
    v = md.assemble(vectors(spark, sf), X)
    m = PCA(k=2, inputCol=md.FEATURES, outputCol="pc").fit(v)
    a = vector_to_array("pc")
    return m.transform(v).select("vec_id", "y_true", a[0].alias("pc1"), a[1].alias("pc2"))


# ---- M7 Gaussian naive Bayes (DataFrame job, with oracle) --------------------------------------

def _duck_nb(cols) -> str:
    parts = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in cols)
    eps = "greatest(" + ", ".join(f"var_pop({c})" for c in cols) + ") * 1e-9"

    def jll(a):
        s = f"ln({a}.n / CAST(t.N AS DOUBLE))"
        for c in cols:
            s += (f" - 0.5e0 * ln({2 * 3.141592653589793!r}e0 * ({a}.v_{c} + e.e))"
                  f" - 0.5e0 * pow(x.{c} - {a}.m_{c}, 2) / ({a}.v_{c} + e.e)")
        return s
    return f"""
WITH st AS (SELECT y_true, count(*) AS n, {parts} FROM vectors GROUP BY y_true),
e AS (SELECT {eps} AS e FROM vectors), t AS (SELECT count(*) AS N FROM vectors)
SELECT x.vec_id, x.y_true, round(1.0e0 / (1.0e0 + exp(({jll('c0')}) - ({jll('c1')}))), {R}) AS y_prob
FROM vectors x, e, t, (SELECT * FROM st WHERE y_true = 0) c0, (SELECT * FROM st WHERE y_true = 1) c1"""


@register("q_gaussian_nb", views=("vectors",), sql=_duck_nb(X))
def q_gaussian_nb(spark, sf):
    v = vectors(spark, sf)
    m = md.gaussian_nb_fit(v, X, "y_true")
    return rnd(md.gaussian_nb_score(v, m, X, "vec_id", "y_true"), ["y_prob"])


# ---- M1-M5, M9-M12: the oracles fit the models anew in SQL -------------------------------------------

def halves(spark, sf):
    s = stratified_split(vectors(spark, sf), "vec_id", "y_true")
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


def _tree_scores(spark, sf, name):
    tr, te = halves(spark, sf)
    model = md.fit_trees(tr, X, "vec_id", "y_true", name)
    return rnd(md.score(model, te, "vec_id", "y_true"), ["y_prob"])


GBT = md.tree_profiles()["GBT"]
_BOOST = f"""WITH RECURSIVE {msql.prepared(X, DUCK_VSPLIT, GBT.bins, GBT.rounds, len(X) * GBT.columns // 1000)},
{msql.boost(GBT.rounds)}"""


def _forest_sql(name):
    p = md.tree_profiles()[name]
    k = math.isqrt(len(X)) if name == "RF" else None
    return f"""WITH RECURSIVE {msql.prepared(X, DUCK_VSPLIT, p.bins, p.rounds, len(X))},
{msql.forest(p.rounds, p.depth, k, p.bootstrap)}
SELECT vec_id, any_value(y) AS y_true, round(sum(v) / {p.rounds}, {R}) AS y_prob
FROM (SELECT vec_id, tree, arg_max(val, lvl) AS v FROM ft GROUP BY 1, 2) JOIN base USING (vec_id)
WHERE split = 'test' GROUP BY vec_id"""


@register("q_gbt_scores", views=("vectors",), sql=f"""{_BOOST}
SELECT vec_id, y AS y_true, round(1.0 / (1.0 + exp(-margin)), {R}) AS y_prob FROM st JOIN base USING (vec_id)
WHERE r = {GBT.rounds} AND lvl = 0 AND split = 'test'""")
def q_gbt_scores(spark, sf):
    """All rounds of the profile on the train half, scores of the test half."""
    return _tree_scores(spark, sf, "GBT")


@register("q_rf_scores", views=("vectors",), sql=_forest_sql("RF"))
def q_rf_scores(spark, sf):
    return _tree_scores(spark, sf, "RF")


@register("q_dt_scores", views=("vectors",), sql=_forest_sql("DT"))
def q_dt_scores(spark, sf):
    return _tree_scores(spark, sf, "DT")


@register("q_lr_scores", views=("vectors",), sql=f"""WITH RECURSIVE {msql.logistic(X, DUCK_VSPLIT)}
SELECT vec_id, y AS y_true, round(1 / (1 + exp(-(list_dot_product(x, w) + b))), {R}) AS y_prob
FROM xc, (SELECT w, b FROM lr ORDER BY k DESC LIMIT 1) WHERE split = 'test'""")
def q_lr_scores(spark, sf):
    tr, te = halves(spark, sf)
    return rnd(md.score(md.fit_logistic(tr, X, "y_true"), te, "vec_id", "y_true"), ["y_prob"])


@register("q_early_stopping", views=("vectors",), sql=f"""WITH RECURSIVE {msql.prepared(
    X, DUCK_VSPLIT.replace("FROM vectors) v)", "FROM vectors) v WHERE rn * 2 <= n)"), GBT.bins, GBT.rounds,
    len(X) * GBT.columns // 1000, fold=5)},
{msql.boost(GBT.rounds, patience=PATIENCE)}
SELECT DISTINCT r AS round, round(loss, {R}) AS loss, since = 0 AS lowest,
  r <= (SELECT max(r) FROM st WHERE lvl = 0 AND loss IS NOT NULL AND since = 0) AS kept
FROM st WHERE lvl = 0 AND loss IS NOT NULL""")
def q_early_stopping(spark, sf):
    """Validation loss of every round that was fitted before the patience ran out."""
    tr, _ = halves(spark, sf)
    model, losses = md.fit_with_patience(tr, X, "vec_id", "y_true", PATIENCE)
    rows = [(k + 1, x, x == min(losses[:k + 1]) and x not in losses[:k], k < model.num_trees) for k, x in enumerate(losses)]
    return rnd(spark.createDataFrame(rows, "round long, loss double, lowest boolean, kept boolean"), ["loss"])


@register("q_baselines")
def q_baselines(spark, sf):
    tr, te = halves(spark, sf)
    return md.baseline_table(tr, te, X, "vec_id", "y_true", 0.36)


@register("q_importance", views=("vectors",), sql=f"""{_BOOST},
gains AS (SELECT f, avg(gain) AS g FROM (SELECT DISTINCT r, lvl, src, f, gain FROM st WHERE f IS NOT NULL) GROUP BY f),
names AS (SELECT unnest(range({len(X)})) AS f, unnest([{', '.join(repr(c) for c in X)}]) AS feature)
SELECT feature, round(coalesce(g, 0) / (SELECT sum(g) FROM gains), {R}) AS importance FROM names LEFT JOIN gains USING (f)""")
def q_importance(spark, sf):
    """Each column's share of the mean gains per split."""
    tr, _ = halves(spark, sf)
    return rnd(bo.importance(md.fit_trees(tr, X, "vec_id", "y_true"), spark), ["importance"])


@register("q_cv")
def q_cv(spark, sf):
    return md.cross_validate_f1(vectors(spark, sf), X, "vec_id", "y_true", folds=5)


# ---- A8 / M6 exact kNN, B2 SMOTE -------------------------------------------------------------------

def _duck_dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in X) + ")"


@register("q_knn_classify", views=("vectors",), sql=f"""
WITH {DUCK_VSPLIT},
pr AS (SELECT q.vec_id AS q_id, r.vec_id AS r_id, r.y_true AS r_label, {_duck_dist('q', 'r')} AS dist
       FROM vs q, vs r WHERE q.split = 'test' AND r.split = 'train'),
nn AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY dist, r_id) <= 5)
SELECT q_id AS vec_id, sum(r_label) / CAST(count(*) AS DOUBLE) AS y_prob FROM nn GROUP BY q_id""")
def q_knn_classify(spark, sf):
    """Exact 5-NN vote of the test half against the train half (no pair
    outside the pruning band is ever formed)."""
    from ..operators.neighbors import knn_classify
    tr, te = halves(spark, sf)
    return knn_classify(te, tr, X, "y_true", 5, "vec_id").select("vec_id", "y_prob")


def _duck_md5(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(parts) + " || '|42')"


@register("q_smote", views=("vectors",), sql=f"""
WITH c AS (SELECT y_true, count(*) AS n FROM vectors GROUP BY y_true),
mm AS (SELECT min(n) AS n_min, max(n) AS n_max, arg_min(y_true, n * 10 + y_true) AS minority FROM c),
mi AS (SELECT v.* FROM vectors v, mm WHERE v.y_true = mm.minority),
pr AS (SELECT q.vec_id AS q_id, r.vec_id AS r_id, {_duck_dist('q', 'r')} AS dist
       FROM mi q, mi r WHERE q.vec_id <> r.vec_id),
nn AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY dist, r_id) AS rank FROM pr
       QUALIFY rank <= 5),
base AS (SELECT m.*, CAST(k AS INTEGER) AS copy_no FROM mi m, mm,
         range(1, CAST(ceil((n_max - n_min) / CAST(n_min AS DOUBLE)) AS BIGINT) + 1) t(k)),
b AS (SELECT base.*,
  CAST(('0x' || substr({_duck_md5('CAST(vec_id AS VARCHAR)', 'CAST(copy_no AS VARCHAR)', "'j'")}, 1, 8)) AS BIGINT) % 5 + 1 AS pick,
  CAST(('0x' || substr({_duck_md5('CAST(vec_id AS VARCHAR)', 'CAST(copy_no AS VARCHAR)', "'u'")}, 1, 8)) AS BIGINT)
    / 4294967296.0e0 AS g FROM base),
syn AS (SELECT b.vec_id, b.copy_no, {', '.join(f'b.{c} + b.g * (r.{c} - b.{c}) AS {c}' for c in X)},
  {_duck_md5('CAST(b.vec_id AS VARCHAR)', 'CAST(b.copy_no AS VARCHAR)')} AS o
  FROM b JOIN nn ON nn.q_id = b.vec_id AND nn.rank = b.pick JOIN mi r ON r.vec_id = nn.r_id)
SELECT vec_id, copy_no, {', '.join(f'round({c}, {R}) AS {c}' for c in X)} FROM syn
QUALIFY row_number() OVER (ORDER BY copy_no, o, vec_id) <= (SELECT n_max - n_min FROM mm)""")
def q_smote(spark, sf):
    from ..operators.neighbors import smote
    s = smote(vectors(spark, sf), X, "vec_id", "y_true", 5)
    return rnd(s.select("vec_id", "copy_no", *X), X)
