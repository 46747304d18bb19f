"""Classifiers: boosted trees, forests and trees of ``boosting`` (model = node table),
logistic regression (Spark ML), Gaussian naive Bayes (DataFrame job), and their
comparisons and validation (M1-M14).
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GBT2_PARAMS, GBT_PARAMS
from ..session import cut_lineage, ship_package
from . import boosting as bo
from . import evaluate as ev
from .sampling import hash_key

FEATURES = "features"


def assemble(df: DataFrame, cols: list[str], out: str = FEATURES) -> DataFrame:
    """Horizontal stack of numeric columns into one vector (nulls -> 0)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(
        df.fillna(0, subset=cols))


def hash_fold(id_col: str, folds: int) -> F.Column:
    return F.pmod(F.conv(F.substr(hash_key(id_col), F.lit(1), F.lit(8)), 16, 10).cast("long"),
                  F.lit(folds)).cast("int")


def tree_profiles(**gbt_overrides) -> dict[str, bo.Profile]:
    """Profiles of the tree models: two boosted ones, a forest of bootstrapped trees
    whose nodes choose among sqrt(columns), and one tree grown until its leaves are pure."""
    return {
        "GBT": bo.Profile(**{**GBT_PARAMS, **gbt_overrides}),
        "RF": bo.Profile(kind="forest", rounds=100, depth=30, bootstrap=True, bins=256),
        "DT": bo.Profile(kind="forest", rounds=1, depth=30, bins=256),
        "GBT2": bo.Profile(**{**GBT2_PARAMS, **gbt_overrides}),
    }


def fit_trees(df: DataFrame, cols: list[str], id_col: str, label: str = "label", name: str = "GBT",
              weight: str | None = None, ready: bo.Binned | None = None, **over) -> bo.TreeModel:
    """Fit the profile ``name`` on all rows of ``df``, whose bins may be ``ready``."""
    p = tree_profiles(**(over if name.startswith("GBT") else {}))[name]
    if name == "RF":
        p = bo.replace(p, node_columns=max(1, math.isqrt(len(cols))))
    return bo.fit(df, id_col, cols, label, p, weight, ready=ready)


def fit_with_patience(df: DataFrame, cols: list[str], id_col: str, label: str = "label", patience: int = 50,
                      weight: str | None = None, **over) -> tuple[bo.TreeModel, list[float]]:
    """(model, validation loss per fitted round). A hash fold of a fifth of the rows is
    held out; its loss is taken after every round, boosting stops when the lowest
    one is ``patience`` rounds old, and the rounds up to it are kept."""
    p = bo.Profile(**{**GBT_PARAMS, **over})
    model = bo.fit(with_validation(df, id_col), id_col, cols, label, p, weight, "_val", patience)
    return model, model.losses


@dataclass
class LogisticModel:
    """Coefficients of a logistic regression, scored by one expression."""
    cols: list[str]
    weights: list[float]
    intercept: float

    def probability(self) -> F.Column:
        z = F.lit(self.intercept)
        for c, w in zip(self.cols, self.weights):
            z = z + F.lit(w) * F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([*zip(self.cols, map(float, self.weights)), ("", float(self.intercept))],
                                     "feature string, coefficient double")


def fit_logistic(df: DataFrame, cols: list[str], label: str = "label", l2: float = 1.0, max_iter: int = 100,
                 tol: float = 1e-10) -> LogisticModel:
    """Newton's method on the L2-penalised loss (intercept free) until the gradient's
    largest part is below ``tol``. An iteration is one aggregate: every task adds up
    its gradient and Hessian, and (columns + 1)^2 sums, whatever the rows, reach the
    driver, which solves for the step and halves it while the loss would rise."""
    import numpy as np

    spark = df.sparkSession
    ship_package(spark)
    x = df.select(*(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(cols)), F.col(label).cast("double").alias("y"))
    x = cut_lineage(x)
    d = len(cols) + 1

    def sums(w):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            total = np.zeros(d * d + d + 1)
            for b in batches:
                m = np.ones((b.num_rows, d))
                for k in range(d - 1):
                    m[:, k] = np.nan_to_num(b.column(k).to_numpy(zero_copy_only=False).astype(float), nan=0.0)
                y = b.column(d - 1).to_numpy(zero_copy_only=False).astype(float)
                z = m @ w
                p = 1 / (1 + np.exp(-z))
                total[:d * d] += ((m * (p * (1 - p))[:, None]).T @ m).ravel()
                total[d * d:-1] += m.T @ (p - y)
                total[-1] += (np.logaddexp(0.0, z) - y * z).sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

        out = np.zeros(d * d + d + 1)
        for r in x.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r["k"]] = r["v"]
        penalty = np.append(np.full(d - 1, l2), 0.0)
        return (out[:d * d].reshape(d, d) + np.diag(penalty), out[d * d:-1] + penalty * w,
                out[-1] + 0.5 * float((penalty * w * w).sum()))

    w = np.zeros(d)
    hess, grad, loss = sums(w)
    for _ in range(max_iter):
        if np.abs(grad).max() < tol:
            break
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        for _ in range(30):
            near = sums(w - step)
            if near[2] <= loss + 1e-9 * abs(loss):
                break
            step = step / 2
        w = w - step
        hess, grad, loss = near
    return LogisticModel(list(cols), [float(v) for v in w[:-1]], float(w[-1]))


def logistic(n_rows: int, label: str = "label") -> LogisticRegression:
    """L2 with C = 1 as in the reference library: regParam = 1 / n."""
    return LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=1000,
                              regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0,
                              standardization=False)


def with_validation(df: DataFrame, id_col: str, frac_folds: int = 5) -> DataFrame:
    return df.withColumn("_val", hash_fold(id_col, frac_folds) == 0)


def score(model, df: DataFrame, id_col: str, label: str = "label", out: str = "y_prob") -> DataFrame:
    """Class-1 probability per row."""
    if isinstance(model, bo.TreeModel):
        return bo.score(model, df, id_col, label, out)
    if isinstance(model, LogisticModel):
        return df.select(id_col, F.col(label).alias("y_true"), model.probability().alias(out))
    t = model.transform(df)
    return t.select(id_col, F.col(label).alias("y_true"),
                    vector_to_array("probability")[1].alias(out))


# ---- Gaussian naive Bayes ------------------------------------------------------------

def gaussian_nb_fit(df: DataFrame, cols: list[str], y: str = "label",
                    var_smoothing: float = 1e-9) -> DataFrame:
    """One row per class: prior, means and smoothed variances.

    The smoothing adds ``var_smoothing * max_j var(x_j)`` to every
    variance, as the reference library does.
    """
    st = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"),
                           *[F.avg(c).alias(f"_m_{c}") for c in cols],
                           *[F.var_pop(c).alias(f"_v_{c}") for c in cols])
    # the rest is over one row per class: variance of all = within + between classes
    every = Window.partitionBy()
    n = F.sum("_n").over(every)
    st = st.withColumn("_ntot", n).select("*", *[
        (F.sum(F.col("_n") * F.col(f"_m_{c}")).over(every) / n).alias(f"_g_{c}") for c in cols])
    var = [F.sum(F.col("_n") * (F.col(f"_v_{c}") + (F.col(f"_m_{c}") - F.col(f"_g_{c}")) ** 2)).over(every)
           / F.col("_ntot") for c in cols]
    st = st.withColumn("_vmax", F.greatest(*var) if len(var) > 1 else var[0])
    return st.select(y, (F.col("_n") / F.col("_ntot")).alias("_prior"),
                     *[F.col(f"_m_{c}") for c in cols],
                     *[(F.col(f"_v_{c}") + F.lit(var_smoothing) * F.col("_vmax")).alias(f"_v_{c}")
                       for c in cols])


def gaussian_nb_score(df: DataFrame, model: DataFrame, cols: list[str], id_col: str,
                      y: str = "label") -> DataFrame:
    """Posterior of class 1 for a binary label: one projection against one row
    that holds both classes, so repeated ids stay one row each. Columns are
    folded as an array, so the expression does not grow with them."""
    means, variances = (F.array(*[F.col(f"_{k}_{c}") for c in cols]) for k in "mv")
    const = F.aggregate(variances, F.ln("_prior"), lambda acc, v: acc - F.lit(0.5) * F.ln(F.lit(2 * math.pi) * v))
    row = F.struct(const.alias("const"), F.arrays_zip(means.alias("m"), variances.alias("v")).alias("mv"))
    both = model.select(y, row.alias("_c")).agg(
        *[F.max(F.when(F.col(y) == k, F.col("_c.const"))).alias(f"_k{k}") for k in (0, 1)],
        *[F.max_by("_c.mv", F.when(F.col(y) == k, F.lit(1))).alias(f"_c{k}") for k in (0, 1)])
    x = F.array(*[F.col(c).cast("double") for c in cols])

    def jll(k):
        terms = F.zip_with("_x", F.col(f"_c{k}"), lambda v, g: (v - g["m"]) * (v - g["m"]) / g["v"])
        return F.col(f"_k{k}") - F.lit(0.5) * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    return df.select(id_col, y, x.alias("_x")).crossJoin(F.broadcast(both)).select(
        id_col, F.col(y).alias("y_true"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(jll(0) - jll(1)))).alias("y_prob"))


# ---- comparisons, validation ------------------------------------------------------------

def baseline_table(train: DataFrame, test: DataFrame, cols: list[str], id_col: str,
                   label: str = "label", t: float = 0.36, **gbt_overrides) -> DataFrame:
    """Fit each baseline, score the test set and report P/R/F1/PR-AUC at ``t``
    with train and inference seconds.

    The models do not need each other, so each is fitted, scored and measured by a
    driver thread of its own: boosted rounds keep one task busy while the other
    models take the rest. The halves are written once and binned once per number
    of bins; a tree model's seconds include its bins. All seconds are by the
    clock, with the other models running."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from .neighbors import knn_classify

    spark = train.sparkSession
    ship_package(spark)
    train, test = (cut_lineage(d.select(id_col, label, *cols)) for d in (train, test))
    profiles = tree_profiles(**gbt_overrides)

    def bins():
        """Per number of bins: the binned rows and the seconds they took."""
        t0 = time.time()
        counts = bo.value_counts(train, cols)
        t_counts, out = time.time() - t0, {}
        for n in sorted({p.bins for p in profiles.values()}):
            t0 = time.time()
            out[n] = bo.bin_table(train, id_col, cols, label, n, counts=counts), t_counts + time.time() - t0
        return out

    def row(name, t_fit, t0, scores):
        s = scores.cache()
        s.count()
        t_inf = time.time() - t0
        m = ev.prf(s, t, "y_true", "y_prob").select("precision", "recall", "f1") \
            .crossJoin(ev.average_precision(s)).first()
        s.unpersist()
        return name, *(float(m[c]) for c in ("precision", "recall", "f1", "average_precision")), t_fit, t_inf

    def fitted(name):
        t_bins, ready = 0.0, None
        if name != "LR":
            ready, t_bins = ready_bins.result()[profiles[name].bins]
        t0 = time.time()
        if name == "LR":
            model = fit_logistic(train, cols, label)
        else:
            model = fit_trees(train, cols, id_col, label, name, ready=ready, **gbt_overrides)
        t_fit, t0 = t_bins + time.time() - t0, time.time()
        return row(name, t_fit, t0, score(model, test, id_col, label))

    def knn(name):
        t0 = time.time()
        s = knn_classify(test, train, cols, label, 5, id_col).join(test.select(id_col, F.col(label).alias("y_true")), id_col)
        return row(name, 0.0, t0, s)

    def bayes(name):
        nb = gaussian_nb_fit(train, cols, label)
        return row(name, 0.0, time.time(), gaussian_nb_score(test, nb, cols, id_col, label))

    names = {"GBT": fitted, "RF": fitted, "DT": fitted, "LR": fitted, "GBT2": fitted, "KNN": knn, "NB": bayes}
    with ThreadPoolExecutor(len(names) + 1) as pool:
        def start(f, *a):
            return pool.submit(inheritable_thread_target(spark)(f), *a)

        ready_bins = start(bins)
        # the longest first: tasks are taken in the order of jobs
        due = {name: start(names[name], name) for name in ("GBT2", "GBT", "KNN", "RF", "DT", "LR", "NB")}
        rows = [due[name].result() for name in names]
    return spark.createDataFrame(rows, "model string, precision double, recall double, f1 double, "
                                       "pr_auc double, train_sec double, infer_sec double")


def cross_validate_f1(df: DataFrame, cols: list[str], id_col: str, label: str = "label",
                      folds: int = 5, t: float = 0.5, estimator=None) -> DataFrame:
    """F1 per hash fold (fit on the other folds), plus mean and std."""
    spark = df.sparkSession
    d = assemble(df, cols).withColumn("_fold", hash_fold(id_col, folds)).cache()
    est = estimator or DecisionTreeClassifier(featuresCol=FEATURES, labelCol=label, maxDepth=6, seed=42)
    rows = []
    for k in range(folds):
        model = est.fit(d.where(F.col("_fold") != k))
        s = score(model, d.where(F.col("_fold") == k), id_col, label)
        rows.append((k, float(ev.prf(s, t).first()["f1"])))
    d.unpersist()
    f = spark.createDataFrame(rows, "fold int, f1 double")
    return f.agg(F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"),
                 F.count(F.lit(1)).alias("folds"))


def learning_curve(train: DataFrame, test: DataFrame, cols: list[str], id_col: str,
                   label: str = "label", fractions=None, t: float = 0.5) -> DataFrame:
    """F1 on ``test`` after training on growing hash fractions of ``train``."""
    spark = train.sparkSession
    fractions = fractions or [i / 10 for i in range(1, 11)]
    tr = assemble(train, cols).withColumn("_u", hash_fold(id_col, 1000) / 1000.0).cache()
    te = assemble(test, cols).cache()
    est = DecisionTreeClassifier(featuresCol=FEATURES, labelCol=label, maxDepth=6, seed=42)
    rows = []
    for fr in fractions:
        part = tr.where(F.col("_u") < fr)
        model = est.fit(part)
        rows.append((float(fr), part.count(), float(ev.prf(score(model, te, id_col, label), t).first()["f1"])))
    tr.unpersist()
    te.unpersist()
    return spark.createDataFrame(rows, "fraction double, n_train long, f1 double")


def grid_search(df: DataFrame, cols: list[str], label: str = "label", folds: int = 3,
                grid: dict | None = None):
    """Parameter grid x k-fold cross-validation on area under ROC."""
    est = GBTClassifier(featuresCol=FEATURES, labelCol=label, seed=42)
    grid = grid or {"maxDepth": [3, 4, 6], "stepSize": [0.05, 0.1, 0.3], "maxIter": [10, 20, 40]}
    b = ParamGridBuilder()
    for k, vs in grid.items():
        b = b.addGrid(est.getParam(k), vs)
    cv = CrossValidator(estimator=Pipeline(stages=[est]), estimatorParamMaps=b.build(),
                        evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds,
                        seed=42, parallelism=2)
    return cv.fit(assemble(df, cols))
