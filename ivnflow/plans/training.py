"""Training and evaluation plan: normalised features -> model -> threshold -> metrics.

Train split: fit the boosted trees (all rounds, or with patience on a hash fold), pick
the threshold with the best F1 on the train split's scores, then evaluate
the test split as it is (imbalanced) and after balanced downsampling. The
metrics record goes to JSON; the baseline table, when asked for, to CSV.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import models as md
from ..operators.prepare import augment_counts, augment_positive, available_columns, balanced_sample, with_weight
from ..schemas import FEATURE_COLS, NORM_COLS
from ..sinks import save_model, write_metrics, write_table_csv


def train_and_evaluate(spark: SparkSession, features: DataFrame, out_dir: str,
                       id_col: str = "pkt_no", label: str = "label", gbt_overrides: dict | None = None,
                       baselines: bool = False, fixed_threshold: float | None = None,
                       augment: float | None = None, class_weight: bool = False,
                       patience: int | None = None) -> dict:
    """Run the full evaluation and write its outputs under ``out_dir``.

    ``features`` holds a ``split`` column ('train'/'test'), the label and
    the normalised columns (raw ones are used when those are missing).
    ``augment`` adds copies of positive train rows up to that ratio of the
    normal ones, ``class_weight`` weighs positive rows by normal / positive,
    ``patience`` stops once the loss on a hash fold has not fallen for so many rounds.
    The threshold is chosen on the original train rows.
    """
    cols = available_columns(features, NORM_COLS, FEATURE_COLS)
    tr = features.where(F.col("split") == "train")
    te = features.where(F.col("split") == "test")
    counts = augment_counts(tr, 1.0, label_col=label).first()

    t0 = time.time()
    rows = tr if augment is None else augment_positive(tr, augment, id_col=id_col, label_col=label)
    over = dict(gbt_overrides or {})
    weight = None
    if class_weight:
        rows, weight = with_weight(rows, label), "weight"
    if patience is None:
        model = md.fit_trees(rows, cols, id_col, label, weight=weight, **over)
    else:
        model, _ = md.fit_with_patience(rows, cols, id_col, label, patience, weight, **over)
    t_train = time.time() - t0
    save_model(model, os.path.join(out_dir, "model"))

    if fixed_threshold is None:
        s_tr = md.score(model, tr, id_col, label)
        best = ev.best_threshold(s_tr).first()
        threshold = float(best["threshold"])
    else:
        threshold = float(fixed_threshold)

    t0 = time.time()
    s_te = md.score(model, te, id_col, label).cache()
    n_test = s_te.count()
    bal = balanced_sample(s_te, id_col, "y_true")
    scen = ev.scenario_metrics(s_te, threshold, "imbalanced").unionByName(
        ev.scenario_metrics(bal, threshold, "balanced"))
    rows = scen.collect()  # two rows, one per scenario
    t_eval = time.time() - t0
    write_metrics(scen, os.path.join(out_dir, "metrics"), threshold=threshold,
                  train_sec=round(t_train, 3), eval_sec=round(t_eval, 3), n_test=n_test,
                  n_train_normal=int(counts["n_normal"]), n_train_attack=int(counts["n_attack"]),
                  n_augment_needed=int(counts["n_needed"]), n_trees=model.num_trees)
    s_te.unpersist()
    out = {"threshold": threshold, "scenarios": {r["scenario"]: r.asDict() for r in rows},
           "train_sec": t_train, "eval_sec": t_eval}
    if baselines:
        table = md.baseline_table(tr, te, cols, id_col, label, 0.36, **(gbt_overrides or {}))
        write_table_csv(table, os.path.join(out_dir, "baselines"))
        out["baselines"] = os.path.join(out_dir, "baselines")
    return out
