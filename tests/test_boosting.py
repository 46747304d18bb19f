"""Histogram boosting against plain Python, its two ways against each other, models as tables."""

import math
import random

import numpy as np
import pytest

from ivnflow import sinks
from ivnflow.operators import boosting as bo
from ivnflow.operators import models as md
from ivnflow.schemas import GBT_PARAMS
from ivnflow.sources.fixtures import VECTOR_COLS, vectors

from conftest import SF001

COLS = ["a", "b", "c"]


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = r.choice([r.gauss(0, 1), 0.0, None]), r.randint(0, 4) * 1.0, r.random()
        out.append((k, a, b, c, int((a or 0) + b > 2 + r.gauss(0, 0.5)), r.choice([1.0, 2.0])))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(160), "id long, a double, b double, c double, y int, w double").cache()


def brute_tree(x, g, h, use, columns, depth, l2, least, node=0):
    """One greedy tree over all distinct values, as nested tuples (column, cut, left, right) or a leaf value."""
    rows_in = [i for i in use]
    G, H = sum(g[i] for i in rows_in), sum(h[i] for i in rows_in)
    best = (1e-6, None)
    if depth:
        for f in columns:
            for cut in sorted({x[i][f] for i in rows_in}):
                gl = sum(g[i] for i in rows_in if x[i][f] <= cut)
                hl = sum(h[i] for i in rows_in if x[i][f] <= cut)
                if hl < least or H - hl < least:
                    continue
                gain = 0.5 * (gl * gl / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G * G / (H + l2))
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
    if best[1] is None:
        return -G / (H + l2)
    f, cut = best[1]
    return (f, cut, *(brute_tree(x, g, h, [i for i in rows_in if (x[i][f] <= cut) == side], columns, depth - 1, l2, least)
                      for side in (True, False)))


def brute_value(tree, v):
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


def test_rounds_equal_brute_force(spark, data):
    n, rounds = 160, 6
    p = bo.Profile(rounds=rounds, eta=0.3, depth=3, bins=256)
    model = bo.fit(data, "id", COLS, "y", p, weight="w")
    got = {r["id"]: r["y_prob"] for r in bo.score(model, data, "id", "y").collect()}
    raw = rows(n)
    x = [[v or 0.0 for v in r[1:4]] for r in raw]
    margin = [0.0] * n
    for _ in range(rounds):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        g = [math.floor((q - r[4]) * r[5] * bo.SCALE + 0.5) / bo.SCALE for q, r in zip(prob, raw)]
        h = [math.floor(q * (1 - q) * r[5] * bo.SCALE + 0.5) / bo.SCALE for q, r in zip(prob, raw)]
        tree = brute_tree(x, g, h, range(n), range(3), p.depth, p.l2, p.min_child_weight)
        margin = [m + p.eta * brute_value(tree, v) for m, v in zip(margin, x)]
    assert all(abs(got[k] - 1 / (1 + math.exp(-m))) < 1e-9 for k, m in enumerate(margin))


@pytest.mark.parametrize("p", [
    bo.Profile(rounds=4, depth=3, rows=700, columns=700, bins=16),
    bo.Profile(rounds=2, depth=20, max_leaves=6, l2=0.0, min_child_weight=1e-3, bins=32),
    bo.Profile(rounds=2, depth=4, kind="forest", bootstrap=True, node_columns=1)])
def test_jobs_and_task_give_the_same_trees(data, p, monkeypatch):
    monkeypatch.setattr(bo, "STATE_ROUNDS", 2)
    one = bo.fit(data, "id", COLS, "y", p, weight="w")
    many = bo.fit(data.repartition(3), "id", COLS, "y", p, weight="w", task_rows=0)
    assert one.cuts == many.cuts and one.trees == many.trees
    if p.max_leaves:
        assert all(sum(n[1] < 0 for n in t) <= p.max_leaves for t in one.trees)


def test_leaf_wise_growth_takes_the_largest_gains():
    g = bo.Grower(bo.Profile(depth=9, max_leaves=3))
    g.add([(9.0, 0, 0, 1.0, 2.0, 3.0, 9.0)])
    g.add([(1.0, 0, 0, 1.0, 1.0, 1.0, 2.0), (5.0, 1, 0, 1.0, 1.0, 2.0, 7.0)])
    while g.open:
        g.add([(0.0, -1, 0, 0.0, 0.0, 1.0, 2.0)] * len(g.open))
    tree = g.tree()
    assert [n[1] for n in tree] == [0, -1, 1, -1, -1] and [n[5] for n in tree if n[1] < 0].count(0.0) == 0


def test_patience_stops_early_by_jobs_too(data):
    p = bo.Profile(rounds=40, eta=1.0, depth=4, bins=16)
    d = data.withColumn("v", data.id % 4 == 0)
    one = bo.fit(d, "id", COLS, "y", p, valid="v", patience=2)
    many = bo.fit(d.repartition(2), "id", COLS, "y", p, valid="v", patience=2, task_rows=0)
    assert one.trees == many.trees and len(one.losses) == len(many.losses) < 40
    assert one.num_trees == one.losses.index(min(one.losses)) + 1


def test_saved_model_and_node_table_give_the_same_scores(spark, data, tmp_path):
    for p in (bo.Profile(rounds=5, depth=3), bo.Profile(rounds=3, depth=5, kind="forest")):
        model = bo.fit(data, "id", COLS, "y", p)
        want = sorted(map(tuple, bo.score(model, data, "id", "y").collect()))
        sinks.save_model(model, str(tmp_path / p.kind))
        assert sorted(map(tuple, bo.score(bo.load(spark, str(tmp_path / p.kind)), data, "id", "y").collect())) == want
        steps = sorted(map(tuple, bo.score_sql(model.nodes(spark), data, COLS, "id", "y", p.kind).collect()))
        assert [r[:2] for r in steps] == [r[:2] for r in want]
        assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(steps, want))


def test_degenerate_tables(spark):
    same = spark.createDataFrame([(k, 1.0, None, float("nan"), k % 2) for k in range(6)], "id long, a double, b double, c double, y int")
    model = bo.fit(same, "id", COLS, "y", bo.Profile(rounds=3))
    assert all(len(t) == 1 for t in model.trees)
    assert {r["y_prob"] for r in bo.score(model, same, "id", "y").collect()} == {0.5}
    with pytest.raises(ValueError, match="no rows"):
        bo.fit(same.limit(0), "id", COLS, "y")


def test_the_profiles_fit_all_rounds(spark):
    v = vectors(spark, SF001)
    model = md.fit_trees(v, VECTOR_COLS[:8], "vec_id", "y_true")
    assert model.num_trees == GBT_PARAMS["rounds"] == 1000
    table = md.baseline_table(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), VECTOR_COLS[:8], "vec_id", "y_true", rounds=5)
    assert [r["model"] for r in table.collect()] == ["GBT", "RF", "DT", "LR", "GBT2", "KNN", "NB"]


def array_rows(n, width, bins, seed=3):
    rng = np.random.default_rng(seed)
    b = rng.integers(0, bins, (n, width)).astype(np.uint8)
    y = (b[:, 0] + b[:, 1] + rng.integers(0, bins, n) > 1.5 * bins).astype(float)
    return rng.integers(0, bo.MOD, n), y, rng.choice([1.0, 2.0], n), b


def plain_rounds(key, y, w, bins, p):
    """Trees by whole histograms of every open leaf."""
    margin, trees = np.zeros(len(y)), []
    for r in range(p.rounds):
        g, h, use = bo.round_sums(margin, y, w, key, r, p)
        columns, grower = bo.tree_columns(bins.shape[1], r, p.columns, p.seed), bo.Grower(p)
        leaf = np.zeros(len(y), np.int64)
        while grower.open:
            sums = bo.histogram(bins, leaf, g, h, use, len(grower.open), columns, p.bins)
            grower.add(bo.best_splits(sums, columns, p, grower.open_paths(), r))
            if grower.open:
                slot = np.full(grower.next_id, -1)
                slot[grower.open] = np.arange(len(grower.open))
                leaf = slot[bo.Packed(bo._growing(grower)).descend(bins)]
        trees.append(grower.tree())
        margin = margin + bo.Packed(trees[-1]).values(bins)
    return trees


@pytest.mark.parametrize("p", [
    bo.Profile(rounds=6, depth=5, rows=800, columns=800, bins=16),
    bo.Profile(rounds=4, depth=30, max_leaves=9, l2=0.0, min_child_weight=1e-3, bins=32),
    bo.Profile(rounds=3, depth=30, kind="forest", bootstrap=True, node_columns=2, bins=64),
    bo.Profile(rounds=1, depth=30, kind="forest", bins=64), bo.Profile(rounds=2, depth=3, kind="forest", bins=16)])
def test_sums_of_smaller_children_and_occupied_cells_give_the_plain_trees(p, monkeypatch):
    monkeypatch.setattr(bo, "CHUNK", 500)
    key, y, w, bins = array_rows(900, 6, p.bins)
    assert bo.grow_all(key, y, w, np.zeros(900, bool), bins, p)[0] == plain_rounds(key, y, w, bins, p)


def test_sums_of_a_forest_level_do_not_grow_with_its_leaves(monkeypatch):
    """Noise makes thousands of leaves; whole histograms of a level were 2 x leaves x columns x bins numbers."""
    import tracemalloc
    rng = np.random.default_rng(9)
    n, p = 20_000, bo.Profile(rounds=1, depth=30, kind="forest", bins=256)
    bins = rng.integers(0, 256, (n, 16)).astype(np.uint8)
    tracemalloc.start()
    tree = bo.grow_apart(np.arange(n), rng.integers(0, 2, n).astype(float), np.ones(n), bins, p, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree) > 6_000 and peak < 100 << 20


def test_the_trees_of_a_forest_are_dealt_out(data, monkeypatch):
    """No task gets the whole table: each tree has a group of the rows drawn for it."""
    monkeypatch.setattr(bo, "_fit_in_task", None)
    p = bo.Profile(rounds=5, depth=6, kind="forest", bootstrap=True, node_columns=2)
    one = bo.fit(data, "id", COLS, "y", p, weight="w")
    many = bo.fit(data, "id", COLS, "y", p, weight="w", task_rows=0)
    assert one.trees == many.trees and one.num_trees == 5
    probs = [{r["id"]: r["y_prob"] for r in bo.score(m, data, "id", "y").collect()} for m in (one, many)]
    assert probs[0] == probs[1]


def test_leaf_wise_growth_tries_no_split_beyond_its_leaves(monkeypatch):
    key, y, w, b = array_rows(600, 5, 16)
    p = bo.Profile(rounds=3, depth=12, max_leaves=8, l2=0.0, min_child_weight=1e-3, bins=16)
    tried, best = [], bo.best_splits
    monkeypatch.setattr(bo, "best_splits", lambda hist, columns, p, paths, r: tried.extend(paths) or best(hist, columns, p, paths, r))
    trees, _ = bo.grow_all(key, y, w, np.zeros(600, bool), b, p)
    assert len(tried) <= p.rounds * (2 * p.max_leaves - 3)
    assert trees == plain_rounds(key, y, w, b, p)


def test_baselines_share_bins_and_do_not_wait_for_each_other(spark, data, monkeypatch):
    import threading

    from ivnflow.operators import neighbors

    begun, tables, fits = threading.Event(), [], []
    binned, fit, classify = bo.binned, bo.fit, neighbors.knn_classify
    monkeypatch.setattr(bo, "binned", lambda *a, **k: tables.append(1) or binned(*a, **k))
    monkeypatch.setattr(bo, "fit", lambda *a, **k: fits.append(begun.wait(60)) or fit(*a, **k))
    monkeypatch.setattr(neighbors, "knn_classify", lambda *a, **k: begun.set() or classify(*a, **k))
    train, test = data.na.fill(0.0).where("id % 2 = 0"), data.na.fill(0.0).where("id % 2 = 1")
    got = {r["model"]: r for r in md.baseline_table(train, test, COLS, "id", "y", rounds=5).collect()}
    assert fits == [True] * 4 and len(tables) == 2   # 64 bins for both boosted models, 256 for the forest and the tree
    for name in ("GBT", "GBT2", "DT"):
        model = md.fit_trees(train, COLS, "id", "y", name, **({"rounds": 5} if name != "DT" else {}))
        s = md.score(model, test, "id", "y")
        want = md.ev.prf(s, 0.36, "y_true", "y_prob").first()
        assert got[name]["f1"] == want["f1"] and got[name]["precision"] == want["precision"]
