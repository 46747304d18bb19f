"""Exact kNN and SMOTE against numpy brute force on awkward inputs."""

import numpy as np

from ivnflow.operators import neighbors as nb
from ivnflow.operators.neighbors import fit_cells, knn, smote


def test_knn_exact_with_ties_and_clusters(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(300, 4))
    a[:40] = a[0]                      # 40 identical points
    a[40:120, 0] = 5.0                 # a slab with one value on the first axis
    rows = [(i, *map(float, a[i])) for i in range(len(a))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    q = df.where("id % 3 = 0")
    r = df.where("id % 3 <> 0")
    got = {(x.q_id, x.rank): x.r_id for x in knn(q, r, cols, 5, "id", "id", per_cell=8).collect()}
    qi = [i for i in range(len(a)) if i % 3 == 0]
    ri = np.array([i for i in range(len(a)) if i % 3 != 0])
    for i in qi:
        d = np.sqrt(((a[ri] - a[i]) ** 2).sum(axis=1))
        order = sorted(range(len(ri)), key=lambda j: (d[j], ri[j]))[:5]
        want = [int(ri[j]) for j in order]
        have = [got[(i, k)] for k in range(1, 6)]
        # equal distances may be ordered differently only by float noise: compare distances
        assert np.allclose(sorted(d[[list(ri).index(h) for h in have]]), sorted(d[order]))


def test_smote_rows(spark):
    rows = [(i, float(i % 7), float(i % 5), 1 if i < 30 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    s = smote(df, ["a", "b"], "id", "y", 5).collect()
    assert len(s) == 70 - 30
    # synthetic points lie inside the minority bounding box
    assert all(0 <= r.a <= 6 and 0 <= r.b <= 4 for r in s)


def brute(a, qi, ri, k):
    out = {}
    for i in qi:
        d = np.sqrt(((a[ri] - a[i]) ** 2).sum(axis=1))
        out[i] = sorted(d)[:k]
    return out


def test_knn_splits_large_cells_and_shared_points(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(scale=20, size=(12, 8))
    a = centres[rng.integers(0, 12, 4000)] + rng.normal(scale=0.5, size=(4000, 8))
    a[:1400] = a[0]                    # a point that a third of the rows share
    names = [f"c{j}" for j in range(8)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)],
                               "id long, " + ", ".join(f"{c} double" for c in names))
    qi = list(range(0, 4000, 40))
    q, r = df.where("id % 40 = 0"), df.where("id % 40 <> 0")
    got = {}
    for x in knn(q, r, names, 5, per_cell=16).collect():
        got.setdefault(x.q_id, []).append((x.rank, x.dist, x.r_id))
    ri = np.array([i for i in range(4000) if i % 40])
    want = brute(a, qi, ri, 5)
    for i in qi:
        assert np.allclose([d for _, d, _ in sorted(got[i])], want[i])
    # the shared point's neighbours are its smallest ids
    assert [x for _, _, x in sorted(got[0])] == [1, 2, 3, 4, 5]
    # every row lies in a ring, and most rings are pruned
    cells = fit_cells(r, names, "id", 16)
    assert int(cells.ring_rows.sum()) == len(ri)
    seen = [cells.ring_rows[cells.within(np.sqrt(((cells.pivots - a[i]) ** 2).sum(axis=1)), want[i][-1])].sum()
            for i in qi if i >= 1400]
    assert np.median(seen) < len(ri) / 8


def test_knn_bounds_hold(spark):
    """No ring is left out that holds a row within the bound."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(500, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "id long, a double, b double, c double")
    cells = fit_cells(df, ["a", "b", "c"], "id", 10)
    to_pivots = np.sqrt(((a[:, None] - cells.pivots[None]) ** 2).sum(axis=2))
    rings = cells.ring_of(to_pivots)
    for i in range(0, 500, 25):
        d = np.sqrt(((a - a[i]) ** 2).sum(axis=1))
        for bound in (0.0, 0.2, 0.7, 9.0):
            assert set(rings[d <= bound]) <= set(cells.within(to_pivots[i], bound))
        assert cells.ring_rows[cells.nearest(to_pivots[i], 12)].sum() >= 12


def test_knn_awkward_rows(spark):
    rows = [(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 3.0, 4.0), (4, 3.0, 4.0), (5, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {(x.q_id, x["rank"]): (x.r_id, x.dist) for x in knn(df.where("id <> 4"), df, ["a", "b"], 9, exclude_self=True).collect()}
    assert got[1, 1] == (5, 1.0) and got[1, 2] == got[1, 3] == (4, 5.0) and (1, 4) not in got
    assert not any(i in (2, 3) for i, _ in got) and not any(r in (2, 3) for r, _ in got.values())
    assert knn(df, df.where("false"), ["a", "b"]).count() == 0 == knn(df.where("false"), df, ["a", "b"]).count()


def test_tiles_of_few_rows_give_the_nearest_and_never_the_pairs(spark, monkeypatch):
    """Points apart in many dimensions, a far origin, ties and repeated queries: blocks that meet hand on
    k rows a query, where every pair was a row before."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(600, 16)) + 1e6
    a[200:260] = np.round(a[200:260])
    a[300:340] = a[300]
    names = [f"c{j}" for j in range(16)]
    schema = "id string, y int, " + ", ".join(f"{c} double" for c in names)
    df = spark.createDataFrame([(f"{i:04d}", i % 2, *map(float, v)) for i, v in enumerate(a)], schema)
    monkeypatch.setattr(nb, "TILE", 200)
    made = []
    plain = nb.tiles
    monkeypatch.setattr(nb, "tiles", lambda *x: made.append(plain(*x)) or made[-1])
    got = {}
    for x in knn(df, df, names, 5, label="y", exclude_self=True).collect():
        got.setdefault(int(x.q_id), []).append((x.rank, x.dist, x.r_id, x.r_label))
    for i in range(600):
        d = np.zeros(600)
        for c in range(16):
            d += (a[i, c] - a[:, c]) * (a[i, c] - a[:, c])
        d = np.sqrt(d)
        want = [(int(j), float(d[j])) for j in np.lexsort((np.arange(600), d)) if j != i][:5]
        assert [(int(r), d) for _, d, r, _ in sorted(got[i])] == want
        assert all(y == int(r) % 2 for _, _, r, y in got[i])
    blocks = 6
    assert len(made) == 2 and sum(x.count() for x in made) <= 600 * 5 * blocks < 600 * 600
    twice = knn(df.limit(3).union(df.limit(3)), df, names, 4).groupBy("q_id").count().collect()
    assert [r["count"] for r in twice] == [4, 4, 4]


def test_a_ring_larger_than_a_block_is_dealt_out():
    class Figures:
        ring_rows = np.array([5, 0, 90, 3, 3, 40, 1])
    b = nb.Blocks(Figures, 40)
    assert b.of.tolist() == [0, 0, 1, 2, 2, 3, 4] and b.parts == [1, 3, 1, 1, 1]
