"""Exact k-nearest neighbours in pivot cells, in tiles of bounded size.

1. Up to ``MAX_PIVOTS`` reference points, taken in hash order, are pivots;
   every reference row belongs to the cell of its nearest pivot. A cell of
   more than ``per_cell`` rows is split into rings by the distance from its
   pivot, cut at sketched quantiles (at most ``MAX_RINGS``).
2. A table of every cell and pivot holds the least and greatest distance of
   the cell's rows from that pivot; every ring has the same for its own
   pivot. By the triangle inequality they bound the distance of a query
   from all rows of a ring from below.
3. Rings that follow one another form blocks of about ``TILE`` rows (a larger
   ring is several). Pass 1 compares each query with the blocks of the nearest
   rings that hold ``k`` rows; the k-th distance there is an upper bound
   ``D_q`` of the true one. Pass 2 compares it with the blocks left that have
   a ring whose lower bound is at most ``D_q``. Each true neighbour lies in one
   of them, so the top k are exact; pivots and quantiles only decide how much
   is pruned.
4. A block meets at most about ``TILE`` queries in a task: a matrix product
   gives the squared distances up to rounding, rows within the bound and a
   margin for rounding are measured again coordinate by coordinate, and the k
   nearest of each query go on. No pair of rows is ever a row of a table.

Where points lie apart in many dimensions, nothing can be pruned and the work
is that of all pairs, as matrix products, spread over tiles of bounded memory.

Rows with equal coordinates are cut to the ``k + 1`` smallest ids before
anything else (no others can be neighbours), so a point that a third of all
rows share costs ``k + 1`` rows. The cells' figures are at most
``MAX_PIVOTS * (d + 2 * MAX_PIVOTS + 4 * MAX_RINGS)`` numbers at any size;
they travel to the tasks in the closure.

Ties on distance are broken by the reference id. Rows with a null or NaN
coordinate have no neighbours and are none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .sampling import hash_key

MAX_PIVOTS = 256
MAX_RINGS = 64
#: Rows of a block and queries that meet it in a task, about.
TILE = 16_384
SLACK = 1e-9  # relative, for bounds and distances summed in different orders


def _matrix(v: pd.Series, d: int) -> np.ndarray:
    return np.stack(v.to_list()).astype(float) if len(v) else np.empty((0, d))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every row of ``x`` from every pivot, in blocks of rows."""
    out = np.empty((len(x), len(pivots)))
    for i in range(0, len(x), 64):
        out[i:i + 64] = np.sqrt(((x[i:i + 64, None, :] - pivots[None]) ** 2).sum(axis=2))
    return out


class Cells:
    """Pivots and distance bounds; rings are numbered over all cells."""

    def __init__(self, pivots: np.ndarray, cuts: list[np.ndarray]):
        self.pivots = pivots
        self.cuts = cuts  # per cell, the rings' upper ends but the last's
        self.first = np.cumsum([0] + [len(c) + 1 for c in cuts])  # a cell's first ring
        m, n = len(pivots), int(self.first[-1])
        self.lo, self.hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        self.ring_lo, self.ring_hi = np.full(n, np.inf), np.full(n, -np.inf)
        self.ring_rows = np.zeros(n, dtype=np.int64)
        self.ring_cell = np.repeat(np.arange(m), np.diff(self.first))

    def ring_of(self, dist: np.ndarray) -> np.ndarray:
        cell = dist.argmin(axis=1) if len(dist) else np.empty(0, dtype=int)
        own = dist[np.arange(len(dist)), cell]
        return np.array([self.first[c] + np.searchsorted(self.cuts[c], x) for c, x in zip(cell, own)], dtype=np.int64)

    def gaps(self, dist: np.ndarray) -> np.ndarray:
        """Distance from one query (its distances from the pivots) to each ring's interval."""
        own = dist[self.ring_cell]
        return np.maximum(np.maximum(own - self.ring_hi, self.ring_lo - own), 0.0)

    def nearest(self, dist: np.ndarray, need: int) -> np.ndarray:
        """The rings next to a query that hold ``need`` rows together."""
        order = np.lexsort((self.gaps(dist), dist[self.ring_cell]))
        order = order[self.ring_rows[order] > 0]
        return order[:int(np.searchsorted(np.cumsum(self.ring_rows[order]), need)) + 1]

    def within(self, dist: np.ndarray, bound: float) -> np.ndarray:
        """Every ring that can hold a row at distance ``bound`` or less."""
        low = np.maximum((dist - self.hi).max(axis=1), (self.lo - dist).max(axis=1))
        low = np.maximum(low[self.ring_cell], self.gaps(dist))
        return np.flatnonzero((self.ring_rows > 0) & (low <= bound + SLACK * (1.0 + dist.max())))


def fit_cells(ref: DataFrame, cols: list[str], id_col: str, per_cell: int = 64) -> Cells | None:
    """Cells of ``ref`` (no null or NaN coordinates); None where it is empty."""
    n = ref.count()
    if not n:
        return None
    d = len(cols)
    m = max(1, min(MAX_PIVOTS, n // per_cell))
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    picked = ref.select(vec.alias("v"), hash_key(id_col).alias("_o")).orderBy("_o", "v").limit(m).collect()
    pivots = np.unique(np.array([r["v"] for r in picked]), axis=0)

    def nearest(v):
        dist = _to_pivots(_matrix(v, d), pivots)
        cell = dist.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "dist": dist[np.arange(len(dist)), cell]})

    near = ref.select(F.pandas_udf(nearest, "cell int, dist double")(vec).alias("_n")).select("_n.*")
    grid = [i / MAX_RINGS for i in range(1, MAX_RINGS)]
    cuts = [np.empty(0)] * len(pivots)
    for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"),
                                      F.percentile_approx("dist", F.array(*map(F.lit, grid)), F.lit(1000)).alias("q")).collect():
        rings = max(1, min(MAX_RINGS, r["n"] // per_cell))
        at = np.unique(np.arange(1, rings) * MAX_RINGS // rings - 1).astype(int)
        cuts[r["cell"]] = np.unique(np.array(r["q"])[at])
    cells = Cells(pivots, cuts)
    size = (len(pivots), len(pivots))

    def bounds(frames):
        # one row per cell and pivot, and per ring, for each task
        lo, hi, rows = np.full(size, np.inf), np.full(size, -np.inf), {}
        for f in frames:
            dist = _to_pivots(_matrix(f["v"], d), pivots)
            cell = dist.argmin(axis=1)
            np.minimum.at(lo, cell, dist)
            np.maximum.at(hi, cell, dist)
            own = pd.DataFrame({"ring": cells.ring_of(dist), "x": dist[np.arange(len(dist)), cell]})
            for ring, a, b, k in own.groupby("ring")["x"].agg(["min", "max", "size"]).itertuples():
                p = rows.get(ring, (np.inf, -np.inf, 0))
                rows[ring] = min(p[0], a), max(p[1], b), p[2] + k
        c, p = np.nonzero(hi >= 0)
        yield pd.DataFrame({"a": c, "b": p, "lo": lo[c, p], "hi": hi[c, p], "n": 0})
        yield pd.DataFrame([(r, -1, *x) for r, x in rows.items()], columns=["a", "b", "lo", "hi", "n"])

    figures = ref.select(vec.alias("v")).mapInPandas(bounds, "a int, b int, lo double, hi double, n long") \
        .groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    for a, b, lo, hi, k in figures.toPandas().itertuples(index=False):
        if b < 0:
            cells.ring_lo[a], cells.ring_hi[a], cells.ring_rows[a] = lo, hi, k
        else:
            cells.lo[a, b], cells.hi[a, b] = lo, hi
    return cells


class Blocks:
    """Blocks of rings that follow one another: ``of`` has a ring's block, ``parts`` the
    number of tables that a block's rows are dealt to (1 but for rings of more than ``tile`` rows)."""

    def __init__(self, cells: Cells, tile: int):
        self.of = np.zeros(len(cells.ring_rows), dtype=np.int64)
        rows: list[int] = []
        for ring, n in enumerate(cells.ring_rows.tolist()):
            if not rows or rows[-1] and rows[-1] + n > tile:
                rows.append(0)
            self.of[ring] = len(rows) - 1
            rows[-1] += n
        self.parts = [max(1, -(-n // tile)) for n in rows]

    def near(self, cells: Cells, dist: np.ndarray, need: int) -> np.ndarray:
        """Blocks of the rings next to a query that hold ``need`` rows."""
        return np.unique(self.of[cells.nearest(dist, need)])

    def within(self, cells: Cells, dist: np.ndarray, bound: float, need: int) -> np.ndarray:
        """Blocks that can hold a row within ``bound``, without those of ``near``."""
        return np.setdiff1d(self.of[cells.within(dist, bound)], self.near(cells, dist, need))


def block_of(cells: Cells, blocks: Blocks, vec: Column) -> Column:
    """The block of each row, by its ring."""
    def fn(v: pd.Series) -> pd.Series:
        return pd.Series(blocks.of[cells.ring_of(_to_pivots(_matrix(v, cells.pivots.shape[1]), cells.pivots))])
    return F.pandas_udf(fn, "long")(vec)


def blocks_near(cells: Cells, blocks: Blocks, vec: Column, need: int) -> Column:
    """Numbers of the blocks of pass 1, per query."""
    def fn(v: pd.Series) -> pd.Series:
        return pd.Series([blocks.near(cells, x, need) for x in _to_pivots(_matrix(v, cells.pivots.shape[1]), cells.pivots)])
    return F.pandas_udf(fn, "array<long>")(vec)


def blocks_within(cells: Cells, blocks: Blocks, vec: Column, bound: Column, need: int) -> Column:
    """Numbers of the blocks of pass 2, per query."""
    def fn(v: pd.Series, d: pd.Series) -> pd.Series:
        dist = _to_pivots(_matrix(v, cells.pivots.shape[1]), cells.pivots)
        return pd.Series([blocks.within(cells, x, b, need) for x, b in zip(dist, d)])
    return F.pandas_udf(fn, "array<long>")(vec, bound)


def nearest_in_tile(q: np.ndarray, bound: np.ndarray, r: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None, k: int):
    """(query, row, distance) of the ``k`` nearest rows of ``r`` within ``bound`` of each row of
    ``q``, ties to the earlier row. ``same`` numbers the ids of both sides: equal ones are no pair."""
    d, out = q.shape[1], []
    middle = r.mean(axis=0)
    qc, rc = q - middle, r - middle
    qn, rn = (qc * qc).sum(axis=1), (rc * rc).sum(axis=1)
    # what rounding can add to a squared distance by products, and to a distance by centring
    eps = np.finfo(float).eps
    far = rn.max()
    wide = np.ascontiguousarray(np.concatenate([rc, rn[:, None]], axis=1).T)
    moved = 8 * eps * np.sqrt(d) * max(np.abs(q).max(), np.abs(r).max(), np.abs(middle).max())
    step = max(1, (1 << 22) // len(r))
    for i in range(0, len(q), step):
        some = slice(i, i + step)
        near = np.concatenate([-2 * qc[some], np.ones((len(qc[some]), 1))], axis=1) @ wide  # squared distance less qn
        limit = bound[some] * (1 + SLACK)
        slack = 16 * (d + 8) * eps * (qn[some] + far)
        limit = (limit + moved) ** 2 - qn[some] + slack
        # the k-th of the first rows is a bound too
        head = near[:, :2048]
        if head.shape[1] > k:
            if same is not None:
                head = np.where(same[0][some, None] == same[1][None, :head.shape[1]], np.inf, head)
            kth = np.sqrt(np.maximum(np.partition(head, k - 1, axis=1)[:, k - 1] + qn[some] + slack, 0.0)) * (1 + SLACK)
            limit = np.minimum(limit, (kth + 2 * moved) ** 2 - qn[some] + 2 * slack)
        a, b = np.nonzero(near <= limit[:, None])
        if same is not None:
            apart = same[0][i + a] != same[1][b]
            a, b = a[apart], b[apart]
        exact = np.zeros(len(a))
        for c in range(d):  # in the order of the columns
            x = q[i + a, c] - r[b, c]
            exact += x * x
        exact = np.sqrt(exact)
        keep = exact <= bound[i + a]
        a, b, exact = a[keep], b[keep], exact[keep]
        order = np.lexsort((b, exact, a))
        a, b, exact = a[order], b[order], exact[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        first = rank < k
        out.append((i + a[first], b[first], exact[first]))
    return tuple(np.concatenate([x[j] for x in out]) for j in range(3))


def tiles(q: DataFrame, r: DataFrame, qc: list[str], rc: list[str], k: int, n_query: int, blocks: Blocks,
          exclude_self: bool, label: bool) -> DataFrame:
    """q_id, r_id, dist[, r_label]: for each row of ``q`` (with ``_to``, the blocks it meets, and ``_d``) the
    ``k`` nearest rows of each table it meets."""
    parts = F.array(*(F.lit(n) for n in blocks.parts))
    # queries of a block come in as many chunks as keep a task near TILE queries
    chunks = max(1, -(-n_query // TILE))
    q = q.withColumn("_k", F.explode("_to")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.element_at(parts, (F.col("_k") + 1).cast("int")) - 1))) \
        .withColumn("_c", F.pmod(F.xxhash64("_i"), F.lit(chunks)).cast("int")).select("_k", "_p", "_c", "q_id", "_d", *qc)
    r = r.withColumn("_p", F.pmod(F.xxhash64("r_id"), F.element_at(parts, (F.col("_k") + 1).cast("int"))).cast("int")) \
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("_k", "_p", "_c", "r_id", *rc, *(["r_label"] if label else []))
    keys = ["_k", "_p", "_c"]
    n = min(2 * chunks * sum(blocks.parts), 4096)
    kinds = [f"q_id {q.schema['q_id'].dataType.simpleString()}", f"r_id {r.schema['r_id'].dataType.simpleString()}", "dist double"]
    if label:
        kinds.append(f"r_label {r.schema['r_label'].dataType.simpleString()}")

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right, [("r_id", "ascending")], null_placement="at_start"))
            matrix = lambda t, cols: np.column_stack([t.column(c).to_numpy() for c in cols])
            same = None
            if exclude_self:
                ids = right.column("r_id").combine_chunks().unique()
                same = (pc.fill_null(pc.index_in(left.column("q_id"), ids), -1).to_numpy(), pc.index_in(right.column("r_id"), ids).to_numpy())
            a, b, dist = nearest_in_tile(matrix(left, qc), left.column("_d").to_numpy(), matrix(right, rc), same, k)
        else:
            a, b, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        cols = {"q_id": left.column("q_id").take(pa.array(a)), "r_id": right.column("r_id").take(pa.array(b)), "dist": pa.array(dist)}
        if label:
            cols["r_label"] = right.column("r_label").take(pa.array(b))
        return pa.table(cols)

    return q.repartition(n, *keys).groupBy(*keys).cogroup(r.repartition(n, *keys).groupBy(*keys)).applyInArrow(run, ", ".join(kinds))


def _topk(pairs: DataFrame, k: int) -> DataFrame:
    """Keep the k nearest per query."""
    w = Window.partitionBy("q_id").orderBy("dist", "r_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _complete(cols: list[str]) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def knn(query: DataFrame, ref: DataFrame, cols: list[str], k: int = 5, q_id: str = "id",
        r_id: str = "id", label: str | None = None, exclude_self: bool = False,
        per_cell: int = 64) -> DataFrame:
    """The ``k`` nearest reference rows of every query row (Euclidean).

    Returns (q_id, r_id, dist, rank[, r_label]). ``exclude_self`` drops
    pairs with equal ids (self-neighbours when query and reference agree).
    """
    ship_package(query.sparkSession)
    more = ["r_label"] if label else []
    rc, qc = ["r_" + c for c in cols], ["q_" + c for c in cols]
    rv, qv = (F.array(*[F.col(c).cast("double") for c in x]) for x in (rc, qc))
    # equal points: only the smallest ids can be neighbours (limited before the shuffle)
    same = Window.partitionBy("_v").orderBy("r_id")
    r = ref.where(_complete(cols)).select(F.col(r_id).alias("r_id"), *[F.col(c).alias("r_" + c) for c in cols],
                                          *([F.col(label).alias("r_label")] if label else [])) \
        .withColumn("_v", rv).withColumn("_same", F.dense_rank().over(same)).where(F.col("_same") <= k + 1) \
        .drop("_same", "_v")
    # both sides are read by several jobs: written once to the shared checkpoint folder
    r = cut_lineage(r)
    q = cut_lineage(query.where(_complete(cols)).select(
        F.col(q_id).alias("q_id"), *[F.col(c).cast("double").alias("q_" + c) for c in cols], F.monotonically_increasing_id().alias("_i")))
    cells = fit_cells(r, rc, "r_id", max(per_cell, 4 * k))
    if cells is None:
        none = q.join(r, F.lit(False), "inner").select("q_id", "r_id", F.lit(0.0).alias("dist"), F.lit(1).alias("rank"), *more)
        return none.where(F.lit(False))
    if exclude_self:  # a null id is not known to be another one
        q, r = q.where(F.col("q_id").isNotNull()), r.where(F.col("r_id").isNotNull())
    blocks = Blocks(cells, TILE)
    r = cut_lineage(r.withColumn("_k", block_of(cells, blocks, rv)).select("r_id", "_k", *[F.col(c).cast("double").alias(c) for c in rc], *more))
    n_query = q.count()

    # pass 1: the k-th distance in the nearest blocks bounds the true one
    far = F.lit(float("inf"))
    p1 = cut_lineage(tiles(q.withColumn("_to", blocks_near(cells, blocks, qv, k + 1)).withColumn("_d", far), r, qc, rc, k, n_query, blocks,
                           exclude_self, bool(label)))
    bound = _topk(p1, k).groupBy("q_id").agg(F.max("dist").alias("_d"), F.count(F.lit(1)).alias("_m")) \
        .select("q_id", F.when(F.col("_m") >= k, F.col("_d")).alias("_d"))

    # pass 2: every other block that can hold a neighbour
    q2 = q.join(bound, "q_id", "left").withColumn("_d", F.coalesce("_d", far))
    q2 = q2.withColumn("_to", blocks_within(cells, blocks, qv, F.col("_d"), k + 1))
    p2 = tiles(q2, r, qc, rc, k, n_query, blocks, exclude_self, bool(label))
    return _topk(p1.unionByName(p2), k).select("q_id", "r_id", "dist", "rank", *more)


def knn_classify(query: DataFrame, ref: DataFrame, cols: list[str], label: str, k: int = 5,
                 id_col: str = "id") -> DataFrame:
    """Uniform-vote class-1 probability over the k nearest reference rows."""
    nn = knn(query, ref, cols, k, id_col, id_col, label)
    return nn.groupBy("q_id").agg((F.sum("r_label") / F.count(F.lit(1))).alias("y_prob")) \
        .withColumnRenamed("q_id", id_col)


def smote(df: DataFrame, cols: list[str], id_col: str, label: str, k: int = 5,
          seed: str = "42") -> DataFrame:
    """Synthetic minority rows ``x + g * (nn - x)`` up to the majority count.

    The neighbour ``nn`` is one of the k nearest minority rows of ``x``
    (exact, self excluded) and both the neighbour choice and the gap ``g``
    in [0, 1) come from the row hash, so the result is reproducible.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    mm = counts.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"),
                    F.min_by(label, F.struct("n", label)).alias("_minority")).first()
    need = int(mm["n_max"] - mm["n_min"])
    minority = df.where(F.col(label) == mm["_minority"])
    if need > 0 and mm["n_min"] < 2:
        raise ValueError("SMOTE needs at least two minority rows")
    if need <= 0:
        return df.sparkSession.createDataFrame([], minority.select(id_col, *cols).schema) \
            .withColumn("copy_no", F.lit(0))
    n_min = int(mm["n_min"])
    copies = -(-need // n_min)
    nn = knn(minority, minority, cols, k, id_col, id_col, exclude_self=True)
    from .prepare import replicate
    from .sampling import mark_first_k, md5_bucket
    mins = minority.select(F.col(id_col).alias("q_id"), *cols)
    # copies 1..c-1 are kept whole; only copy c is cut (rank over minority rows)
    last_k = need - n_min * (copies - 1)
    o = hash_key(F.concat_ws("|", F.col("q_id").cast("string"), F.lit(str(copies))), "|" + seed)
    last = mark_first_k(mins.withColumn("_o", o), [], ["_o", "q_id"], md5_bucket("_o", 4),
                        df.sparkSession.range(1).select(F.lit(last_k).alias("k")), "_in") \
        .where("_in").drop("_in", "_o").withColumn("copy_no", F.lit(copies))
    base = replicate(mins, copies - 1, "copy_no").unionByName(last)

    def draw(tag):
        return hash_key(F.concat_ws("|", F.col("q_id").cast("string"), F.col("copy_no").cast("string"),
                                    F.lit(tag)), "|" + seed)

    pick = F.pmod(F.conv(F.substr(draw("j"), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(min(k, n_min - 1))) + 1
    gap = F.conv(F.substr(draw("u"), F.lit(1), F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0)
    b = base.withColumn("rank", pick).withColumn("_g", gap)
    # the k neighbours of each minority row: k rows per query
    nb = nn.join(minority.select(F.col(id_col).alias("r_id"), *[F.col(c).alias("n_" + c) for c in cols]),
                 "r_id")
    j = b.join(nb, ["q_id", "rank"])
    return j.select(F.col("q_id").alias(id_col), "copy_no",
                    *[(F.col(c) + F.col("_g") * (F.col("n_" + c) - F.col(c))).alias(c) for c in cols])
