"""Second-order histogram boosting, random forests and single trees.

Features are binned once by exact quantiles of the fitted rows. A round takes
gradients and Hessians of the logistic loss at the rows' margins and grows one
tree: each level sums them per (leaf, feature, bin), a split gains

    1/2 (GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)) - min_gain

and both sides need a Hessian sum of ``min_child_weight``. Rows and columns
are sampled per tree by hashes. ``max_leaves`` grows leaf-wise: leaves are
split in the order of their gains until there are so many.

Gradients are whole numbers (units of 2^-20), so their sums do not depend on
the order of rows or on partitions: any layout of the data gives the same
trees, bit by bit.

Every level is one partial aggregate: tasks add up their rows, Spark sums by
(leaf, feature, bin) and finds each leaf's best split; the driver sees one row
per leaf. Margins are a written table, renewed every ``STATE_ROUNDS`` rounds, and
the trees since then are replayed from a closure. Up to ``task_rows`` rows (by
default as many as make ``TASK_CELLS`` bytes of bins) there is no job per level:
boosted rounds, each of which needs the one before, run in one task, and the trees
of a forest are dealt out, a group of drawn rows and a task per tree. All ways
give the same trees.

In a task a boosted split sums the rows of its smaller child; the sibling is the
parent without it. Leaf-wise growth splits the node of largest gain first, so it
tries no split beyond ``max_leaves``. A forest's level has sums only for cells that
hold rows, for the columns that may split the node, in chunks of ``CHUNK`` entries,
so memory does not grow with the number of leaves.

A fitted model is a table of nodes (tree, node, feature, cut, left, right,
value, gain, cover); a row goes left where its value is at most the cut. Null
and NaN values count as 0, as in ``models.assemble``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .sampling import hash_key

#: Gradients are counted in units of 1 / SCALE.
SCALE = 1 << 20
STATE_ROUNDS = 10
#: Bytes of bins (rows times columns) that one task takes.
TASK_CELLS = 1 << 26
#: Entries (rows times columns) that are summed at a time.
CHUNK = 1 << 18
#: Entries that a boosted node sums at a time, few enough for a core's cache.
BLOCK = 1 << 15
MOD = 2147483647
NODE_SCHEMA = ("tree int, node int, feature int, cut double, left int, right int, value double, gain double, "
               "cover double")


@dataclass(frozen=True)
class Profile:
    """How trees are grown. ``kind`` is ``boost`` (logistic loss, margins add up) or
    ``forest`` (each tree on its own rows, leaf value the share of class 1)."""
    rounds: int = 1000
    eta: float = 0.05
    depth: int = 6
    max_leaves: int | None = None
    l2: float = 1.0
    min_gain: float = 0.0
    min_child_weight: float = 1.0
    rows: int = 1000      # of a thousand, per tree
    columns: int = 1000   # of a thousand, per tree
    node_columns: int | None = None   # columns that may split a node
    bootstrap: bool = False           # rows count 0 to 5 times, as draws with replacement would
    bins: int = 64
    seed: int = 42
    kind: str = "boost"


#: Of a thousand rows, how many are drawn 0, at most 1, 2, 3 and 4 times (Poisson, mean 1).
DRAWS = (368, 736, 920, 981, 996)


@dataclass
class TreeModel:
    """Fitted trees: ``trees[k]`` is a list of (node, feature, bin, left, right, value, gain, cover)."""
    cols: list[str]
    cuts: list[list[float]]
    profile: Profile
    trees: list[list[tuple]]
    losses: list[float] = field(default_factory=list)

    @property
    def num_trees(self) -> int:
        return len(self.trees)

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = []
        for t, tree in enumerate(self.trees):
            for node, f, b, left, right, value, gain, cover in tree:
                rows.append((t, node, f, self.cuts[f][b] if f >= 0 else None, left, right, value, gain, cover))
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def first(self, rounds: int) -> "TreeModel":
        return TreeModel(self.cols, self.cuts, replace(self.profile, rounds=rounds), self.trees[:rounds], self.losses[:rounds])


# ---- steps on arrays, shared by both ways ------------------------------------------------------

def row_hash(key, r: int):
    """31-bit hash of a row's key in round ``r`` (numbers or arrays, no overflow in 64 bits)."""
    x = (key + 1009 * (r + 1)) % MOD * 48271 % MOD
    return (x + key) % MOD * 69621 % MOD


def tree_columns(n_cols: int, r: int, share: int, seed: int) -> list[int]:
    """Columns of tree ``r``: those with the least hashes, at least one."""
    take = max(1, n_cols * share // 1000)
    by_hash = sorted(range(n_cols), key=lambda c: (row_hash(c * 7919 + seed, r), c))
    return sorted(by_hash[:take])


def gradients(margin, y, weight):
    """Gradient and Hessian of the logistic loss in units of 1 / SCALE."""
    import numpy as np

    p = 1.0 / (1.0 + np.exp(-margin))
    return (np.floor((p - y) * weight * SCALE + 0.5), np.floor(p * (1.0 - p) * weight * SCALE + 0.5))


def sampled(key, r: int, p: Profile):
    return row_hash(key, r) % 1000 < p.rows


def node_choice(path: int, r: int, columns: list[int], p: Profile) -> list[int]:
    """Places in ``columns`` that may split the node at ``path`` (0 the root, children
    2 path + 1 and 2 path + 2) of tree ``r``."""
    if p.node_columns is None:
        return list(range(len(columns)))
    by_hash = sorted(range(len(columns)), key=lambda k: (row_hash((path % MOD) * 64 + columns[k], r), k))
    return sorted(by_hash[:p.node_columns])


def round_sums(margin, y, weight, key, r: int, p: Profile):
    """(g, h, rows used) of a round. A forest counts class 1 in g and rows in h."""
    use = sampled(key, r, p)
    if p.bootstrap:
        import numpy as np
        weight = weight * np.searchsorted(DRAWS, row_hash(key, r) % 1000, "right")
    if p.kind == "forest":
        import numpy as np
        return np.floor(y * weight * SCALE + 0.5), np.floor(weight * SCALE + 0.5), use
    g, h = gradients(margin, y, weight)
    return g, h, use


def histogram(bins, leaf, g, h, use, leaves: int, columns: list[int], n_bins: int):
    """Sums (2, leaves, columns, bins) of g and h; rows with leaf < 0 are finished."""
    import numpy as np

    at = np.flatnonzero(use & (leaf >= 0))
    width = len(columns)
    size = leaves * width * n_bins
    out = np.zeros((2, size))
    offsets = np.arange(width) * n_bins
    for lo in range(0, len(at), 8192):
        some = at[lo:lo + 8192]
        cells = (bins[some][:, columns] + (leaf[some] * (width * n_bins))[:, None] + offsets).ravel()
        for s, v in enumerate((g, h)):
            out[s] += np.bincount(cells, np.repeat(v[some], width), size)
    return out.reshape(2, leaves, width, n_bins)


def best_splits(hist, columns: list[int], p: Profile, paths: list[int], r: int):
    """Per leaf (gain, feature, bin, GL, HL, G, H); feature -1 where none gains."""
    import numpy as np

    g, h = hist.cumsum(axis=3)
    g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
    gains = split_gain(g, h, g_all, h_all, p)
    if p.node_columns is not None:
        for leaf, path in enumerate(paths):
            off = np.ones(len(columns), bool)
            off[node_choice(path, r, columns, p)] = False
            gains[leaf, off] = -1.0
    flat = gains.reshape(len(gains), -1)
    best = flat.argmax(axis=1)  # the first: least column, then least bin
    out = []
    for leaf, at in enumerate(best.tolist()):
        k, b = divmod(at, g.shape[2])
        gain = float(flat[leaf, at])
        out.append((gain, columns[k] if gain > 1e-6 else -1, b, float(g[leaf, k, b]), float(h[leaf, k, b]),
                    float(g_all[leaf, 0, 0]), float(h_all[leaf, 0, 0])))
    return out


def split_gain(gl, hl, g, h, p: Profile):
    """Gain of a cut after which the left side has (gl, hl) of (g, h), as arrays of sums;
    -1 where a side is too light."""
    import numpy as np

    gl, hl, g, h = (x / SCALE for x in (gl, hl, g, h))
    gr, hr = g - gl, h - hl
    light = (hl < p.min_child_weight) | (hr < p.min_child_weight)
    with np.errstate(divide="ignore", invalid="ignore"):  # empty sides are light
        if p.kind == "forest":  # Gini impurity, weighted by rows
            def mixed(a, n):
                return n - a * a / n - (n - a) * (n - a) / n
            gain = mixed(g, h) - mixed(gl, hl) - mixed(gr, hr)
        else:
            gain = 0.5 * (gl * gl / (hl + p.l2) + gr * gr / (hr + p.l2) - g * g / (h + p.l2)) - p.min_gain
    return np.where(light, -1.0, gain)


def leaf_value(g: float, h: float, p: Profile) -> float:
    g, h = g / SCALE, h / SCALE
    if p.kind == "forest":
        return g / h if h else 0.0
    return -g / (h + p.l2) * p.eta


class Grower:
    """One tree, level by level: give it the best splits of its open leaves, it says
    which leaves are open next. Leaf-wise growth keeps the splits of largest gain:
    levels go on while a new leaf could still be among them."""

    def __init__(self, p: Profile):
        self.p = p
        self.nodes: dict[int, list] = {}   # node -> [feature, bin, left, right, value, gain, cover]
        self.open, self.next_id, self.level = [0], 1, 0
        self.path = {0: 0}

    def add(self, splits: list[tuple]) -> None:
        p, opened = self.p, []
        for node, (gain, f, b, gl, hl, g, h) in zip(self.open, splits):
            self.nodes[node] = [-1, 0, -1, -1, leaf_value(g, h, p), 0.0, h / SCALE]
            if f >= 0 and self.level < p.depth:
                self.nodes[node][0:4] = [f, b, self.next_id, self.next_id + 1]
                self.nodes[node][5] = gain
                opened += [self.next_id, self.next_id + 1]
                self.path[self.next_id], self.path[self.next_id + 1] = 2 * self.path[node] + 1, 2 * self.path[node] + 2
                for child, cg, ch in ((self.next_id, gl, hl), (self.next_id + 1, g - gl, h - hl)):
                    self.nodes[child] = [-1, 0, -1, -1, leaf_value(cg, ch, p), 0.0, ch / SCALE]
                self.next_id += 2
        self.level += 1
        self.open = opened if self.level < p.depth else []
        if p.max_leaves is not None and self.open:
            kept = self.kept()
            # a later split only delays the ones left out, so these stay out
            alive = {c for n in kept for c in self.nodes[n][2:4]}
            self.open = [n for n in self.open if n in alive]

    def kept(self) -> set:
        """Split nodes of the leaf-wise tree, in order of gain, among the splits found."""
        import heapq

        heap, out = [(-self.nodes[0][5], 0)] if self.nodes[0][0] >= 0 else [], set()
        while heap and len(out) < self.p.max_leaves - 1:
            _, n = heapq.heappop(heap)
            out.add(n)
            for c in self.nodes[n][2:4]:
                if self.nodes[c][0] >= 0:
                    heapq.heappush(heap, (-self.nodes[c][5], c))
        return out

    def open_paths(self) -> list[int]:
        return [self.path[n] for n in self.open]

    def tree(self) -> list[tuple]:
        """The finished nodes, numbered from 0 in their order."""
        return self.numbered()[0]

    def numbered(self):
        """(finished nodes, number of the finished node that holds each node grown)."""
        import numpy as np

        keep, children = set(self.nodes), {n: v[2:4] for n, v in self.nodes.items()}
        if self.p.max_leaves is not None:
            kept = self.kept()
            keep = {0} | {c for n in kept for c in self.nodes[n][2:4]}
            for n in keep - kept:
                self.nodes[n][0:4] = [-1, 0, -1, -1]
                self.nodes[n][5] = 0.0
        number = {n: i for i, n in enumerate(sorted(keep))}
        place = np.zeros(self.next_id, np.int64)
        for n in range(self.next_id):
            if n in number:
                place[n] = number[n]
            for c in children.get(n, ()):
                if c >= 0:
                    place[c] = place[n]
        return [(number[n], v[0], v[1], number.get(v[2], -1), number.get(v[3], -1), v[4], v[5], v[6])
                for n, v in sorted(self.nodes.items()) if n in keep], place


class Packed:
    """A tree as arrays. The right child is numbered after the left one, and a leaf
    goes to itself, so that a level is one step for all rows. ``cuts`` gives cut
    values in place of bins."""

    def __init__(self, tree: list[tuple], cuts: list[list[float]] | None = None):
        import numpy as np

        if isinstance(tree, Nodes):
            split = tree.feature >= 0
            self.feature, self.value, self.depth = np.maximum(tree.feature, 0).astype(np.int32), np.asarray(tree.value), tree.depth()
            self.left = np.where(split, tree.left, np.arange(len(tree))).astype(np.int32)
            self.limit = np.full(len(tree), np.inf)
            if cuts is None:
                self.limit[split] = tree.bin[split]
            else:
                first = np.cumsum([0] + [len(c) for c in cuts])
                self.limit[split] = np.concatenate([np.asarray(c, float) for c in cuts])[first[tree.feature[split]] + tree.bin[split]]
            return
        split = [n[1] >= 0 for n in tree]
        self.feature = np.array([max(n[1], 0) for n in tree], np.int64)
        self.left = np.array([n[3] if s else n[0] for n, s in zip(tree, split)], np.int64)
        self.limit = np.array([(n[2] if cuts is None else cuts[n[1]][n[2]]) if s else np.inf for n, s in zip(tree, split)])
        self.value = np.array([n[5] for n in tree])
        level = [0] * len(tree)
        for n, s in zip(tree, split):
            if s:
                level[n[3]] = level[n[4]] = level[n[0]] + 1
        self.depth = max(level)

    def descend(self, x):
        """Node of each row of ``x``."""
        import numpy as np

        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = self.left[at] + (flat[base + self.feature[at]] > self.limit[at])
        return at

    def values(self, x):
        return self.value[self.descend(x)]


def log_loss_sum(margin, y, weight) -> float:
    import numpy as np

    return float((weight * (np.logaddexp(0.0, margin) - y * margin)).sum())


# ---- binning -------------------------------------------------------------------------------------

def quantile_cuts(df: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """Cuts per column: the distinct values at ranks ceil(k n / bins). Exact: a
    histogram over fine buckets of value finds the bucket of each rank, and only
    the distinct values of those buckets are ranked. At most ``bins`` numbers a
    column reach the driver."""
    return cuts_of(value_counts(df, cols), cols, bins)


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """How often each column has each value (c, x, n) with the value's bucket, written to the shared folder."""
    from .sampling import ordered_bucket

    spark = df.sparkSession
    long = df.select(F.explode(F.arrays_zip(
        F.array(*(F.lit(i) for i in range(len(cols)))).alias("c"),
        F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols)).alias("x"))).alias("v")) \
        .select(F.col("v.c").alias("c"), F.col("v.x").alias("x")).groupBy("c", "x").agg(F.count("*").alias("n"))
    path = scratch_path(spark, f"cuts-{_run()}")
    long.withColumn("bkt", ordered_bucket("x")).write.parquet(path)
    return spark.read.parquet(path)


def cuts_of(counts: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """The cuts of ``quantile_cuts`` from the table of ``value_counts``."""
    w = Window.partitionBy("c").orderBy("bkt")
    buckets = counts.groupBy("c", "bkt").agg(F.sum("n").alias("n")).withColumn("cum", F.sum("n").over(w)) \
        .withColumn("all", F.sum("n").over(Window.partitionBy("c")))
    # cuts k with rank in (cum - n, cum]
    first, last = F.floor((F.col("cum") - F.col("n")) * bins / F.col("all")) + 1, F.floor(F.col("cum") * bins / F.col("all"))
    hit = buckets.where(first <= last).select("c", "bkt", (F.col("cum") - F.col("n")).alias("before"), "all")
    inside = counts.join(F.broadcast(hit), ["c", "bkt"])
    w2 = Window.partitionBy("c", "bkt").orderBy("x")
    ranked = inside.withColumn("to", F.col("before") + F.sum("n").over(w2)).withColumn("from", F.col("to") - F.col("n"))
    lo, hi = F.floor(F.col("from") * bins / F.col("all")) + 1, F.floor(F.col("to") * bins / F.col("all"))
    out = [[] for _ in cols]
    for r in ranked.where((lo <= hi) & (lo < bins)).select("c", "x").collect():
        out[r["c"]].append(r["x"])
    return [sorted(v) for v in out]


def _run() -> str:
    import uuid

    return uuid.uuid4().hex


def binned(df: DataFrame, id_col: str, cols: list[str], label: str, cuts: list[list[float]], seed: int = 42,
           weight: str | None = None, valid: str | None = None) -> DataFrame:
    """key, y, weight, valid, bins (a byte per feature) per row of ``df``."""
    ship_package(df.sparkSession)
    edges = [list(c) for c in cuts]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            x = np.zeros((n, len(edges)), np.uint8)
            for k, e in enumerate(edges):
                v = b.column(4 + k).to_numpy(zero_copy_only=False).astype(float)
                x[:, k] = np.searchsorted(np.array(e), np.where(np.isnan(v), 0.0, v), "left")
            flat = pa.py_buffer(x.tobytes())
            offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * len(edges)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.Array.from_buffers(pa.binary(), n, [None, offsets, flat])],
                names=["key", "y", "weight", "valid", "bins"])

    key = F.conv(F.substr(hash_key(id_col, f"|{seed}"), F.lit(1), F.lit(8)), 16, 10).cast("long") % MOD
    chosen = df.select(
        key.alias("key"), F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        (F.col(valid) if valid else F.lit(False)).alias("valid"),
        *(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(cols)))
    return chosen.mapInArrow(run, "key long, y double, weight double, valid boolean, bins binary")


def _arrays(b, width: int):
    """(key, y, weight, valid, bins) of an Arrow batch as arrays."""
    import numpy as np

    n = b.num_rows
    col = b.column(b.schema.get_field_index("bins"))
    raw = b"".join(v.as_py() for v in col)
    bins = np.frombuffer(raw, np.uint8).reshape(n, width)
    key, y, w, valid = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "y", "weight", "valid"))
    return key.astype(np.int64), y.astype(float), w.astype(float), valid.astype(bool), bins


# ---- fitting ---------------------------------------------------------------------------------------

@dataclass
class Binned:
    """Cuts per column and the written table of ``binned`` with its rows, for any profile with its bins and seed."""
    cuts: list[list[float]]
    table: DataFrame
    rows: int


def bin_table(df: DataFrame, id_col: str, cols: list[str], label: str, bins: int, seed: int = 42, weight: str | None = None,
              valid: str | None = None, counts: DataFrame | None = None) -> Binned:
    """Bins of ``df``, cut at quantiles of the rows whose ``valid`` flag is not set; ``counts`` are
    the ``value_counts`` of these rows where they are there already."""
    if bins > 256:
        raise ValueError("a bin is one byte: at most 256 bins")
    if counts is None:
        counts = value_counts(df if valid is None else df.where(~F.col(valid)), cols)
    cuts = cuts_of(counts, cols, bins)
    path = scratch_path(df.sparkSession, f"binned-{_run()}")
    binned(df, id_col, cols, label, cuts, seed, weight, valid).write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    return Binned(cuts, table, table.count())


def fit(df: DataFrame, id_col: str, cols: list[str], label: str, profile: Profile = Profile(),
        weight: str | None = None, valid: str | None = None, patience: int | None = None,
        task_rows: int | None = None, ready: Binned | None = None) -> TreeModel:
    """Fit on the rows of ``df`` whose ``valid`` flag is not set; with ``patience``,
    stop once the flagged rows' loss has not fallen for so many rounds and keep
    the rounds up to the best. No round after that is fitted. ``ready`` is the
    ``bin_table`` of the same rows, columns, bins and seed, if there is one."""
    ready = ready or bin_table(df, id_col, cols, label, profile.bins, profile.seed, weight, valid)
    if ready.rows == 0:
        raise ValueError("no rows to fit")
    if task_rows is None:
        task_rows = TASK_CELLS // max(len(cols), 1)
    way = _fit_by_jobs if ready.rows > task_rows else _fit_apart if _apart(profile) and patience is None else _fit_in_task
    trees, losses = way(ready.table, len(cols), profile, patience)
    model = TreeModel(list(cols), ready.cuts, profile, trees, losses)
    if patience is not None and losses:
        model.trees = model.trees[:losses.index(min(losses)) + 1]
    return model


def stop(losses: list[float], patience: int | None) -> bool:
    """The lowest loss is ``patience`` rounds old."""
    return patience is not None and bool(losses) and len(losses) - 1 - losses.index(min(losses)) >= patience


def grow_all(key, y, w, valid, bins, p: Profile, patience: int | None = None):
    """(trees, losses) of all rounds over arrays."""
    import numpy as np

    margin, by_column = np.zeros(len(y)), np.ascontiguousarray(bins.T)
    trees, losses = [], []
    for r in range(p.rounds):
        if _apart(p):
            tree = grow_apart(key[~valid], y[~valid], w[~valid], bins[~valid], p, r)
            trees.append(tree.rows())
            margin = margin + Packed(trees[-1]).values(bins)
        else:
            tree, values = _grow_round(key, y, w, valid, bins, by_column, margin, p, r)
            trees.append(tree)
            margin = margin + values
        if valid.any():
            losses.append(log_loss_sum(margin[valid], y[valid], w[valid]) / float(w[valid].sum()))
            if stop(losses, patience):
                break
    return trees, losses


def _grow_round(key, y, w, valid, bins, by_column, margin, p: Profile, r: int):
    """(tree, its value for each row). Nodes are split one by one, with sums for the smaller child;
    with ``max_leaves`` the node of largest gain comes next, and no split is tried that is not kept."""
    import heapq

    import numpy as np

    g, h, use = round_sums(margin, y, w, key, r, p)
    columns = tree_columns(bins.shape[1], r, p.columns, p.seed)
    some = bins if len(columns) == bins.shape[1] else np.ascontiguousarray(bins[:, columns])
    fits = use & ~valid
    others, rows = np.flatnonzero(~fits), np.flatnonzero(fits)
    hist = _node_sums(some, rows, g, h, p.bins)
    total = hist[:, 0].sum(axis=1).tolist()
    # nodes are named by their paths, which are in the order of levels, left to right
    nodes = {0: [-1, 0, *total, 0.0]}   # path -> [feature, bin, G, H, gain]
    held = {0: (rows, others)}          # rows of the leaves: those that fit, the others
    queue: list[tuple] = []             # splits to come

    def tries(path: int) -> bool:
        """Whether the node can be split: not too deep, and both sides can be heavy enough."""
        return (path + 1).bit_length() - 1 < p.depth and nodes[path][3] / SCALE >= 2 * p.min_child_weight

    def offer(paths: list[int], hists: list) -> None:
        for path, sums, (gain, f, b, gl, hl, _, _) in zip(paths, hists, best_splits(np.stack(hists, axis=1), columns, p, paths, r)):
            if f >= 0:
                heapq.heappush(queue, (-path if p.max_leaves is None else -gain, path, gain, f, b, gl, hl, sums))

    if tries(0):
        offer([0], [hist])
    left = float("inf") if p.max_leaves is None else p.max_leaves - 1
    while queue and left > 0:
        _, path, gain, f, b, gl, hl, hist = heapq.heappop(queue)
        left -= 1
        node = nodes[path]
        node[0], node[1], node[4] = f, b, gain
        two = (2 * path + 1, 2 * path + 2)
        nodes[two[0]], nodes[two[1]] = [-1, 0, gl, hl, 0.0], [-1, 0, node[2] - gl, node[3] - hl, 0.0]
        sides = []
        for at in held.pop(path):
            right = by_column[f].take(at) > b
            sides.append((at[~right], at[right]))
        held[two[0]], held[two[1]] = zip(*sides)
        due = [k for k in (0, 1) if tries(two[k])] if left > 0 else []
        if due:
            light = int(len(held[two[1]][0]) < len(held[two[0]][0]))
            small = _node_sums(some, held[two[light]][0], g, h, p.bins)
            offer([two[k] for k in due], [small if k == light else hist - small for k in due])
    number = {path: k for k, path in enumerate(sorted(nodes))}
    tree, value = [], np.empty(len(y))
    for path in number:
        f, b, sg, sh, gain = nodes[path]
        v = leaf_value(sg, sh, p)
        if path in held:
            for at in held[path]:
                value[at] = v
        tree.append((number[path], f, b, number.get(2 * path + 1, -1), number.get(2 * path + 2, -1), v, gain, sh / SCALE))
    return tree, value


def _node_sums(bins, rows, g, h, n_bins: int):
    """Sums (2, columns, bins) of g and h of ``rows``."""
    import numpy as np

    width = bins.shape[1]
    out, first = np.zeros((2, width * n_bins)), np.arange(width) * n_bins
    step = max(1, BLOCK // width)
    for lo in range(0, len(rows), step):
        at = rows[lo:lo + step]
        cells = (bins.take(at, axis=0) + first).ravel()
        for k, v in enumerate((g, h)):
            out[k] += np.bincount(cells, np.repeat(v.take(at), width), width * n_bins)
    return out.reshape(2, width, n_bins)


# ---- trees that do not need each other -----------------------------------------------------------

def _apart(p: Profile) -> bool:
    """Whether each tree of the profile is grown by itself, without a limit of leaves."""
    return p.kind == "forest" and p.max_leaves is None and p.depth <= 60


@dataclass(eq=False)
class Nodes:
    """A tree's nodes as arrays, in order of their numbers; reads as a list of node tuples."""
    feature: object
    bin: object
    left: object
    value: object
    gain: object
    cover: object

    def columns(self) -> list:
        """node, feature, bin, left, right, value, gain, cover."""
        import numpy as np

        return [np.arange(len(self.feature)), self.feature, self.bin, self.left, np.where(self.left >= 0, self.left + 1, -1),
                self.value, self.gain, self.cover]

    def rows(self) -> list[tuple]:
        return list(zip(*(c.tolist() for c in self.columns())))

    def __len__(self) -> int:
        return len(self.feature)

    def __iter__(self):
        return iter(self.rows())

    def __getitem__(self, k):
        return self.rows()[k]

    def __eq__(self, other) -> bool:
        return self.rows() == list(other)

    def depth(self) -> int:
        import numpy as np

        at, out = np.zeros(1, np.int64), 0
        while (at := at[self.feature[at] >= 0]).size:
            at, out = np.concatenate([self.left[at], self.left[at] + 1]), out + 1
        return out


def chosen_columns(paths, r: int, columns: list[int], p: Profile):
    """``node_choice`` for many nodes: a row of places in ``columns`` per path."""
    import numpy as np

    if p.node_columns is None or p.node_columns >= len(columns):
        return np.tile(np.arange(len(columns)), (len(paths), 1))
    keys = row_hash((paths % MOD)[:, None] * 64 + np.array(columns)[None], r)
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :p.node_columns], axis=1)


def cell_sums(cells, g, h, size: int):
    """(cells that hold entries, ascending, sums of g, of h)."""
    import numpy as np

    if size <= 16 * len(cells):
        n, sg, sh = np.bincount(cells, minlength=size), np.bincount(cells, g, size), np.bincount(cells, h, size)
        found = np.flatnonzero(n)
        return found, sg[found], sh[found]
    found, at = np.unique(cells, return_inverse=True)
    return found, np.bincount(at, g, len(found)), np.bincount(at, h, len(found))


def sparse_splits(bins, rows, starts, g, h, g_all, h_all, chosen, columns, p: Profile):
    """Best split per leaf as arrays (gain, feature, bin). ``rows`` lie leaf by leaf
    (``starts`` has the begin of each and the end), ``chosen`` has a leaf's places in ``columns``."""
    import numpy as np

    columns, per = np.array(columns), chosen.shape[1]
    n = len(chosen)
    gain, feature, cut = np.full(n, -1.0), np.full(n, -1), np.zeros(n, np.int64)
    block = max(1, CHUNK // per)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + block, "right")) - 1)
        found, sums = [], []
        for a in range(starts[lo], starts[hi], block):
            z = min(a + block, starts[hi])
            leaf = np.searchsorted(starts, np.arange(a, z), "right") - 1
            some = rows[a:z]
            entry = bins[some[:, None], columns[chosen[leaf]]] + ((leaf - lo)[:, None] * per + np.arange(per)) * p.bins
            cells, sg, sh = cell_sums(entry.ravel(), np.repeat(g[some], per), np.repeat(h[some], per), (hi - lo) * per * p.bins)
            found.append(cells)
            sums.append((sg, sh))
        cells, sg, sh = found[0], *sums[0]
        if len(found) > 1:  # one leaf of many rows
            cells, sg, sh = cell_sums(np.concatenate(found), np.concatenate([x[0] for x in sums]), np.concatenate([x[1] for x in sums]),
                                      (hi - lo) * per * p.bins)
        column, leaf = cells // p.bins, cells // (per * p.bins)
        first = np.flatnonzero(np.diff(column, prepend=-1))
        run = np.cumsum(np.diff(column, prepend=-1) > 0) - 1
        gl, hl = np.cumsum(sg), np.cumsum(sh)
        gl, hl = gl - (gl[first] - sg[first])[run], hl - (hl[first] - sh[first])[run]
        score = split_gain(gl, hl, g_all[lo + leaf], h_all[lo + leaf], p)
        begins = np.flatnonzero(np.diff(leaf, prepend=-1))
        top = np.maximum.reduceat(score, begins)
        hit = np.flatnonzero(score == top[np.cumsum(np.diff(leaf, prepend=-1) > 0) - 1])
        at = hit[np.searchsorted(leaf[hit], leaf[begins])]  # least column, then least bin
        to = lo + leaf[at]
        gain[to] = score[at]
        feature[to] = np.where(score[at] > 1e-6, columns[chosen[to, column[at] % per]], -1)
        cut[to] = cells[at] % p.bins
        lo = hi
    return gain, feature, cut


def grow_apart(key, y, w, bins, p: Profile, r: int) -> Nodes:
    """Tree ``r`` of a forest over arrays."""
    import numpy as np

    g, h, use = round_sums(np.zeros(len(y)), y, w, key, r, p)
    rows = np.flatnonzero(use & ((g != 0) | (h != 0)))
    columns = tree_columns(bins.shape[1], r, p.columns, p.seed)
    slot, paths, out, total = np.zeros(len(rows), np.int64), np.zeros(1, np.int64), [], 0
    for level in range(p.depth + 1):
        n = len(paths)
        g_all, h_all = np.bincount(slot, g[rows], n), np.bincount(slot, h[rows], n)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(h_all != 0, (g_all / SCALE) / (h_all / SCALE), 0.0)
        feature, cut, gain = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        # nodes of one class or too few rows cannot gain
        due = (g_all != 0) & (g_all != h_all) & (h_all >= 2 * p.min_child_weight * SCALE) if level < p.depth else np.zeros(n, bool)
        total += n
        left = np.full(n, -1)
        if due.any():
            keep = due[slot]
            rows, slot = rows[keep], slot[keep]
            number = np.cumsum(due) - 1
            order = np.argsort(number[slot], kind="stable")
            rows, slot = rows[order], slot[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(number[slot], minlength=int(due.sum())))])
            got = sparse_splits(bins, rows, starts, g, h, g_all[due], h_all[due], chosen_columns(paths[due], r, columns, p), columns, p)
            feature[due], cut[due] = got[1], np.where(got[1] >= 0, got[2], 0)
            gain[due] = np.where(got[1] >= 0, got[0], 0.0)
        split = feature >= 0
        left[split] = total + 2 * np.arange(int(split.sum()))
        out.append((feature, cut, left, value, gain, h_all / SCALE))
        if not split.any():
            break
        keep = split[slot]
        rows, slot = rows[keep], slot[keep]
        right = bins[rows, feature[slot]] > cut[slot]
        slot = 2 * (np.cumsum(split) - 1)[slot] + right
        paths = np.stack([2 * paths[split] + 1, 2 * paths[split] + 2], axis=1).ravel()
    return Nodes(*(np.concatenate([x[k] for x in out]) for k in range(6)))


def _fit_in_task(table: DataFrame, width: int, p: Profile, patience: int | None):
    """All rounds over one partition of at most ``task_rows`` rows."""
    ship_package(table.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = [_arrays(b, width) for b in batches]
        key, y, w, valid, bins = (np.concatenate([q[k] for q in parts]) for k in range(5))
        trees, losses = grow_all(key, y, w, valid, bins, p, patience)
        out = [(r, *n) for r, tree in enumerate(trees) for n in tree]
        for r, x in enumerate(losses):
            out.append((-1 - r, -1, -1, 0, -1, -1, x, 0.0, 0.0))
        kinds = [pa.int32()] * 6 + [pa.float64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array([n[k] for n in out], t) for k, t in enumerate(kinds)],
                                         names=["tree", "node", "feature", "bin", "left", "right", "value", "gain", "cover"])

    got = table.coalesce(1).mapInArrow(
        run, "tree int, node int, feature int, bin int, left int, right int, value double, gain double, cover double").collect()
    trees: list[list[tuple]] = []
    losses: dict[int, float] = {}
    for r in got:  # at most the model's nodes
        if r["tree"] < 0:
            losses[-1 - r["tree"]] = r["value"]
            continue
        while len(trees) <= r["tree"]:
            trees.append([])
        trees[r["tree"]].append(tuple(r)[1:])
    return trees, [losses[k] for k in sorted(losses)]


def _fit_apart(table: DataFrame, width: int, p: Profile, patience: int | None):
    """A task per tree over the rows drawn for it. The nodes come to the driver as arrays."""
    import numpy as np

    ship_package(table.sparkSession)
    kinds = "node int, feature int, bin int, left int, right int, value double, gain double, cover double"

    def run(group, rows):
        import numpy as np
        import pyarrow as pa

        r = group[0].as_py()
        parts = [_arrays(b, width) for b in rows.to_batches()]
        tree = grow_apart(*(np.concatenate([q[k] for q in parts]) for k in (0, 1, 2, 4)), p, r)
        types = [pa.int32()] * 5 + [pa.float64()] * 3
        return pa.Table.from_arrays([pa.array(np.full(len(tree.feature), r), pa.int32()),
                                     *(pa.array(c, t) for c, t in zip(tree.columns(), types))],
                                    names=["tree", "node", "feature", "bin", "left", "right", "value", "gain", "cover"])

    def hashed(key, r):
        x = (key + F.lit(1009) * (r + 1)) % MOD * 48271 % MOD
        return (x + key) % MOD * 69621 % MOD

    each = table.where("not valid").select(
        "key", "y", "weight", "valid", "bins", F.explode(F.sequence(F.lit(0), F.lit(p.rounds - 1))).alias("tree"))
    draw = hashed(F.col("key"), F.col("tree").cast("long")) % 1000
    drawn = each.where(draw < p.rows)
    if p.bootstrap:
        drawn = drawn.where(draw >= DRAWS[0])  # others count 0 times
    got = drawn.repartition(p.rounds, "tree").groupBy("tree").applyInArrow(run, f"tree int, {kinds}").toArrow()
    got = got.sort_by([("tree", "ascending"), ("node", "ascending")])
    nothing = [(0, -1, 0, -1, -1, 0.0, 0.0, 0.0)]  # a tree without rows
    trees: list = [nothing] * p.rounds
    tree = got.column("tree").to_numpy()
    ends = np.searchsorted(tree, np.arange(p.rounds + 1))
    for r in range(p.rounds):
        if ends[r] < ends[r + 1]:
            part = got.slice(int(ends[r]), int(ends[r + 1] - ends[r]))
            trees[r] = Nodes(*(part.column(c).to_numpy() for c in ("feature", "bin", "left", "value", "gain", "cover")))
    return trees, []


def _growing(grower: Grower) -> list[tuple]:
    """Nodes found so far by node id."""
    blank = [-1, 0, -1, -1, 0.0, 0.0, 0.0]
    return [(n, *grower.nodes.get(n, blank)) for n in range(grower.next_id)]


def _fit_by_jobs(table: DataFrame, width: int, p: Profile, patience: int | None):
    """One partial aggregate a level over all partitions."""
    spark = table.sparkSession
    ship_package(spark)
    trees: list[list[tuple]] = []
    losses: list[float] = []
    state, done = table.withColumn("margin", F.lit(0.0)), 0

    def margins(b, bins, since):
        import numpy as np

        m = np.array(b.column(b.schema.get_field_index("margin")).to_pylist(), float)
        for t in since:
            m = m + Packed(t).values(bins)
        return m

    for r in range(p.rounds):
        if r - done >= STATE_ROUNDS and p.kind == "boost":
            state, done = _renewed(state, width, trees[done:], margins), r
        columns, grower = tree_columns(width, r, p.columns, p.seed), Grower(p)
        since = trees[done:] if p.kind == "boost" else []
        while grower.open:
            grower.add(_level(state, width, p, r, columns, grower, since, margins))
        trees.append(grower.tree())
        if patience is not None:
            losses.append(_valid_loss(state, width, trees[done:], margins))
            if stop(losses, patience):
                break
    return trees, losses


def _renewed(state: DataFrame, width: int, since, margins) -> DataFrame:
    """The margin table after ``since``, written to the shared folder."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            m = margins(b, _arrays(b, width)[4], since)
            yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(m))

    path = scratch_path(state.sparkSession, f"margins-{_run()}")
    state.mapInArrow(run, state.schema).write.parquet(path)
    return state.sparkSession.read.parquet(path)


def _valid_loss(state: DataFrame, width: int, since, margins) -> float:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            _, y, w, _, bins = _arrays(b, width)
            yield pa.RecordBatch.from_arrays([pa.array([log_loss_sum(margins(b, bins, since), y, w)]), pa.array([float(w.sum())])],
                                             names=["loss", "weight"])

    r = state.where("valid").mapInArrow(run, "loss double, weight double").agg(F.sum("loss").alias("l"), F.sum("weight").alias("w")).first()
    return r["l"] / r["w"]


def _level(state: DataFrame, width: int, p: Profile, r: int, columns: list[int], grower: Grower, since, margins):
    """Best split per open leaf. The gain is worked out where the cells are summed."""
    leaves, tree, paths = list(grower.open), _growing(grower), grower.open_paths()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        # few cells are added up over the task; many are handed on chunk by chunk, those that hold rows
        size = len(leaves) * len(columns) * p.bins
        total = np.zeros((2, size)) if size <= 8 * CHUNK else None
        allowed = np.zeros((len(leaves), len(columns)), bool)
        for k, path in enumerate(paths):
            allowed[k, node_choice(path, r, columns, p)] = True
        slot = np.full(len(tree), -1)
        slot[leaves] = np.arange(len(leaves))
        packed = Packed(tree)

        def batch(cells, g, h):
            k, b = np.divmod(cells, p.bins)
            return pa.RecordBatch.from_arrays(
                [pa.array((k // len(columns)).astype(np.int32)), pa.array((k % len(columns)).astype(np.int32)),
                 pa.array(b.astype(np.int32)), pa.array(g.astype(np.int64)), pa.array(h.astype(np.int64))],
                names=["leaf", "k", "bin", "g", "h"])

        for b in batches:
            key, y, w, valid, bins = _arrays(b, width)
            g, h, use = round_sums(margins(b, bins, since), y, w, key, r, p)
            leaf = slot[packed.descend(bins)]
            at = np.flatnonzero(use & ~valid & (leaf >= 0) & ((g != 0) | (h != 0)))
            step = max(1, CHUNK // len(columns))
            for lo in range(0, len(at), step):
                some = at[lo:lo + step]
                open_cells = allowed[leaf[some]]
                cells = ((leaf[some] * len(columns))[:, None] + np.arange(len(columns))) * p.bins + bins[some][:, columns]
                cells, reps = cells[open_cells], open_cells.sum(axis=1)
                found, sg, sh = cell_sums(cells, np.repeat(g[some], reps), np.repeat(h[some], reps), size)
                if total is None:
                    yield batch(found, sg, sh)
                else:
                    total[0, found] += sg
                    total[1, found] += sh
        if total is not None:
            found = np.flatnonzero((total[0] != 0) | (total[1] != 0))
            yield batch(found, total[0, found], total[1, found])

    cells = state.mapInArrow(run, "leaf int, k int, bin int, g long, h long").groupBy("leaf", "k", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"))
    w = Window.partitionBy("leaf", "k")
    sums = cells.select("leaf", "k", "bin", F.sum("g").over(w.orderBy("bin")).alias("gl"), F.sum("h").over(w.orderBy("bin")).alias("hl"),
                        F.sum("g").over(w).alias("g"), F.sum("h").over(w).alias("h"))
    gl, hl, g, h = (F.col(c) / F.lit(float(SCALE)) for c in ("gl", "hl", "g", "h"))
    gr, hr = g - gl, h - hl
    light = (hl < p.min_child_weight) | (hr < p.min_child_weight)
    if p.kind == "forest":
        def mixed(a, n):
            n0 = F.nullif(n, F.lit(0.0))
            return n - a * a / n0 - (n - a) * (n - a) / n0
        gain = mixed(g, h) - mixed(gl, hl) - mixed(gr, hr)
    else:
        gain = F.lit(0.5) * (gl * gl / (hl + F.lit(p.l2)) + gr * gr / (hr + F.lit(p.l2)) - g * g / (h + F.lit(p.l2))) - F.lit(p.min_gain)
    scored = sums.withColumn("gain", F.when(light, F.lit(-1.0)).otherwise(gain))
    # largest gain, then least column, then least bin; one row a leaf reaches the driver
    best = scored.groupBy("leaf").agg(F.max_by(F.struct("gain", "k", "bin", "gl", "hl", "g", "h"),
                                               F.struct("gain", (-F.col("k")).alias("a"), (-F.col("bin")).alias("b"))).alias("s"))
    out = [(-1.0, -1, 0, 0.0, 0.0, 0.0, 0.0)] * len(leaves)
    for row in best.collect():
        s = row["s"]
        out[row["leaf"]] = (s["gain"], columns[s["k"]] if s["gain"] > 1e-6 else -1, s["bin"],
                            float(s["gl"]), float(s["hl"]), float(s["g"]), float(s["h"]))
    return out


# ---- scoring -----------------------------------------------------------------------------------------

def score(model: TreeModel, df: DataFrame, id_col: str, label: str, out: str = "y_prob") -> DataFrame:
    """Class-1 probability per row: the nodes travel in the closure (their size is the
    model's, whatever the rows), and a batch goes down one tree after another."""
    ship_package(df.sparkSession)
    packed, width, kind = [Packed(t, model.cuts) for t in model.trees], len(model.cols), model.profile.kind

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.empty((b.num_rows, width))
            for k in range(width):
                v = b.column(2 + k).to_numpy(zero_copy_only=False).astype(float)
                x[:, k] = np.where(np.isnan(v), 0.0, v)
            m = np.zeros(len(x))
            for t in packed:
                m = m + t.values(x)
            prob = m / max(len(packed), 1) if kind == "forest" else 1.0 / (1.0 + np.exp(-m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prob)], names=[id_col, "y_true", out])

    types = df.schema[id_col].dataType.simpleString(), df.schema[label].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(label).alias("_y"),
                     *(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(model.cols))).mapInArrow(
        run, f"{id_col} {types[0]}, y_true {types[1]}, {out} double")


def save(model: TreeModel, spark: SparkSession, path: str) -> None:
    """The node table and one row on the model, as Parquet."""
    import json

    model.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    about = json.dumps({"cols": model.cols, "kind": model.profile.kind, "trees": model.num_trees})
    spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> TreeModel:
    """A saved model; its node table alone decides the scores."""
    import json

    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    trees: list[list[tuple]] = [[] for _ in range(about["trees"])]
    cuts: list[list[float]] = [[] for _ in about["cols"]]
    # a row per node: the model's size, whatever the data
    for n in sorted(spark.read.parquet(f"{path}/nodes").collect(), key=lambda n: (n["tree"], n["node"])):
        b = 0
        if n["feature"] >= 0:
            b = len(cuts[n["feature"]])
            cuts[n["feature"]].append(n["cut"])
        trees[n["tree"]].append((n["node"], n["feature"], b, n["left"], n["right"], n["value"], n["gain"], n["cover"]))
    return TreeModel(about["cols"], cuts, Profile(rounds=len(trees), kind=about["kind"]), trees)


def score_sql(nodes: DataFrame, df: DataFrame, cols: list[str], id_col: str, label: str, kind: str = "boost",
              out: str = "y_prob") -> DataFrame:
    """The same scores from a node table in DataFrame steps: each row meets each
    tree's root and goes down by joins on (tree, node). For checks and small sets:
    it makes a row per tree."""
    roots = nodes.where("node = 0").select("tree", F.lit(0).alias("node"))
    x = F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols))
    at = df.select(F.col(id_col).alias("_id"), F.col(label).alias("y_true"), x.alias("x")).crossJoin(F.broadcast(roots))
    depth = nodes.where("feature >= 0").count() and _depth(nodes)
    n = F.broadcast(nodes.select("tree", "node", "feature", "cut", "left", "right"))
    for _ in range(depth):
        at = at.join(n, ["tree", "node"]).select(
            "_id", "y_true", "x", "tree",
            F.when(F.col("feature") < 0, F.col("node")).when(
                F.get("x", F.col("feature")) <= F.col("cut"), F.col("left")).otherwise(F.col("right")).alias("node"))
    v = at.join(F.broadcast(nodes.select("tree", "node", "value")), ["tree", "node"]).groupBy("_id", "y_true").agg(
        F.sum("value").alias("m"), F.count("*").alias("t"))
    prob = F.col("m") / F.col("t") if kind == "forest" else F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m")))
    return v.select(F.col("_id").alias(id_col), "y_true", prob.alias(out))


def _depth(nodes: DataFrame) -> int:
    """Longest path of a node table, by its (few) rows."""
    level: dict[tuple[int, int], int] = {}
    deepest = 0
    for r in sorted(nodes.select("tree", "node", "feature", "left", "right").collect(), key=lambda r: (r["tree"], r["node"])):
        d = level.get((r["tree"], r["node"]), 0)
        deepest = max(deepest, d)
        if r["feature"] >= 0:
            level[r["tree"], r["left"]] = level[r["tree"], r["right"]] = d + 1
    return deepest


def importance(model: TreeModel, spark: SparkSession) -> DataFrame:
    """feature, importance: a column's share of all gains (mean gain per split, as
    shares that add up to 1), from the node table."""
    nodes = model.nodes(spark).where("feature >= 0").groupBy("feature").agg(F.avg("gain").alias("g"))
    names = spark.createDataFrame([(k, c) for k, c in enumerate(model.cols)], "feature int, name string")
    every = names.join(F.broadcast(nodes), "feature", "left").select("name", F.coalesce("g", F.lit(0.0)).alias("g"))
    total = F.sum("g").over(Window.partitionBy())  # a row per feature
    return every.select(F.col("name").alias("feature"),
                        F.when(total > 0, F.col("g") / total).otherwise(F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"))
