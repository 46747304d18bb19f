"""DuckDB SQL that fits the tree and logistic models anew and scores them.

Written from the definitions (quantile bins, gains, sampling hashes, stopping),
not from the engine's node tables: a recursive query grows the trees level by
level over all rows.
"""

from __future__ import annotations

from ..operators.boosting import DRAWS, MOD, SCALE


def row_hash(key: str, r: str) -> str:
    x = f"((({key}) + 1009 * ({r} + 1)) % {MOD} * 48271 % {MOD})"
    return f"(({x} + ({key})) % {MOD} * 69621 % {MOD})"


def prepared(cols: list[str], split_cte: str, bins: int, rounds: int, tree_columns: int, seed: int = 42,
             fold: int | None = None) -> str:
    """CTEs: base (vec_id, y, split, valid, key, bl: bin per column), rr (tree, its columns)."""
    xs, d = ", ".join(cols), len(cols)
    key = f"('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|{seed}'), 1, 8))::BIGINT"
    valid = "false" if fold is None else f"{key} % {fold} = 0"
    step = f"floor((rn - 1) * {bins} / n) + 1"
    return f"""{split_cte.strip()},
xx AS (SELECT vec_id, split, {valid} AS valid, unnest(range({d})) AS f, unnest([{xs}]) AS v FROM vs),
rk AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n
       FROM xx WHERE split = 'train' AND NOT valid),
cuts AS (SELECT DISTINCT f, v FROM rk WHERE {step} <= floor(rn * {bins} / n) AND {step} < {bins}),
bb AS (SELECT xx.vec_id, xx.f, count(c.v)::INT AS bin FROM xx LEFT JOIN cuts c ON c.f = xx.f AND c.v < xx.v GROUP BY 1, 2),
base AS MATERIALIZED (SELECT vec_id, y_true AS y, split, {valid} AS valid, {key} % {MOD} AS key, bl
  FROM vs JOIN (SELECT vec_id, list(bin ORDER BY f) AS bl FROM bb GROUP BY vec_id) USING (vec_id)),
rr AS MATERIALIZED (SELECT r, list(f ORDER BY f) AS fs FROM (SELECT r, f,
  row_number() OVER (PARTITION BY r ORDER BY {row_hash(f'f * 7919 + {seed}', 'r')}, f) AS k
  FROM range({rounds}) t(r), range({d}) u(f)) WHERE k <= {tree_columns} GROUP BY r)"""


def boost(rounds: int, depth: int = 6, eta: float = 0.05, l2: float = 1.0, weight: float = 1.0, rows: int = 800,
          patience: int | None = None) -> str:
    """CTE st: a row per row, round and level, with margin, split (f, gain) of the
    node left behind (src), and the validation loss where there is a patience."""
    best = "{'f': f, 'bin': bin, 'gain': gain, 'vl': -gl / (hl + %s) * %s, 'vr': -(g - gl) / (h - hl + %s) * %s}" % (l2, eta, l2, eta)
    gain = (f"CASE WHEN hl < {weight} OR h - hl < {weight} THEN -1.0 ELSE 0.5 * (gl * gl / (hl + {l2}) "
            f"+ (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2})) END")
    goes_left = "bl[q.s.f + 1] <= q.s.bin"
    new_margin = "margin + val"
    loss = (f"CASE WHEN fin THEN sum(CASE WHEN valid THEN greatest({new_margin}, 0) + ln(1 + exp(-abs({new_margin}))) "
            f"- y * ({new_margin}) END) OVER () / count(CASE WHEN valid THEN 1 END) OVER () END")
    more = f"r < {rounds}" + (f" AND since < {patience}" if patience else "")
    return f"""st AS (
 SELECT vec_id, 0::BIGINT AS r, 0 AS lvl, 0::BIGINT AS node, true AS open, 0.0::DOUBLE AS val, 0.0::DOUBLE AS margin,
   NULL::BIGINT AS src, NULL::BIGINT AS f, NULL::DOUBLE AS gain, NULL::DOUBLE AS loss, NULL::DOUBLE AS best, 0::BIGINT AS since FROM base
 UNION ALL
 SELECT vec_id, CASE WHEN fin THEN r + 1 ELSE r END, CASE WHEN fin THEN 0 ELSE lvl + 1 END, CASE WHEN fin THEN 0 ELSE node END,
   CASE WHEN fin THEN true ELSE open END, val, CASE WHEN fin THEN {new_margin} ELSE margin END, src, f, gain, loss,
   CASE WHEN loss < coalesce(best, 1e300) THEN loss ELSE best END,
   CASE WHEN loss < coalesce(best, 1e300) THEN 0 WHEN loss IS NOT NULL THEN since + 1 ELSE since END
 FROM (SELECT *, {loss if patience else 'NULL::DOUBLE'} AS loss FROM (
  SELECT *, NOT bool_or(open) OVER () OR lvl + 1 >= {depth} AS fin FROM (
   SELECT t.vec_id, t.r, t.lvl, t.margin, t.best, t.since, z.y, z.valid, t.node + 1000000000 * t.lvl::BIGINT AS src, q.s.f AS f, q.s.gain AS gain,
    CASE WHEN q.s.f IS NULL THEN t.node WHEN z.{goes_left} THEN 2 * t.node + 1 ELSE 2 * t.node + 2 END AS node,
    t.open AND q.s.f IS NOT NULL AS open,
    CASE WHEN NOT t.open THEN t.val WHEN q.s.f IS NULL THEN coalesce(q.v0, 0.0) WHEN z.{goes_left} THEN q.s.vl ELSE q.s.vr END AS val
   FROM st t JOIN base z USING (vec_id) LEFT JOIN (
     SELECT node, CASE WHEN max(gain) > 1e-6 THEN arg_max({best}, (gain, -f, -bin)) END AS s, any_value(-g / (h + {l2}) * {eta}) AS v0
     FROM (SELECT *, {gain} AS gain FROM (
       SELECT node, f, bin, sum(g) OVER w / {SCALE}.0 AS gl, sum(h) OVER w / {SCALE}.0 AS hl, sum(g) OVER a / {SCALE}.0 AS g,
         sum(h) OVER a / {SCALE}.0 AS h FROM (
        SELECT node, f, bl[f + 1] AS bin, sum(g) AS g, sum(h) AS h FROM (
          SELECT s.node, unnest(rr.fs) AS f, s.bl, floor((p - y) * {SCALE} + 0.5) AS g, floor(p * (1.0 - p) * {SCALE} + 0.5) AS h
          FROM (SELECT o.node, o.r, base.y, base.bl, 1.0 / (1.0 + exp(-o.margin)) AS p FROM st o JOIN base USING (vec_id)
                WHERE base.split = 'train' AND NOT base.valid AND o.open AND {row_hash('base.key', 'o.r')} % 1000 < {rows}) s
          JOIN rr ON rr.r = s.r) GROUP BY 1, 2, 3)
       WINDOW w AS (PARTITION BY node, f ORDER BY bin), a AS (PARTITION BY node, f)))
     GROUP BY node) q ON q.node = t.node AND t.open)))
 WHERE {more})"""


def forest(trees: int, depth: int, node_columns: int | None, bootstrap: bool) -> str:
    """CTE ft: a row per row, tree and level while its node is open; ``val`` is the
    node's share of class 1."""
    draw = row_hash("base.key", "o.tree") + " % 1000"
    times = "1" if not bootstrap else "(CASE " + " ".join(f"WHEN {draw} < {d} THEN {k}" for k, d in enumerate(DRAWS)) + f" ELSE {len(DRAWS)} END)"
    chosen = "true" if node_columns is None else "k <= %d" % node_columns
    rank = "0" if node_columns is None else \
        f"row_number() OVER (PARTITION BY tree, node ORDER BY {row_hash(f'(node % {MOD}) * 64 + f', 'tree')}, f)"

    def mixed(a, n):
        return f"({n} - ({a}) * ({a}) / nullif({n}, 0) - ({n} - ({a})) * ({n} - ({a})) / nullif({n}, 0))"

    gain = f"CASE WHEN hl < 1 OR h - hl < 1 THEN -1.0 ELSE {mixed('g', 'h')} - {mixed('gl', 'hl')} - {mixed('(g - gl)', '(h - hl)')} END"
    best = "{'f': f, 'bin': bin, 'vl': gl / hl, 'vr': (g - gl) / (h - hl)}"
    return f"""ft AS (
 SELECT vec_id, tree, 0 AS lvl, 0::BIGINT AS node, true AS open, NULL::DOUBLE AS val FROM base, range({trees}) t(tree)
 UNION ALL
 SELECT t.vec_id, t.tree, t.lvl + 1, CASE WHEN q.s.f IS NULL THEN t.node WHEN z.bl[q.s.f + 1] <= q.s.bin THEN 2 * t.node + 1 ELSE 2 * t.node + 2 END,
   q.s.f IS NOT NULL AND t.lvl + 1 < {depth}, CASE WHEN q.s.f IS NULL THEN coalesce(q.v0, 0.0) WHEN z.bl[q.s.f + 1] <= q.s.bin THEN q.s.vl ELSE q.s.vr END
 FROM ft t JOIN base z USING (vec_id) LEFT JOIN (
   SELECT tree, node, CASE WHEN max(gain) > 1e-6 THEN arg_max({best}, (gain, -f, -bin)) END AS s, any_value(g / h) AS v0
   FROM (SELECT *, {gain} AS gain FROM (
     SELECT tree, node, f, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER a AS g, sum(h) OVER a AS h FROM (
      SELECT tree, node, f, bl[f + 1] AS bin, sum(y * n)::DOUBLE AS g, sum(n)::DOUBLE AS h FROM (
        SELECT o.tree, o.node, base.bl, base.y, {times} AS n, unnest(rr.fs) AS f
        FROM ft o JOIN base USING (vec_id) JOIN rr ON rr.r = o.tree WHERE base.split = 'train' AND o.open)
      WHERE n > 0 GROUP BY 1, 2, 3, 4)
     JOIN (SELECT tree, node, f FROM (SELECT tree, node, f, {rank} AS k FROM (SELECT DISTINCT o.tree, o.node, unnest(rr.fs) AS f
           FROM ft o JOIN rr ON rr.r = o.tree WHERE o.open)) WHERE {chosen}) USING (tree, node, f)
     WINDOW w AS (PARTITION BY tree, node, f ORDER BY bin), a AS (PARTITION BY tree, node, f)))
   GROUP BY tree, node) q ON q.tree = t.tree AND q.node = t.node
 WHERE t.open)"""


def logistic(cols: list[str], split_cte: str, steps: int = 600, l2: float = 1.0) -> str:
    """CTEs whose last, lr, has the coefficients after ``steps`` accelerated, scaled gradient
    steps on the L2-penalised loss (free intercept, columns centred to part the two)."""
    xs, d = ", ".join(cols), len(cols)
    return f"""{split_cte.strip()},
x0 AS (SELECT vec_id, y_true AS y, split, [{xs}] AS x FROM vs),
mu AS MATERIALIZED (SELECT list(m ORDER BY f) AS m FROM (SELECT f, avg(v) AS m FROM (SELECT unnest(range({d})) AS f, unnest(x) AS v
       FROM x0 WHERE split = 'train') GROUP BY f)),
xc AS MATERIALIZED (SELECT vec_id, y, split, list_transform(range(1, {d + 1}), lambda i: x0.x[i] - mu.m[i]) AS x FROM x0, mu),
sz AS MATERIALIZED (SELECT *, (1 - sqrt({l2} * a)) / (1 + sqrt({l2} * a)) AS beta FROM (SELECT count(*) AS n, 1 / ({l2} + 0.25 * max(tr)) AS a FROM xc,
       (SELECT sum(list_dot_product(x, x)) AS tr FROM xc WHERE split = 'train') WHERE split = 'train')),
lr AS (
 SELECT 0 AS k, list_transform(range({d}), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b,
   list_transform(range({d}), lambda i: 0.0::DOUBLE) AS pw, 0.0::DOUBLE AS pb
 UNION ALL
 SELECT k + 1, list_transform(range(1, {d + 1}), lambda i: zw[i] - sz.a * (g.gw[i] + {l2} * zw[i])), zb - 4.0 / sz.n * g.gb, w, b
 FROM (SELECT lr.*, list_transform(range(1, {d + 1}), lambda i: w[i] + beta * (w[i] - pw[i])) AS zw, b + beta * (b - pb) AS zb FROM lr, sz) z,
   sz, (SELECT list(s ORDER BY f) AS gw, any_value(sb) AS gb FROM (
     SELECT f, sum(e * v) AS s, sum(e) AS sb FROM (
       SELECT unnest(range({d})) AS f, unnest(xc.x) AS v, 1 / (1 + exp(-(list_dot_product(xc.x, q.zw) + q.zb))) - y AS e
       FROM xc, (SELECT list_transform(range(1, {d + 1}), lambda i: w[i] + beta * (w[i] - pw[i])) AS zw,
         b + beta * (b - pb) AS zb FROM lr, sz) q WHERE split = 'train') GROUP BY f)) g
 WHERE k < {steps})"""
