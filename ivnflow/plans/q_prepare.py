"""Queries: split, normalisation, sampling, balancing and profiles (N*, F*, B*, A*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.someip import someip_port
from ..operators import prepare as pr
from ..operators import profile as pf
from ..operators.evaluate import gini_splits
from ..operators.flows import binary_label
from ..schemas import FEATURE_COLS, FLOW_KEY, NORM_COLS, PCAP_LABELS
from ..session import cut_lineage
from ..sources.fixtures import packets, table
from .catalog import register
from .q_features import FLOW_FEATURES_SQL, features, rounded

R = 6
FC = ", ".join(FEATURE_COLS)
HASH = "md5(CAST(pkt_no AS VARCHAR) || '|42')"
LABEL = "CASE WHEN lower(label_str) = 'normal' THEN 0 ELSE 1 END"


def feats(spark, sf):
    """Features with the summed scores rounded, as the oracle gives them.

    Split, statistics and quantiles read the features several times, so the
    table is written once to the shared checkpoint folder (as the feature
    stage of the pipeline would) instead of being recomputed per branch.
    """
    return cut_lineage(rounded(features(spark, sf), FEATURE_COLS[1:5]))


def split_feats(spark, sf):
    return pr.stratified_split(feats(spark, sf), "pkt_no", "label")


def rnd(df, cols, r=R):
    return df.select(*[F.round(c, r).alias(c) if c in cols else F.col(c) for c in df.columns])


FF = f"ff AS ({FLOW_FEATURES_SQL})"
SP = f"""{FF},
sp AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn * 2 <= n THEN 'train' ELSE 'test' END AS split FROM (
  SELECT ff.*, row_number() OVER (PARTITION BY label ORDER BY {HASH}, pkt_no) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM ff))"""


def duck_norm(src_stats: str, clip: bool) -> str:
    out = []
    for c in FEATURE_COLS:
        v = f"(x.{c} - s.{c}_min) / (s.{c}_max - s.{c}_min)"
        if clip:
            v = f"least(greatest({v}, 0.0e0), 1.0e0)"
        out.append(f"round(CASE WHEN s.{c}_max - s.{c}_min = 0 THEN 0.0e0 ELSE {v} END, {R}) AS {c}_norm")
    return ",\n  ".join(out)


def duck_stats(src: str, where: str = "") -> str:
    return "SELECT " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in FEATURE_COLS) + \
        f" FROM {src} {where}"


def duck_class_cut(src: str, k_expr: str, label: str = "label") -> str:
    return f"""(SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY {HASH}, pkt_no) AS rn FROM {src} s)
  WHERE rn <= (SELECT {k_expr} FROM (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM {src} GROUP BY {label}))))"""


# ---- N1, N2, N6-N8 -------------------------------------------------------------------

@register("q_stratified_split", views=("packets",), sql=f"""
SELECT pkt_no, label, CASE WHEN rn * 2 <= n THEN 'train' ELSE 'test' END AS split FROM (
  SELECT pkt_no, {LABEL} AS label,
    row_number() OVER (PARTITION BY {LABEL} ORDER BY {HASH}, pkt_no) AS rn,
    count(*) OVER (PARTITION BY {LABEL}) AS n FROM packets)""")
def q_stratified_split(spark, sf):
    p = packets(spark, sf).select("pkt_no", binary_label().alias("label"))
    return pr.stratified_split(p, "pkt_no", "label")


@register("q_minmax_stats", views=("packets",), sql=f"""
WITH {SP}
SELECT feature, min(v) AS x_min, max(v) AS x_max FROM (
  UNPIVOT (SELECT {FC} FROM sp WHERE split = 'train') ON {FC} INTO NAME feature VALUE v)
GROUP BY feature""")
def q_minmax_stats(spark, sf):
    tr = split_feats(spark, sf).where(F.col("split") == "train")
    return pr.stats_long(pr.minmax_fit(tr, FEATURE_COLS), FEATURE_COLS)


@register("q_minmax_apply", views=("packets",), sql=f"""
WITH {SP}, st AS ({duck_stats('sp', "WHERE split = 'train'")})
SELECT x.pkt_no, x.split, {duck_norm('st', True)} FROM sp x CROSS JOIN st s""")
def q_minmax_apply(spark, sf):
    sp = split_feats(spark, sf)
    st = pr.minmax_fit(sp.where(F.col("split") == "train"), FEATURE_COLS)
    n = pr.minmax_apply(sp, st, FEATURE_COLS, clip=True)
    return rnd(n.select("pkt_no", "split", *NORM_COLS), NORM_COLS)


@register("q_minmax_self", views=("packets",), sql=f"""
WITH {FF}, cs AS {duck_class_cut('ff', 'least(5000, m)')}, st AS ({duck_stats('cs')})
SELECT x.pkt_no, {duck_norm('st', False)} FROM cs x CROSS JOIN st s""")
def q_minmax_self(spark, sf):
    cs = pr.capped_sample(feats(spark, sf), 5000, "pkt_no", "label")
    st = pr.minmax_fit(cs, FEATURE_COLS)
    n = pr.minmax_apply(cs, st, FEATURE_COLS, clip=False)
    return rnd(n.select("pkt_no", *NORM_COLS), NORM_COLS)


# ---- N3-N5, K6 -----------------------------------------------------------------------

PL = f"pl AS (SELECT pkt_no, {LABEL} AS label FROM packets)"


def _pl(spark, sf):
    return packets(spark, sf).select("pkt_no", binary_label().alias("label"))


@register("q_balanced_sample", views=("packets",), sql=f"""
WITH {PL} SELECT pkt_no, label FROM {duck_class_cut('pl', 'm')}""")
def q_balanced_sample(spark, sf):
    return pr.balanced_sample(_pl(spark, sf), "pkt_no", "label")


@register("q_capped_sample", views=("packets",), sql=f"""
WITH {PL} SELECT pkt_no, label FROM {duck_class_cut('pl', 'least(5000, m)')}""")
def q_capped_sample(spark, sf):
    return pr.capped_sample(_pl(spark, sf), 5000, "pkt_no", "label")


@register("q_balanced_export", views=("packets",), sql=f"""
WITH {FF} SELECT pkt_no, {FC}, label FROM {duck_class_cut('ff', 'least(25000, m)')}""")
def q_balanced_export(spark, sf):
    s = pr.capped_sample(feats(spark, sf), 25000, "pkt_no", "label")
    return s.select("pkt_no", *FEATURE_COLS, "label")


@register("q_fraction_sample", views=("packets",), sql=f"""
SELECT pkt_no FROM packets WHERE CAST(('0x' || substr({HASH}, 1, 8)) AS BIGINT) % 10 = 0""")
def q_fraction_sample(spark, sf):
    return pr.fraction_sample(packets(spark, sf), 10, "pkt_no").select("pkt_no")


# ---- F1, F2, F5, F6 --------------------------------------------------------------------

@register("q_benign_filter", views=("packets",), sql="""
SELECT pkt_no, payload_hex FROM packets WHERE lower(label_str) = 'normal' AND payload_hex IS NOT NULL""")
def q_benign_filter(spark, sf):
    return pr.benign(packets(spark, sf)).select("pkt_no", "payload_hex")


@register("q_class_mask", views=("packets",), sql=f"""
SELECT pkt_no, label FROM (SELECT pkt_no, {LABEL} AS label FROM packets) WHERE label = 1""")
def q_class_mask(spark, sf):
    return pr.class_mask(_pl(spark, sf), 1, "label")


@register("q_fill_zero", views=("packets",), sql="""
SELECT pkt_no, coalesce(ts_s - lag(ts_s) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, transport
  ORDER BY ts_s, pkt_no), 0.0e0) AS dt, coalesce(CAST(length(payload_hex) // 2 AS INTEGER), 0) AS payload_bytes
FROM packets""")
def q_fill_zero(spark, sf):
    w = Window.partitionBy(*FLOW_KEY).orderBy("ts_s", "pkt_no")
    p = packets(spark, sf).select(
        "pkt_no", (F.col("ts_s") - F.lag("ts_s").over(w)).alias("dt"),
        (F.length("payload_hex") / 2).cast("int").alias("payload_bytes"))
    return pr.fill_zero(p, ["dt", "payload_bytes"])


@register("q_binary_label", views=("packets",), sql=f"""
SELECT pkt_no, label_str, {LABEL} AS label FROM packets""")
def q_binary_label(spark, sf):
    return packets(spark, sf).select("pkt_no", "label_str", binary_label().alias("label"))


# ---- B1, B3, B4 -----------------------------------------------------------------------

@register("q_class_weight", views=("packets",), sql=f"""
WITH {PL}
SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_normal,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_attack,
       round(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE), {R})
       AS weight FROM pl""")
def q_class_weight(spark, sf):
    return rnd(pr.class_weight(_pl(spark, sf)), ["weight"])


@register("q_augment_counts", views=("packets",), sql=f"""
WITH {PL}, c AS (SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_normal,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_attack FROM pl)
SELECT n_normal, n_attack, CAST(greatest(n_normal - n_attack, 0) AS BIGINT) AS n_needed,
       CAST(n_attack + greatest(n_normal - n_attack, 0) AS BIGINT) AS n_attack_after FROM c""")
def q_augment_counts(spark, sf):
    return pr.augment_counts(_pl(spark, sf), 1.0)


@register("q_oversample", views=("packets",), sql=f"""
WITH {PL},
c AS (SELECT label, count(*) AS n FROM pl GROUP BY label),
mm AS (SELECT min(n) AS n_min, max(n) AS n_max, arg_min(label, n * 10 + label) AS minority FROM c),
rep AS (SELECT p.pkt_no, p.label, CAST(k AS INTEGER) AS copy_no FROM pl p, mm,
        range(1, CAST(ceil((n_max - n_min) / CAST(n_min AS DOUBLE)) AS BIGINT) + 1) t(k)
        WHERE p.label = mm.minority),
cut AS (SELECT pkt_no, label, copy_no FROM (
  SELECT rep.*, row_number() OVER (ORDER BY copy_no, {HASH}, pkt_no) AS rn FROM rep)
  WHERE rn <= (SELECT n_max - n_min FROM mm))
SELECT pkt_no, label, 0 AS copy_no FROM pl UNION ALL SELECT * FROM cut""")
def q_oversample(spark, sf):
    return pr.oversample_minority(_pl(spark, sf), "pkt_no", "label")


@register("q_augmented_set", views=("packets",), sql=f"""
WITH {PL},
c AS (SELECT count(*) FILTER (label = 1) AS n1, 2 * count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS need FROM pl),
pos AS (SELECT pkt_no, label, row_number() OVER (ORDER BY {HASH}, pkt_no) AS rn FROM pl WHERE label = 1)
SELECT pkt_no, label, 0 AS copy_no FROM pl
UNION ALL
SELECT pkt_no, label, CAST(k AS INTEGER) FROM pos, c, range(1, CAST(ceil(need / n1) AS BIGINT) + 1) t(k)
WHERE (k - 1) * n1 + rn <= need""")
def q_augmented_set(spark, sf):
    """Positive rows grown to twice the normal ones (ratio 2, so several copies are due)."""
    return pr.augment_positive(_pl(spark, sf), 2.0)


# ---- A1-A5, A7, E16 -------------------------------------------------------------------

@register("q_capture_counts", views=("packets",), sql=f"""
SELECT pcap_file, count(*) AS n_read,
  CAST(sum(CASE WHEN src_port BETWEEN 30490 AND 30510 OR dst_port BETWEEN 30490 AND 30510 THEN 1 ELSE 0 END)
  AS BIGINT) AS n_kept,
  round(sum(CASE WHEN src_port BETWEEN 30490 AND 30510 OR dst_port BETWEEN 30490 AND 30510 THEN 1 ELSE 0 END)
  * 100.0e0 / count(*), {R}) AS pct_kept
FROM packets GROUP BY pcap_file""")
def q_capture_counts(spark, sf):
    return rnd(pf.capture_counts(packets(spark, sf)), ["pct_kept"])


@register("q_class_distribution", views=("packets",), sql=f"""
SELECT label_str, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), {R}) AS share
FROM packets GROUP BY label_str""")
def q_class_distribution(spark, sf):
    return rnd(pf.class_distribution(packets(spark, sf)), ["share"])


UNP = f"UNPIVOT (SELECT {FC} FROM ff) ON {FC} INTO NAME feature VALUE v"


@register("q_feature_range", views=("packets",), sql=f"""
WITH {FF} SELECT feature, min(v) AS x_min, max(v) AS x_max FROM ({UNP}) GROUP BY feature""")
def q_feature_range(spark, sf):
    return pf.feature_range(feats(spark, sf), FEATURE_COLS)


@register("q_describe", views=("packets",), sql=f"""
WITH {FF}
SELECT feature, count(v) AS count, round(avg(v), {R}) AS mean, round(stddev_samp(v), {R}) AS std,
  round(min(v), {R}) AS min, round(quantile_cont(v, 0.25), {R}) AS p25, round(quantile_cont(v, 0.5), {R}) AS p50,
  round(quantile_cont(v, 0.75), {R}) AS p75, round(max(v), {R}) AS max
FROM ({UNP}) GROUP BY feature""")
def q_describe(spark, sf):
    d = pf.describe(feats(spark, sf), FEATURE_COLS)
    return rnd(d, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("q_zero_share", views=("packets",), sql=f"""
WITH {FF}
SELECT feature, round(avg(CASE WHEN v = 0 THEN 1.0e0 ELSE 0.0e0 END), {R}) AS zero_share
FROM ({UNP}) GROUP BY feature""")
def q_zero_share(spark, sf):
    return rnd(pf.zero_share(feats(spark, sf), FEATURE_COLS), ["zero_share"])


@register("q_label_quality", views=("packets",), sql=f"""
WITH {PL}, a AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_attack FROM pl)
SELECT n, n_attack, round(n_attack / CAST(n AS DOUBLE), {R}) AS attack_share, 0.117e0 AS expected_share,
  round(n_attack / CAST(n AS DOUBLE), {R}) AS const_precision,
  CASE WHEN n_attack > 0 THEN 1.0e0 ELSE 0.0e0 END AS const_recall,
  round(2 * (n_attack / CAST(n AS DOUBLE)) / (n_attack / CAST(n AS DOUBLE) + 1), {R}) AS const_f1 FROM a""")
def q_label_quality(spark, sf):
    return rnd(pf.label_quality(_pl(spark, sf)), ["attack_share", "const_precision", "const_f1"])


@register("q_gini_split", views=("packets",), sql=f"""
WITH g AS (SELECT ip_len AS value, sum({LABEL}) AS pos, count(*) AS n FROM packets GROUP BY ip_len),
c AS (SELECT value, sum(pos) OVER (ORDER BY value) AS lp, sum(n) OVER (ORDER BY value) AS ln,
      sum(pos) OVER () AS P, sum(n) OVER () AS N FROM g),
s AS (SELECT value, lp, ln, P - lp AS rp, N - ln AS rn, P, N,
  1 - (lp / ln) * (lp / ln) - (1 - lp / ln) * (1 - lp / ln) AS gl,
  CASE WHEN N - ln > 0 THEN 1 - ((P - lp) / (N - ln)) * ((P - lp) / (N - ln))
       - (1 - (P - lp) / (N - ln)) * (1 - (P - lp) / (N - ln)) ELSE 0.0e0 END AS gr,
  1 - (P / N) * (P / N) - (1 - P / N) * (1 - P / N) AS gp FROM c)
SELECT value AS split_value, CAST(ln AS BIGINT) AS n_left, CAST(rn AS BIGINT) AS n_right,
  round(gl, {R}) AS gini_left, round(gr, {R}) AS gini_right,
  round((ln * gl + rn * gr) / N, {R}) AS gini_weighted, round(gp - (ln * gl + rn * gr) / N, {R}) AS gain FROM s""")
def q_gini_split(spark, sf):
    p = packets(spark, sf).select("ip_len", binary_label().alias("label"))
    g = gini_splits(p, "ip_len", "label")
    return rnd(g, ["gini_left", "gini_right", "gini_weighted", "gain"])


# ---- S7, D3, D8 -------------------------------------------------------------------------

_DIM = " UNION ALL ".join(f"SELECT '{f}' AS pcap_file, '{lab}' AS label" for f, lab in PCAP_LABELS)


@register("q_label_dim", views=("packets",), sql=f"""
WITH dim AS ({_DIM})
SELECT d.label, count(*) AS n, CAST(sum(CASE WHEN d.label = p.label_str THEN 1 ELSE 0 END) AS BIGINT) AS n_agree
FROM packets p JOIN dim d ON p.pcap_file = d.pcap_file GROUP BY d.label""")
def q_label_dim(spark, sf):
    dim = spark.createDataFrame(PCAP_LABELS, "pcap_file string, label string")
    # seven fixed rows: a bounded broadcast
    j = packets(spark, sf).join(F.broadcast(dim), "pcap_file")
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(
        F.col("label") == F.col("label_str"), 1).otherwise(0)).cast("long").alias("n_agree"))


@register("q_sd_split", views=("packets",), sql="""
SELECT service_id = 65535 AS is_sd, label_str, count(*) AS n FROM (
  SELECT label_str, CASE WHEN is_sd THEN 65535 ELSE 4660 + (src_port - 30501) END AS service_id FROM packets)
GROUP BY 1, 2""")
def q_sd_split(spark, sf):
    p = packets(spark, sf).withColumn(
        "service_id", F.when(F.col("is_sd"), F.lit(65535)).otherwise(F.lit(4660) + F.col("src_port") - 30501))
    return p.groupBy((F.col("service_id") == 65535).alias("is_sd"), "label_str") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("q_port_filter", sql="""
SELECT event_id, src_port, dst_port FROM (
  SELECT event_id, CAST(30480 + user_id % 40 AS INTEGER) AS src_port, CAST(30480 + event_id % 40 AS INTEGER) AS dst_port
  FROM events)
WHERE src_port BETWEEN 30490 AND 30510 OR dst_port BETWEEN 30490 AND 30510""")
def q_port_filter(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", (F.lit(30480) + F.col("user_id") % 40).cast("int").alias("src_port"),
        (F.lit(30480) + F.col("event_id") % 40).cast("int").alias("dst_port"))
    return e.where(someip_port("src_port", "dst_port"))
