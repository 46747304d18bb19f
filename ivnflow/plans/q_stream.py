"""Queries: telemetry (T3-T5, T7-T9), log parsing (D13) and streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from ..functions.someip import log_match, log_payload
from ..operators import models as md
from ..operators.flows import feature_columns, flow_features
from ..operators.payload import model_vector
from ..operators.prepare import minmax_apply, minmax_fit
from ..schemas import ECUS, FEATURE_COLS, NORM_COLS, SERVICES, SUBSCRIPTIONS
from ..session import cut_lineage, scratch_path
from ..sinks import emit_live, save_model
from ..sources.fixtures import packets, table
from ..streaming import flow_state as fs
from ..streaming import live
from ..streaming import telemetry as tm
from .catalog import register
from .q_features import FLOW_FEATURES_SQL, byte_model, fitted_vector, rounded

R = 6
# On the driver's events table one simulated second is one hour of data.
SCALE_S = 3600
WINDOW = "1 hour"
GAP = "3 hours"  # offer TTL (3) x offer cycle (1 s), scaled

SVC = " UNION ALL ".join(f"SELECT '{n}' AS service, {p} AS port" for n, _, _, p, _, _ in SERVICES)
SVC_PK = f"svc AS ({SVC}), sp AS (SELECT p.*, s.service FROM packets p JOIN svc s ON p.src_port = s.port)"


def svc_packets(spark, sf):
    return tm.with_service(packets(spark, sf)).withColumn("ts", tm.event_time())


def rates(spark, sf):
    return tm.rate_per_window(svc_packets(spark, sf), WINDOW)


@register("q_rate_per_second", views=("packets",), sql=f"""
WITH {SVC_PK}
SELECT service, CAST(floor(ts_s / {SCALE_S}) * {SCALE_S} AS BIGINT) AS window_start, count(*) AS n
FROM sp GROUP BY 1, 2""")
def q_rate_per_second(spark, sf):
    return rates(spark, sf)


@register("q_ecu_totals", views=("packets",), sql=f"""
WITH {SVC_PK}
SELECT service, count(*) OVER (PARTITION BY service) AS total, payload_hex AS last_payload FROM sp
QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts_s DESC, pkt_no DESC) = 1""")
def q_ecu_totals(spark, sf):
    return tm.totals_and_last(svc_packets(spark, sf))


@register("q_rate_history", views=("packets",), sql=f"""
WITH {SVC_PK},
r AS (SELECT service, CAST(floor(ts_s / {SCALE_S}) * {SCALE_S} AS BIGINT) AS window_start, count(*) AS n
      FROM sp GROUP BY 1, 2),
g AS (SELECT service, unnest(range(min(window_start), max(window_start) + 1, {SCALE_S})) AS window_start
      FROM r GROUP BY service),
d AS (SELECT g.service, g.window_start, coalesce(r.n, 0) AS n FROM g LEFT JOIN r
      ON g.service = r.service AND g.window_start = r.window_start)
SELECT service, window_start, n, list(n) OVER (PARTITION BY service ORDER BY window_start
  ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS history FROM d""")
def q_rate_history(spark, sf):
    return tm.rate_history(rates(spark, sf), SCALE_S, 60)


_SUBS = " UNION ALL ".join(f"SELECT '{e}' AS subscriber, '{s}' AS service" for e, s in SUBSCRIPTIONS)


@register("q_subscription_fanout", views=("packets",), sql=f"""
WITH {SVC_PK}, subs AS ({_SUBS})
SELECT subscriber, sp.service, count(*) AS n FROM sp JOIN subs ON sp.service = subs.service
GROUP BY subscriber, sp.service""")
def q_subscription_fanout(spark, sf):
    return tm.subscription_fanout(svc_packets(spark, sf))


_NOM = " UNION ALL ".join(f"SELECT '{n}' AS service, {ms} AS nominal_ms" for n, _, _, _, ms, _ in SERVICES)


@register("q_period_check", views=("packets",), sql=f"""
WITH {SVC_PK}, nom AS ({_NOM}),
gp AS (SELECT service, ts_s - lag(ts_s) OVER (PARTITION BY service ORDER BY ts_s, pkt_no) AS gap FROM sp),
g AS (SELECT service, count(*) AS n_gaps, avg(gap) AS mean_gap_s FROM gp WHERE gap IS NOT NULL GROUP BY service)
SELECT g.service, n_gaps, round(mean_gap_s, {R}) AS mean_gap_s, nominal_ms,
  round(mean_gap_s * {1000.0 / SCALE_S!r}e0 / nominal_ms, {R}) AS ratio
FROM g JOIN nom ON g.service = nom.service""")
def q_period_check(spark, sf):
    p = tm.period_check(tm.with_service(packets(spark, sf)), time_scale=SCALE_S)
    return p.select("service", "n_gaps", F.round("mean_gap_s", R).alias("mean_gap_s"), "nominal_ms",
                    F.round("ratio", R).alias("ratio"))


@register("q_service_availability", views=("packets",), sql=f"""
WITH {SVC_PK},
o AS (SELECT service, ts_s, CAST(round(ts_s * 1000000) AS BIGINT) AS us FROM sp WHERE is_sd),
m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY service ORDER BY us) < {3 * SCALE_S * 1_000_000}
      THEN 0 ELSE 1 END AS brk FROM o),
s AS (SELECT *, sum(brk) OVER (PARTITION BY service ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM m)
SELECT service, min(us) / 1000000.0e0 AS session_start,
  (max(us) + {3 * SCALE_S * 1_000_000}) / 1000000.0e0 AS session_end, count(*) AS n_offers
FROM s GROUP BY service, sid""")
def q_service_availability(spark, sf):
    sd = svc_packets(spark, sf).where(F.col("is_sd"))
    return tm.availability_sessions(sd, GAP)


# ---- D13 log lines -------------------------------------------------------------------------

def log_lines(df):
    """Container log lines rebuilt from the events table (one line per event)."""
    names = F.array(*[F.lit(c) for c, _, _ in ECUS])
    labels = F.array(*[F.lit(lab) for _, lab, _ in ECUS])
    i = (F.col("user_id") % len(ECUS) + 1).cast("int")
    v = F.format_string("%.2f", F.col("value"))
    body = (F.when(F.col("event_type") == "click",
                   F.concat(F.lit("GPS lat="), v, F.lit(" lon="), F.col("user_id").cast("string")))
            .when(F.col("event_type") == "view", F.concat(F.lit("IMU accel=("), v, F.lit(",0,0)")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("VDE speed="), v, F.lit(" km/h")))
            .otherwise(F.concat(F.lit("heartbeat "), F.col("event_type"))))
    return df.select("event_id", F.element_at(names, i).alias("container"),
                     F.trim(F.concat(F.lit("["), F.element_at(labels, i), F.lit("] "), body)).alias("line"))


_NAMES = "[" + ", ".join(f"'{c}'" for c, _, _ in ECUS) + "]"
_LABELS = "[" + ", ".join(f"'{lab}'" for _, lab, _ in ECUS) + "]"


@register("q_log_parse", sql=f"""
WITH l AS (SELECT event_id, {_NAMES}[user_id % 9 + 1] AS container,
  trim('[' || {_LABELS}[user_id % 9 + 1] || '] ' || CASE event_type
    WHEN 'click' THEN 'GPS lat=' || printf('%.2f', value) || ' lon=' || CAST(user_id AS VARCHAR)
    WHEN 'view' THEN 'IMU accel=(' || printf('%.2f', value) || ',0,0)'
    WHEN 'purchase' THEN 'VDE speed=' || printf('%.2f', value) || ' km/h'
    ELSE 'heartbeat ' || event_type END) AS line FROM events)
SELECT event_id, container, substr(line, instr(line, ']') + 2, 60) AS last_payload FROM l
WHERE CASE container
  WHEN 'ecu-gps' THEN regexp_matches(line, '\\[GPS\\].*lat=')
  WHEN 'ecu-imu' THEN regexp_matches(line, '\\[IMU\\].*accel=')
  WHEN 'ecu-vde' THEN regexp_matches(line, '\\[VDE\\].*speed=')
  ELSE regexp_matches(line, 'lat=|accel=|speed=') END""")
def q_log_parse(spark, sf):
    lines = log_lines(table(spark, sf, "events"))
    return lines.where(log_match("container", "line")).select(
        "event_id", "container", log_payload("line").alias("last_payload"))


# ---- streaming jobs (rows-only checks) ---------------------------------------------------------

LIVE_SQL = f"""
WITH {SVC_PK},
r AS (SELECT service, CAST(floor(ts_s / {SCALE_S}) * {SCALE_S} AS BIGINT) AS window_start, count(*) AS n
      FROM sp GROUP BY 1, 2),
m AS (SELECT max(CAST(round(ts_s * 1000000) AS BIGINT)) AS mx FROM sp)
SELECT service, window_start, n FROM r, m
WHERE (window_start + {SCALE_S}) * CAST(1000000 AS BIGINT) <= mx - {2 * SCALE_S * 1_000_000}"""


@register("q_live_metrics", views=("packets",), sql=LIVE_SQL)
def q_live_metrics(spark, sf):
    """Per-service rate per window as a watermarked streaming aggregation."""
    def rates(source):
        s = tm.with_service(source).withColumn("ts", tm.event_time())
        agg = s.withWatermark("ts", "2 hours").groupBy("service", F.window("ts", WINDOW).alias("w")) \
            .agg(F.count(F.lit(1)).alias("n"))
        return agg.select("service", F.unix_seconds(F.col("w.start")).alias("window_start"), "n")

    out = fs.run_slices(fs.time_slices(packets(spark, sf)), rates, "live_metrics")
    return spark.read.parquet(out).select("service", "window_start", "n")


@register("q_live_history", views=("packets",), sql=f"""
{LIVE_SQL.replace("r AS (", "r0 AS (").replace("FROM r, m", "FROM r0, m").replace("SELECT service, window_start, n FROM r0", ", r AS (SELECT service, window_start, n FROM r0")}),
g AS (SELECT service, unnest(range(min(window_start), max(window_start) + 1, {SCALE_S})) AS window_start FROM r GROUP BY service),
d AS (SELECT g.service, g.window_start, coalesce(r.n, 0) AS n FROM g LEFT JOIN r ON g.service = r.service AND g.window_start = r.window_start)
SELECT service, window_start, n, list(n) OVER (PARTITION BY service ORDER BY window_start
  ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS history FROM d""")
def q_live_history(spark, sf):
    """The last 60 rates at every closed window: closed windows are streamed, then
    streamed again, batch by batch with restarts, into histories kept in state."""
    rates = fs.run_slices(fs.time_slices(packets(spark, sf)), lambda s: live.closed_rates(s, WINDOW, "2 hours"), "closed_rates")
    closed = spark.read.parquet(rates)
    batches = [r["batch"] for r in closed.select("batch").distinct().orderBy("batch").collect()]  # micro-batches
    slices = [closed.where(F.col("batch") == b).drop("batch") for b in batches]
    out = fs.run_slices(slices, lambda s: live.rate_histories(s, SCALE_S, 60), "histories")
    return spark.read.parquet(out).select("service", "window_start", "n", "history")


@register("q_live_availability", views=("packets",), sql=f"""
WITH {SVC_PK},
o AS (SELECT service, CAST(round(ts_s * 1000000) AS BIGINT) AS us FROM sp WHERE is_sd),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY service ORDER BY us) < {3 * SCALE_S * 1_000_000}
      THEN 0 ELSE 1 END AS brk FROM o),
s AS (SELECT *, sum(brk) OVER (PARTITION BY service ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM b),
e AS (SELECT service, min(us) AS a, max(us) + {3 * SCALE_S * 1_000_000} AS z, count(*) AS n_offers FROM s GROUP BY service, sid)
SELECT service, a / 1000000.0e0 AS session_start, z / 1000000.0e0 AS session_end, n_offers
FROM e, (SELECT max(us) AS mx FROM o) WHERE z <= mx - {2 * SCALE_S * 1_000_000}""")
def q_live_availability(spark, sf):
    """Offer sessions over a stream, each emitted once it is closed."""
    out = fs.run_slices(fs.time_slices(packets(spark, sf)), lambda s: live.closed_sessions(s, GAP, "2 hours"), "sessions")
    return spark.read.parquet(out).select("service", "session_start", "session_end", "n_offers")


def stream_features(spark, sf):
    """The nine features over four micro-batches; the byte model is fitted before."""
    pk = packets(spark, sf)
    vec = fitted_vector(pk)
    out = fs.run_slices(fs.time_slices(pk), lambda s: feature_columns(fs.stateful_previous(s), vec, ["pkt_no"]),
                        "stream_features")
    return spark.read.parquet(out).select("pkt_no", *FEATURE_COLS, "label")


@register("q_stream_flow_features", views=("packets",),
          sql=f"SELECT pkt_no, {', '.join(FEATURE_COLS)}, label FROM ({FLOW_FEATURES_SQL})")
def q_stream_flow_features(spark, sf):
    return rounded(stream_features(spark, sf), FEATURE_COLS[1:5])


def online_alerts(spark, history, slices, t: float = 0.5) -> str:
    """Fit on ``history``, save byte model, Min-Max statistics and classifier,
    then score ``slices`` as a stream with the saved ones, batch by batch.
    Returns the path of the alerts (rows with a score of at least ``t``)."""
    run = uuid.uuid4().hex[:12]
    stats_at, model_at, vec_at = (scratch_path(spark, f"online-{run}-{k}") for k in ("minmax", "model", "bytes"))
    model_vector(byte_model(history)).write.parquet(vec_at)
    vec = spark.read.parquet(vec_at)
    train = cut_lineage(flow_features(history, vec))
    minmax_fit(train, FEATURE_COLS).write.parquet(stats_at)
    stats = spark.read.parquet(stats_at)
    tr = md.assemble(minmax_apply(train, stats, FEATURE_COLS), NORM_COLS)
    save_model(md.logistic(tr.count(), "label").fit(tr), model_at)
    model = LogisticRegressionModel.load(model_at)

    def alerts(batch, batch_id, path):
        rows = md.assemble(minmax_apply(batch, stats, FEATURE_COLS), NORM_COLS)
        emit_live(md.score(model, rows, "pkt_no", "label").where(F.col("y_prob") >= t), batch_id, path)

    return fs.run_slices(slices, lambda s: feature_columns(fs.stateful_previous(s), vec, ["pkt_no"]),
                         "alerts", emit=alerts)


@register("q_stream_alerts")
def q_stream_alerts(spark, sf, t: float = 0.5):
    """Alerts on a stream of all packets; models and statistics come from the first slice."""
    slices = fs.time_slices(packets(spark, sf))
    return spark.read.parquet(online_alerts(spark, slices[0], slices, t)).select("pkt_no", "y_true", "y_prob")
