"""Fixture views over the driver's tables.

Each view is one projection of a driver table, written once as SQL
expressions with a few engine tokens, and rendered either as a Spark
projection (``selectExpr`` over a parquet scan, so pruning and pushdown
reach the scan) or as a DuckDB common table expression for the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

_TOKENS = {
    "spark": {
        "{us}": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
        "{S}": "string",
    },
    "duckdb": {
        "{us}": "epoch_us(ts)",
        "{S}": "varchar",
    },
}


def _emb(i: int, engine: str) -> str:
    return f"element_at(embedding, {i})" if engine == "spark" else f"embedding[{i}]"


# view name -> (source table, [(expression, alias)])
VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "packets": ("events", [
        ("event_id", "pkt_no"),
        ("{us} / 1000000.0e0", "ts_s"),
        ("'172.30.0.' || cast(10 + user_id % 3 as {S})", "src_ip"),
        ("'172.30.0.' || cast(20 + user_id % 6 as {S})", "dst_ip"),
        ("cast(30501 + user_id % 3 as int)", "src_port"),
        ("cast(30490 + user_id % 31 as int)", "dst_port"),
        ("case when event_type = 'error' then 'TCP' else 'UDP' end", "transport"),
        ("cast(28 + 16 + length(props) + floor(value) as int)", "ip_len"),
        ("cast(8 + 16 + length(props) + floor(value) as int)", "transport_len"),
        ("case when event_id % 13 = 0 then null else "
         "lower(substr(hex(event_type || props || cast(user_id as {S})), 1, 64)) end",
         "payload_hex"),
        ("event_type = 'signup'", "is_sd"),
        ("case event_type when 'error' then 'dos' when 'signup' then 'fuzzy' "
         "when 'purchase' then 'mitm' else 'normal' end", "label_str"),
        ("case event_type when 'error' then 'dos_noti_flood.pcap' "
         "when 'signup' then 'fuzzy_sd_offer_rand_noti(1).pcap' "
         "when 'purchase' then 'mitm_single_attacker.pcap' "
         "else 'benign_traffic.pcap' end", "pcap_file"),
    ]),
    "scored": ("orders", [
        ("o_orderkey", "row_id"),
        ("case when o_orderstatus = 'P' or o_totalprice > 400000 then 1 else 0 end",
         "y_true"),
        ("round(case when o_orderstatus = 'P' then 0.35e0 else 0.05e0 end "
         "+ 0.6e0 * (o_orderkey % 101) / 101.0e0, 4)", "y_prob"),
    ]),
    "payloads": ("documents", [
        ("doc_id", "pkt_no"),
        ("source", "source"),
        ("lang", "lang"),
        ("case when lang = 'en' then 'normal' else 'dos' end", "label_str"),
        ("case when doc_id % 17 = 0 then null else lower(hex(text)) end",
         "payload_hex"),
    ]),
    "vectors": ("embeddings", [
        ("vec_id", "vec_id"),
        ("case when label < 5 then 1 else 0 end", "y_true"),
    ] + [(f"cast({{emb{i}}} as double)", f"x{i:02d}") for i in range(1, 65)]),
}

VECTOR_COLS = [f"x{i:02d}" for i in range(1, 65)]


def _render(expr: str, engine: str) -> str:
    for k, v in _TOKENS[engine].items():
        expr = expr.replace(k, v)
    for i in range(1, 65):
        expr = expr.replace(f"{{emb{i}}}", _emb(i, engine))
    return expr


def view_sql(name: str, engine: str = "duckdb") -> str:
    table, cols = VIEWS[name]
    sel = ",\n  ".join(f"{_render(e, engine)} AS {a}" for e, a in cols)
    return f"SELECT\n  {sel}\nFROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _utc_select(df: DataFrame, exprs: list[str]) -> DataFrame:
    """Project with the views' time arithmetic analysed in UTC.

    Time zones are fixed into expressions at analysis, which a DataFrame
    does eagerly, so the caller's session setting is restored right after.
    """
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.session.timeZone")
    if old in ("UTC", "Etc/UTC"):
        return df.selectExpr(*exprs)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        return df.selectExpr(*exprs)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture view ``name`` as a lazily evaluated Spark DataFrame."""
    src, cols = VIEWS[name]
    return _utc_select(table(spark, sf_dir, src), [f"{_render(e, 'spark')} AS {a}" for e, a in cols])


def packets(spark, sf_dir):
    return view(spark, sf_dir, "packets")


def scored(spark, sf_dir):
    return view(spark, sf_dir, "scored")


def payloads(spark, sf_dir):
    return view(spark, sf_dir, "payloads")


def vectors(spark, sf_dir):
    return view(spark, sf_dir, "vectors")


def with_views(sql: str, *names: str) -> str:
    """Prefix DuckDB SQL with the fixture views it reads as CTEs."""
    ctes = ",\n".join(f"{n} AS (\n{view_sql(n, 'duckdb')}\n)" for n in names)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def project(df: DataFrame, name: str) -> DataFrame:
    """Apply a view's projection to any DataFrame of its source table
    (a streaming one included)."""
    _, cols = VIEWS[name]
    return _utc_select(df, [f"{_render(e, 'spark')} AS {a}" for e, a in cols])
