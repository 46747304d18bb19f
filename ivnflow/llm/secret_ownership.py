"""Secret scans with corpus-wide ownership (operator 3), DataFrame functions only.

Three kinds of candidates are matched leftmost and non-overlapping per kind;
positions come from splitting a text by the same pattern and adding up the
lengths of what lies between. A candidate's value is then known by its hash
only: hashes are aggregated over distinct repositories and owners. A value
that many owners hold is a copied example (span kind ``copied``); a value of
few owners that looks like a credential is ``live``. Both are added to the
base spans and cover the value alone.

Texts are read once; what is written and shuffled are spans and hashes of the
rows that have any. A value held by a third of all rows is one row per
(owner, repository) after map-side sums, and its verdict joins back by a
size-checked broadcast or a sort-merge join whose large keys Spark splits.

Defined results: null text has no spans; a null owner or repository counts
as one owner or repository of its own; repeated rows count once for the
ownership and are each returned; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# the shortest accepted run in the pattern itself: a run is matched whole, so this drops the same matches
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "copied", "live")
COPIED, LIVE = 3, 4
#: A value in at least this many owners is an example that people copy.
COPIED_OWNERS = 3
#: Parts of values that no live credential has.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|your|dummy|xxxx|0000|1234567|abcdef"
_SPANS = "array<struct<start:int,end:int,hit:string>>"


def match_spans(text: Column, pattern: str) -> Column:
    """Spans of a pattern as array<struct<start, end, hit>> (code points, end exclusive)."""
    def walk(hits, gaps):
        pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))
        return F.aggregate(
            pairs, F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("out")),
            lambda acc, x: F.struct(
                (acc["pos"] + F.length(x["g"]) + F.length(x["h"])).alias("pos"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["pos"] + F.length(x["g"])).alias("start"),
                    (acc["pos"] + F.length(x["g"]) + F.length(x["h"])).alias("end"),
                    x["h"].alias("hit")))).alias("out")),
            lambda acc: acc["out"])

    return walk(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, value_start, value>> of the base kinds, by start then kind."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value_start:int,value:string>>")

    def spans(kind, pattern):
        def one(s):
            value = F.regexp_extract(s["hit"], ASSIGN, 2) if kind == 0 else s["hit"]
            return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
                            (s["end"] - F.length(value)).alias("value_start"), value.alias("value"))
        out = F.transform(match_spans(t, pattern), one)
        return F.filter(out, lambda s: F.length(s["value"]) >= 8) if kind == 0 else out

    # cheap tests first: few texts have a candidate at all
    named = let(F.lower(t), lambda v: v.contains("passw") | v.contains("secret") | v.contains("token") | v.contains("api"))
    return F.array_sort(F.concat(
        F.when(named, spans(0, ASSIGN)).otherwise(none),
        F.when(t.contains("AKIA"), spans(1, ACCESS)).otherwise(none),
        F.when(t.rlike(r"[0-9a-f]{32}"), spans(2, HEX)).otherwise(none)))


def looks_live(value: Column) -> Column:
    """No placeholder part and at least eight different characters."""
    return ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def found_spans(text: Column) -> Column:
    """``candidates`` with each value replaced by its SHA-256 and its looks."""
    return F.transform(candidates(text), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        s["value_start"].alias("value_start"), F.sha2(s["value"], 256).alias("hash"),
        looks_live(s["value"]).alias("looks")))


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """hash, owners, repositories, verdict (a kind or null) from rows of
    (owner, repository, found)."""
    held = (found.select("owner", "repository", F.explode(F.array_distinct(
        F.transform("found", lambda s: F.struct(s["hash"].alias("hash"), s["looks"].alias("looks"))))).alias("v"))
        .groupBy("v.hash", "owner", "repository").agg(F.max("v.looks").alias("looks")))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("looks").alias("looks"))
    return (by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                         F.max("looks").alias("looks"))
            .withColumn("verdict", F.when(F.col("owners") >= copied_owners, COPIED).when(F.col("looks"), LIVE))
            .drop("looks"))


def _added(hit: DataFrame, verdicts: DataFrame) -> DataFrame:
    """row_id, added: the value spans with their verdict (null: neither)."""
    return (hit.select("row_id", F.explode("found").alias("s")).withColumn("hash", F.col("s.hash"))
            .join(verdicts.select("hash", "verdict", "owners", "repositories"), "hash")
            .groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct(
                F.col("s.value_start").alias("start"), F.col("verdict").alias("kind"), F.col("s.end").alias("end"),
                "owners", "repositories"))).alias("added")))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_col: str = "doc_id", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """doc_id, base array<struct<start, kind, end>>, added array<struct<start,
    kind, end, owners, repositories>> per row of ``docs``; kinds number KINDS."""
    base = materialise(docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"),
        F.col(owner_col).alias("owner"), F.col(repository_col).alias("repository"),
        found_spans(F.col(text_col)).alias("found")), "secret-spans")
    hit = base.where(F.size("found") > 0)
    added = _added(hit, ownership(hit, copied_owners))
    plain = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    some = hit.join(added, "row_id").select("doc_id", plain.alias("base"), F.filter("added", lambda s: s["kind"].isNotNull()).alias("added"))
    none = base.where(F.size("found") == 0).select("doc_id", plain.alias("base"), F.lit(None).cast(some.schema["added"].dataType).alias("added"))
    return some.unionByName(none).withColumn("added", F.coalesce("added", F.array().cast(some.schema["added"].dataType)))


def redact(docs: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``docs`` (doc_id, text, source, n_chars and others) with every found value
    replaced by [EXAMPLE] where it is a copied example, by [SECRET] otherwise."""
    columns = docs.columns
    row = docs.select(F.struct(*(F.col(c) for c in columns)).alias("row"))
    found = row.withColumn("found", found_spans(F.col("row.text")))
    hit = materialise(found.where(F.size("found") > 0).select(
        F.monotonically_increasing_id().alias("row_id"), "row", F.col("row.source").alias("owner"),
        F.col("row.doc_id").alias("repository"), "found"), "secret-rows")
    marked = hit.join(_added(hit, ownership(hit, copied_owners)), "row_id")
    t = F.col("row.text")

    def step(acc, s):
        mark = F.when(s["kind"] == COPIED, "[EXAMPLE]").otherwise("[SECRET]")
        apart = s["start"] >= acc["pos"]
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(apart, F.concat(acc["out"], t.substr(acc["pos"] + 1, s["start"] - acc["pos"]), mark))
            .otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("added", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], t.substr(acc["pos"] + 1, F.length(t))))
    changed = marked.select("row", clean.alias("clean"))
    out = changed.select(*(F.col("clean").alias(c) if c == "text"
                           else F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                           else F.col("row")[c].alias(c) for c in columns))
    rest = found.where(F.size("found") == 0).select(*(F.col("row")[c].alias(c) for c in columns))
    return rest.unionByName(out)


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", F.transform("added", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


#: The assign pattern with both letter cases written out.
_ASSIGN_SQL = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
               r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _hits_sql(kind: int, pattern: str) -> str:
    return (f"select rid, {kind} as kind, regexp_extract_all(t, '{pattern}') as hits, "
            f"regexp_split_to_array(t, '{pattern}') as gaps from d")


#: The same rows in DuckDB.
OP3_SQL = f"""
with d as (
  select row_number() over () as rid, doc_id, source as owner, coalesce(text, '') as t from documents
), m as (
  {_hits_sql(0, _ASSIGN_SQL)}
  union all {_hits_sql(1, "AKIA[A-Z0-9]+")}
  union all {_hits_sql(2, "[0-9a-f]{32,}")}
), e as (
  select rid, kind, i, hits[i] as h, gaps[i] as g from (select *, unnest(range(1, len(hits) + 1)) as i from m)
), s as (
  select rid, kind, h, (sum(length(g) + length(h)) over (partition by rid, kind order by i))::bigint as stop from e
), b as (
  select rid, kind, stop - length(h) as start, stop, doc_id, owner,
    case when kind = 0 then regexp_extract(h, '{_ASSIGN_SQL}', 2) else h end as value
  from s join d using (rid)
), k as (
  select * from b where length(value) >= case kind when 0 then 8 when 1 then 16 else 32 end
), v as (
  select value, case
    when count(distinct owner) + max((owner is null)::int) >= {COPIED_OWNERS} then {COPIED}
    when not regexp_matches(value, '{PLACEHOLDER}') and len(list_distinct(string_split(value, ''))) >= 8 then {LIVE}
    end as verdict
  from k group by value
), a as (
  select distinct rid, verdict as kind, stop - length(value) as start, stop from k join v using (value) where verdict is not null
), n as (
  select *, ['assign', 'access', 'hex', 'copied', 'live'][kind + 1] || ':' || start || ':' || stop as span
  from (select rid, kind, start, stop, true as base from k union all select rid, kind, start, stop, false from a)
), j as (
  select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
    count(*) filter (kind = 2) as n_hex, string_agg(span, ',' order by start, kind, stop) filter (base) as base,
    string_agg(span, ',' order by start, kind, stop) as spans
  from n group by rid
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join j using (rid)
"""
