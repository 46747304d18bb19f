"""URL filters by dated lists (operator 9), DataFrame functions only.

A list is a log of dated edits (list, pattern, time, add or remove). Each
added entry is valid from its edit to the next edit of the same list and
pattern. An as-of join evaluates every capture against the entries active at
its fetch time: captures and entries of one pattern are merged in time order,
and each capture sees the last entry that began before or with it.

Both steps work in chunks of time (``CHUNK`` seconds), so a pattern or host
with a third of all rows is many small groups. What crosses a chunk's edge
(the next edit, or the entry active at its start) comes from a table of one
row per pattern and chunk. Captures whose host matches no pattern leave
before the join.

A pattern is a host name that also covers its subdomains. The longest
pattern with an active entry decides; on one pattern ``allow`` beats ``block``.

Defined results: a null or unreadable URL has no host and verdict ``none``,
so has a null fetch time; edits with a null field are no edits; of edits with
equal times the larger ``edit_id`` is later; repeated captures are each
returned; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

CHUNK = 6 * 3600
LISTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """Lower-case host name of an absolute URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(edits: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: open) of every added entry, from
    edits (list, pattern, at in seconds, edit_id, action ``add`` or ``remove``)."""
    e = (edits.where(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("at").isNotNull()
                     & F.col("action").isNotNull())
         .withColumn("chunk", F.floor(F.col("at") / chunk)))
    key = Window.partitionBy("list", "pattern", "chunk").orderBy("at", "edit_id")
    heads = e.groupBy("list", "pattern", "chunk").agg(F.min("at").alias("first"))
    after = heads.withColumn("next_first", F.lead("first").over(Window.partitionBy("list", "pattern").orderBy("chunk"))).drop("first")
    return (e.withColumn("next_at", F.lead("at").over(key)).join(after, ["list", "pattern", "chunk"])
            .where(F.lower("action") == "add")
            .select("list", "pattern", F.col("at").alias("valid_from"), F.coalesce("next_at", "next_first").alias("valid_to"), "edit_id")
            .where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))).drop("edit_id"))


def active_entries(captures: DataFrame, entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """As-of join: row_id, pattern and per list the entry (valid_from, valid_to)
    active at fetch time, from captures (row_id, host, fetched_at)."""
    patterns = entries.select("pattern").distinct()
    keys = (captures.where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull())
            .select("row_id", "fetched_at", F.explode(suffixes(F.col("host"))).alias("pattern")).join(patterns, "pattern"))
    period = F.struct("valid_from", "valid_to")
    nothing = F.lit(None).cast("struct<valid_from:bigint,valid_to:bigint>")
    both = keys.select("pattern", F.col("fetched_at").alias("at"), "row_id", *(nothing.alias(x) for x in LISTS)).unionByName(
        entries.select("pattern", F.col("valid_from").alias("at"), F.lit(None).cast("long").alias("row_id"),
                       *(F.when(F.col("list") == x, period).otherwise(nothing).alias(x) for x in LISTS)))
    both = both.withColumn("chunk", F.floor(F.col("at") / chunk))
    # the entry active at a chunk's start: the last one of the chunks before
    ends = both.groupBy("pattern", "chunk").agg(*(F.max(x).alias(x) for x in LISTS))
    before = Window.partitionBy("pattern").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("pattern", "chunk", *(F.last(x, ignorenulls=True).over(before).alias(f"{x}_start") for x in LISTS))
    # entries come before captures of the same second
    so_far = (Window.partitionBy("pattern", "chunk").orderBy("at", F.col("row_id").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, 0))
    seen = (both.select("pattern", "chunk", "at", "row_id", *(F.last(x, ignorenulls=True).over(so_far).alias(x) for x in LISTS))
            .where("row_id is not null").join(starts, ["pattern", "chunk"]))

    def active(x):
        entry = F.coalesce(F.col(x), F.col(f"{x}_start"))
        return F.when(entry["valid_to"].isNull() | (entry["valid_to"] > F.col("at")), entry)

    return seen.select("row_id", "pattern", *(active(x).alias(x) for x in LISTS))


def filter_urls(captures: DataFrame, edits: DataFrame, id_col: str = "page_id", url_col: str = "url",
                time_col: str = "fetched_at", chunk: int = CHUNK) -> DataFrame:
    """page_id, url, host, fetched_at, verdict, pattern, valid_from, valid_to per capture."""
    c = materialise(captures.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        host_of(F.col(url_col)).alias("host"), F.col(time_col).cast("long").alias("fetched_at")), "url-captures")
    entries = materialise(validity(edits, chunk), "url-entries")
    hit = active_entries(c, entries, chunk).where(F.col("allow").isNotNull() | F.col("block").isNotNull())
    chosen = hit.select("row_id", F.struct(
        F.length("pattern").alias("n"), F.when(F.col("allow").isNotNull(), "allow").otherwise("block").alias("verdict"),
        "pattern", F.coalesce("allow", "block").alias("entry")).alias("best")).groupBy("row_id").agg(F.max("best").alias("best"))
    return c.join(chosen, "row_id", "left").select(
        "page_id", "url", "host", "fetched_at", F.coalesce("best.verdict", F.lit("none")).alias("verdict"),
        F.col("best.pattern").alias("pattern"), F.col("best.entry.valid_from").alias("valid_from"),
        F.col("best.entry.valid_to").alias("valid_to"))


def page_captures(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Pages as captures: the table has no fetch time, so one is derived from the
    id within the time range of ``events``."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(at).alias("t0"), F.max(at).alias("t1"))  # one row
    return pages.select("page_id", "url").crossJoin(F.broadcast(span)).select(
        "page_id", "url", (F.col("t0") + F.pmod(F.col("page_id") * 7919, F.col("t1") - F.col("t0") + 1)).alias("fetched_at"))


def event_edits(pages: DataFrame, events: DataFrame) -> DataFrame:
    """List edits from ``events``, one per event: the distinct sites are numbered and a
    user maintains the site whose number is the user's id modulo their count. Event
    types are additions to and removals from the two lists, errors block the site's
    blog; events without a user are no edits. Sites are numbered range by range, so no
    task sorts them all."""
    site = F.nullif(F.regexp_extract(host_of(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1), F.lit(""))
    sites = materialise(
        pages.select(site.alias("site")).where("site is not null").distinct().repartitionByRange("site").sortWithinPartitions("site")
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "url-sites")
    # a row per partition
    parts = sites.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sites.join(F.broadcast(parts.select("part", "first", before.alias("before"))), "part").select(
        "site", (F.col("row") - F.col("first") + F.col("before")).alias("number"))
    kind = F.col("event_type")
    count = F.broadcast(sites.agg(F.count("*").alias("count")))
    users = events.select("user_id").distinct().crossJoin(count).where("count > 0").select(
        "user_id", F.pmod(F.col("user_id"), F.col("count")).alias("number"))
    mine = users.join(numbered, "number").select("user_id", "site")
    return events.join(mine, "user_id").select(
        F.when(kind.isin("signup", "click", "error"), "block").otherwise("allow").alias("list"),
        F.when(kind == "error", F.concat(F.lit("blog."), F.col("site"))).otherwise(F.col("site")).alias("pattern"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("edit_id"),
        F.when(kind.isin("signup", "purchase", "error"), "add").otherwise("remove").alias("action"))


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    return filter_urls(page_captures(pages, events), event_edits(pages, events))


OP9_SQL = r"""
with c as (
  select page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') as host,
    t0 + (page_id * 7919) % (t1 - t0 + 1) as fetched_at
  from pages, (select epoch_us(min(ts)) // 1000000 as t0, epoch_us(max(ts)) // 1000000 as t1 from events)
), s as (
  select site, row_number() over (order by site) - 1 as number, count(*) over () as sites
  from (select distinct nullif(regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), '') as site from c) where site is not null
), e as (
  select case when event_type in ('signup', 'click', 'error') then 'block' else 'allow' end as list,
    case when event_type = 'error' then 'blog.' || site else site end as pattern, epoch_us(ts) // 1000000 as at_s, event_id,
    event_type in ('signup', 'purchase', 'error') as adds
  from events join s on number = user_id % sites
), v as (
  select list, pattern, adds, at_s as valid_from, lead(at_s) over (partition by list, pattern order by at_s, event_id) as valid_to from e
), m as (
  select page_id, pattern, list, valid_from, valid_to,
    row_number() over (partition by page_id order by length(pattern) desc, list) as k
  from c join v on (host = pattern or ends_with(host, '.' || pattern))
  where adds and valid_from <= fetched_at and (valid_to is null or valid_to > fetched_at)
)
select c.page_id, url, host, fetched_at::bigint as fetched_at, coalesce(list, 'none') as verdict, pattern,
  valid_from::bigint as valid_from, valid_to::bigint as valid_to
from c left join m on c.page_id = m.page_id and k = 1
"""
