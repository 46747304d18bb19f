"""Quality rules by host (operator 1), in DataFrame functions only.

Every text gets rule counts, one failure per rule and a base verdict. The
failures of each rule are summed by host and the host's rate shrunk with that
rule's own beta prior, fitted to the hosts' rates by moments. A host is
rejected where, for some rule, its posterior rate less ``TAIL`` posterior
standard deviations is still above the prior's mean and above one half: it is
worse than the corpus and most of its documents fail, neither by chance. It
takes its documents with it.

The per-document counts are written once (no texts in them), so the texts
are read once; host sums are partial aggregates, so one host with a third of
all rows costs one row per task; the join back is Spark's choice between a
size-checked broadcast and a sort-merge join that splits large hosts.

Defined results: null text has no words and fails the base rules; a null
host is a host of its own; repeated rows count as often as they occur;
columns other than id, text and host are not read. With one host or equal
rates the prior is the overall rate with the weight of ``min_weight`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, materialise, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
TAIL = 3.0  # standard deviations of a host's posterior rate
MIN_WEIGHT = 2.0
MAX_WEIGHT = 1000.0


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows found twice or more, for an array of words.

    Windows are compared by a 64-bit hash. Only texts whose windows are not
    all distinct are sorted by (hash, position).
    """
    def grams(v):
        return F.transform(F.sequence(F.lit(1), F.size(v) - 2), lambda i: F.xxhash64(
            F.element_at(v, i), F.element_at(v, i + 1), F.element_at(v, i + 2)))

    def covered(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s):
            # a neighbour in order with the same hash: the window is repeated
            after = F.slice(s, F.lit(2), F.size(s))
            before = F.concat(F.slice(s, F.lit(1), F.lit(1)), F.slice(s, F.lit(1), F.size(s) - 1))
            ahead = F.zip_with(s, after, lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("r")))
            back = F.zip_with(s, before, lambda a, b: (a["h"] == b["h"]) & (a["i"] != b["i"]))
            both = F.zip_with(ahead, back, lambda a, b: F.when(a["r"] | b, a["i"]))
            return F.array_sort(F.array_compact(both))

        def total(p):
            nxt = F.slice(p, F.lit(2), F.size(p))
            gaps = F.zip_with(p, nxt, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

        return let(let(ordered, positions), total)

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))

    return let(w, lambda v: F.when(F.size(v) < 3, 0).otherwise(let(grams(v), count)))


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    t = F.coalesce(text, F.lit(""))
    w = words(t)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))
    counts = let(w, lambda v: F.struct(F.size(v).alias("n"), repeated_words(v).alias("r")))
    return {
        "_words": counts,
        "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": dup.cast("long"),
    }


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                host_col: str = "source") -> DataFrame:
    """doc_id, host, the five counts and base_failed per row of ``docs``."""
    c = base_counts(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                       *(v.alias(k) for k, v in c.items()))
    return base.select(
        "doc_id", "host", F.col("_words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        "n_dup_lines", F.col("_words.r").cast("long").alias("n_repeat_words")
    ).withColumn("base_failed", RULES["base"](F.col))


#: Rules whose failures are summed by host; the first is the base verdict.
RULES = {
    "base": lambda c: (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEATED * c("n_words")),
    "short": lambda c: c("n_words") < MIN_WORDS,
    "repeats": lambda c: 100 * c("n_repeat_words") > MAX_REPEATED * c("n_words"),
    "symbols": lambda c: 10 * c("n_symbols") > c("n_words"),
    "lines": lambda c: 10 * c("n_dup_lines") > c("n_words"),
}


def host_rates(base: DataFrame, rules: dict[str, Column] | None = None, tail: float = TAIL) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk), host_rejected, and the
    shrunk ``rate_<rule>`` of each further rule; the first rule gives
    host_failed and host_rate (base_failed, where no rules are given).

    Each rule's beta prior has the hosts' mean failure rate and the weight that
    the variance of their rates implies, within [MIN_WEIGHT, MAX_WEIGHT] rows.
    """
    rules = rules or {"base": F.col("base_failed")}
    hosts = base.groupBy("host").agg(F.count("*").alias("host_docs"), *[
        F.sum(rule.cast("long")).alias(f"f_{name}") for name, rule in rules.items()])
    moments = hosts.agg(*[x for name in rules for x in (
        (F.sum(f"f_{name}") / F.sum("host_docs")).alias(f"m_{name}"),
        F.var_pop(F.col(f"f_{name}") / F.col("host_docs")).alias(f"v_{name}"))])

    def weight(name):
        m, v = F.col(f"m_{name}"), F.col(f"v_{name}")
        w = F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(MIN_WEIGHT))
        return F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), w)).alias(f"w_{name}")

    # one row of priors
    out = hosts.crossJoin(F.broadcast(moments.select("*", *[weight(name) for name in rules])))
    out = out.select("*", *[((F.col(f"f_{n}") + F.col(f"m_{n}") * F.col(f"w_{n}"))
                             / (F.col("host_docs") + F.col(f"w_{n}"))).alias(f"rate_{n}") for n in rules])

    def far(name):
        r = F.col(f"rate_{name}")
        low = r - tail * F.sqrt(F.greatest(F.lit(0.0), r * (1 - r)) / (F.col("host_docs") + F.col(f"w_{name}") + 1))
        return (low > F.col(f"m_{name}")) & (low > 0.5)

    rejected = F.lit(False)
    for name in rules:
        rejected = rejected | far(name)
    first, *more = rules
    return out.select("host", "host_docs", F.col(f"f_{first}").alias("host_failed"),
                      F.col(f"rate_{first}").alias("host_rate"), rejected.alias("host_rejected"),
                      *[f"rate_{n}" for n in more])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Counts, base verdict, host figures and ``kept`` per row of ``docs``."""
    base = materialise(rule_counts(docs, id_col, text_col, host_col), "host-rules")
    hosts = host_rates(base, {k: f(F.col) for k, f in RULES.items()}, tail).withColumnRenamed("host", "of")
    return (base.join(hosts, base["host"].eqNullSafe(hosts["of"]), "left").drop("of")
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` (columns text, source and others) that are kept.

    The texts are counted once and written with their verdicts.
    """
    columns = docs.columns
    c = base_counts(F.col("text"))
    flagged = docs.select(*[F.col(f"`{x}`") for x in columns], *[v.alias(f"_q_{k}") for k, v in c.items()])
    got = {"n_words": F.col("_q__words.n").cast("long"), "n_repeat_words": F.col("_q__words.r").cast("long"),
           "n_symbols": F.col("_q_n_symbols"), "n_dup_lines": F.col("_q_n_dup_lines")}
    flags = materialise(flagged.select(*[F.col(f"`{x}`") for x in columns], *[
        f(got.__getitem__).alias(f"_failed_{k}") for k, f in RULES.items()]), "quality")
    hosts = host_rates(flags.select(F.col("source").alias("host"), *[f"_failed_{k}" for k in RULES]),
                       {k: F.col(f"_failed_{k}") for k in RULES}, tail)
    bad = hosts.where("host_rejected").select(F.col("host").alias("_rejected_host"))
    return (flags.where(~F.col("_failed_base"))
            .join(bad, flags["source"].eqNullSafe(bad["_rejected_host"]), "left_anti")
            .select(*[F.col(f"`{x}`") for x in columns]))


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "host", "host_docs", "host_failed",
                      F.round("host_rate", 9).alias("host_rate"), "host_rejected",
                      *[F.round(f"rate_{k}", 9).alias(f"rate_{k}") for k in list(RULES)[1:]])


#: The same rows in DuckDB.
OP1_SQL = r"""
with d as (
  select doc_id, source as host, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), g as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3
), g3 as (
  select doc_id, i, count(*) over (partition by doc_id, w[i], w[i+1], w[i+2]) as n from g
), hit as (
  select doc_id, count(distinct j) as n_repeat_words from (
    select doc_id, unnest([i, i + 1, i + 2]) as j from g3 where n > 1) group by doc_id
), b as (
  select d.doc_id, host, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join hit using (doc_id)
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_words < 50 as f_short,
    100 * n_repeat_words > 50 * n_words as f_repeats, 10 * n_symbols > n_words as f_symbols,
    10 * n_dup_lines > n_words as f_lines from b
), u as (
  select host, rule, count(*) as docs, sum(failed::bigint)::bigint as failed
  from (select host, unnest(['base', 'short', 'repeats', 'symbols', 'lines']) as rule,
          unnest([base_failed, f_short, f_repeats, f_symbols, f_lines]) as failed from f)
  group by host, rule
), p as (
  select rule, sum(failed) / sum(docs) as mean, var_pop(failed / docs) as var from u group by rule
), q as (
  select rule, mean, greatest(2.0, least(1000.0, case when var > 0 then mean * (1 - mean) / var - 1 else 2.0 end)) as weight from p
), r as (
  select u.*, mean, weight, (failed + mean * weight) / (docs + weight) as rate from u join q using (rule)
), l as (
  select *, rate - 3 * sqrt(greatest(0, rate * (1 - rate)) / (docs + weight + 1)) as low from r
), h as (
  select host, any_value(docs) as host_docs, max(failed) filter (rule = 'base') as host_failed,
    max(rate) filter (rule = 'base') as host_rate, bool_or(low > mean and low > 0.5) as host_rejected,
    max(rate) filter (rule = 'short') as rate_short, max(rate) filter (rule = 'repeats') as rate_repeats,
    max(rate) filter (rule = 'symbols') as rate_symbols, max(rate) filter (rule = 'lines') as rate_lines
  from l group by host
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not host_rejected as kept, f.host, host_docs, host_failed, round(host_rate, 9) as host_rate,
  host_rejected, round(rate_short, 9) as rate_short, round(rate_repeats, 9) as rate_repeats,
  round(rate_symbols, 9) as rate_symbols, round(rate_lines, 9) as rate_lines
from f join h on f.host is not distinct from h.host
"""
