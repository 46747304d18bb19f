"""Personal data by candidate gradient boosting (operator 13), DataFrame functions only.

Generators of high recall propose overlapping spans: loosely written addresses,
dotted number groups, digit groups and number runs. Each candidate becomes
format features (digits, separators, Luhn sum, groups, length) and context
features (cue words before it, the characters around it). Boosted trees score
it, and a threshold per kind, calibrated on held-out candidates, selects spans.

Training needs no personal labels. True are candidates that a base pattern accepts
with its check, wide ones that overlap such a span of their kind, and wide ones
whose normalised value is an accepted base value anywhere in the corpus; all
others count as false (failed Luhn sums, parts over 255, wrong digit counts, number
runs that nothing confirms). The trees are fitted on every distinct candidate but a
held-out quarter by hash, on which the thresholds are set. Candidates with the same
bins and label are one row with their number; a level of a tree is one aggregate over
these rows, and the sums by (leaf, feature, bin), whose number is the model's, reach
the driver. The model is one nested expression per tree, so no row leaves the JVM.

Base spans are always kept; a candidate that overlaps a base span of its kind
adds nothing. Added spans have the kinds ``email+``, ``ip+``, ``card+`` and
``phone+``. ``redact_pii`` replaces every selected span.

Defined results: null text has no spans; repeated rows are each returned; a
corpus with one class of candidates only (or none) adds no spans; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators.evaluate import running_totals
from .common import let, materialise, table

KINDS = ("email", "ip", "card", "phone")
# A repeated group is possessive (++): a greedy one takes stack for every turn, so a run of a few thousand digits
# overflowed it and ended the executor. Nothing follows these groups, so the matches are the same.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of the added kinds: more than the base patterns take.
WIDE = (
    r"(?i)[A-Za-z0-9._%+-]+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)++",
    r"[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}",
    r"(?<![0-9])(?:[0-9]{4}(?:[\x20._-]{1,2}[0-9]{4}){3}|3[47][0-9]{2}[\x20._-]{1,2}[0-9]{6}[\x20._-]{1,2}[0-9]{5})(?![0-9])",
    r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
)
CUES = (r"(?i)mail|contact|write", r"(?i)\bip\b|host|server|address", r"(?i)card|visa|master|amex|pay", r"(?i)phone|call|tel|mobile|fax")
NOT_PERSONAL = r"(?i)version|order|item|invoice|isbn|build|ref|hash|page|no\.?\s*$"
#: A threshold keeps at least this share of true candidates among those it selects.
PRECISION = 0.95
PROFILE = bo.Profile(rounds=30, eta=0.3, depth=3, bins=32, min_child_weight=2.0)
FEATURES = (*(f"is_{k}" for k in KINDS), "length", "digits", "groups", "luhn", "octets", "at", "dot", "comma", "space", "dash",
            "plus", "paren", "letter_before", "digit_before", "plus_before", "letter_after", "digit_after", "cue", "stop")
_CANDIDATES = ("array<struct<start:int,kind:int,end:int,wide:boolean,passes:boolean,value:string,"
               + ",".join(f"{c}:double" for c in FEATURES) + ">>")
_CONTEXT = 24
_BLOCK = 256
_SPANS = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
#: Lowest threshold.
LEAST = 0.5


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping spans of a pattern: start, end (code points), hit, and
    what stands before and after it up to the neighbouring matches.

    Positions are sums over the lengths of gaps and matches, in blocks of ``_BLOCK``
    matches, so a text of very many matches costs no quadratic array."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(parts):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")),
                             lambda b: F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK)))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(
            F.element_at(acc, -1) + F.aggregate(p, F.lit(0), lambda a, x: a + x["g"] + F.length(x["h"])))))

        def inside(block, at):
            return F.aggregate(
                block, F.struct(at.alias("pos"), F.array().cast(_SPANS).alias("out")),
                lambda acc, x: F.struct(
                    (acc["pos"] + x["g"] + F.length(x["h"])).alias("pos"),
                    F.concat(acc["out"], F.array(F.struct(
                        (acc["pos"] + x["g"]).alias("start"), (acc["pos"] + x["g"] + F.length(x["h"])).alias("end"),
                        x["h"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")))).alias("out")),
                lambda acc: acc["out"])

        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), inside))

    def paired(gaps):
        return F.zip_with(F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(
            h.alias("h"), F.length(g).alias("g"), F.right(g, F.lit(_CONTEXT)).alias("before"))),
            F.slice(gaps, F.lit(2), F.size(hits)), lambda p, g: F.struct(
                p["h"].alias("h"), p["g"].alias("g"), p["before"].alias("before"), F.left(g, F.lit(1)).alias("after")))

    return F.when(F.size(hits) > 0, let(let(F.split(text, pattern, -1), paired), placed)).otherwise(F.array().cast(_SPANS))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string is a multiple of ten."""
    def step(acc, c):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["even"], twice).otherwise(d)).alias("sum"), (~acc["even"]).alias("even"))

    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("even")), step, lambda acc: acc["sum"] % 10 == 0)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def largest_part(hit: Column) -> Column:
    """Largest of the number groups of a span, up to five digits each."""
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))

    def value(g):
        short = F.ltrim(g, F.lit("0"))
        return F.when(F.length(short) > 5, 99999).otherwise(F.coalesce(F.nullif(F.substring(short, 1, 5), F.lit("")).cast("int"), F.lit(0)))

    return F.coalesce(F.array_max(F.transform(groups, value)), F.lit(0))


def normal_value(kind: int, hit: Column) -> Column:
    """A candidate's value without its spelling: digits, or a lower-case address."""
    if kind == 1:
        return F.regexp_replace(F.regexp_replace(hit, ",", "."), r"\x20", "")
    if kind:
        return digits_of(hit)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, r"(?i)\(at\)|\[at\]", "@"), r"(?i)\(dot\)|\[dot\]", "."), r"\x20", ""))


def base_passes(kind: int, hit: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return largest_part(hit) <= 255
    n = F.length(digits_of(hit))
    if kind == 2:
        return n.between(14, 19) & luhn(digits_of(hit))
    return n.between(10, 15)


def proposals(text: Column) -> Column:
    """Matches of the base patterns with their checks' results, and of the wide generators,
    with a hash of the value and the features."""
    t = F.coalesce(text, F.lit(""))
    # cheap tests first: few texts have a candidate of a kind at all
    base_hints = (t.contains("@"), t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), t.rlike(r"[0-9](?:[\x20-]?[0-9]){8}"), t.contains("+"))
    wide_hints = (t.rlike(r"(?i)\(at\)|\[at\]"), t.rlike(WIDE[1]), t.rlike(WIDE[2]), t.rlike(WIDE[3]))

    def maker(kind, wide):
        def made(s):
            f = features(kind, s)
            return F.struct(
                s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(wide).alias("wide"),
                (F.lit(False) if wide else base_passes(kind, s["hit"])).alias("passes"),
                F.sha2(normal_value(kind, s["hit"]), 256).alias("value"), *(f[c].alias(c) for c in FEATURES))
        return made

    parts = []
    for wide, patterns, hints in ((False, (EMAIL, IP, CARD, PHONE), base_hints), (True, WIDE, wide_hints)):
        for kind, pattern in enumerate(patterns):
            found = spans_of(t, pattern)
            if kind == 2:  # most digit groups are too short for any card
                found = F.filter(found, lambda s: F.length(s["hit"]) >= 9)
            parts.append(F.when(hints[kind], F.transform(found, maker(kind, wide))).otherwise(F.array().cast(_CANDIDATES)))
    return F.concat(*parts)


def features(kind: int, s: Column) -> dict[str, Column]:
    """Format and context features of a candidate, as doubles."""
    hit, last, after = s["hit"], F.right(s["before"], F.lit(1)), s["after"]
    digits = digits_of(hit)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    count = lambda ch: (F.length(hit) - F.length(F.replace(hit, F.lit(ch), F.lit("")))).cast("double")
    return {
        "is_" + KINDS[0]: F.lit(float(kind == 0)), "is_" + KINDS[1]: F.lit(float(kind == 1)),
        "is_" + KINDS[2]: F.lit(float(kind == 2)), "is_" + KINDS[3]: F.lit(float(kind == 3)),
        "length": F.length(hit).cast("double"), "digits": F.length(digits).cast("double"),
        "groups": F.size(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "luhn": flag((F.length(digits) > 0) & luhn(digits)), "octets": flag(largest_part(hit) <= 255),
        "at": count("@"), "dot": count("."), "comma": count(","), "space": count(" "), "dash": count("-"), "plus": count("+"),
        "paren": count("("), "letter_before": flag(last.rlike(r"\p{L}")), "digit_before": flag(last.rlike("[0-9]")),
        "plus_before": flag(last == "+"), "letter_after": flag(after.rlike(r"\p{L}")), "digit_after": flag(after.rlike("[0-9]")),
        "cue": flag(s["before"].rlike(CUES[kind])), "stop": flag(s["before"].rlike(NOT_PERSONAL)),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, first, doc_id (null where not ``first``), a candidate with its features: a row
    per candidate of each row of ``docs``, or one of nulls where it has none. Arrays of
    them would be read back whole, thousands of texts at a time."""
    found = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"),
                        proposals(F.col(text_col)).alias("found"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return found.select("row_id", "doc_id", F.posexplode_outer("found").alias("pos", "s")).select(
        "row_id", first.alias("first"), F.when(first, F.col("doc_id")).alias("doc_id"), "s.*")


def labelled(found: DataFrame) -> DataFrame:
    """A row per candidate with ``base`` (accepted), ``apart`` (a wide one that overlaps no
    base span of its kind) and the label ``y``."""
    rows = found.where(F.col("kind").isNotNull()).drop("first", "doc_id").withColumn("base", ~F.col("wide") & F.col("passes"))
    near = Window.partitionBy("row_id", "kind").orderBy("start")
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(near.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("touches", F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False)))
    known = rows.where("base").select("kind", "value").distinct().withColumn("known", F.lit(True))
    return rows.join(known, ["kind", "value"], "left").withColumn("apart", F.col("wide") & ~F.col("touches")).withColumn(
        "y", (F.col("base") | F.col("wide") & (F.col("touches") | F.col("known").isNotNull())).cast("int"))


def training_rows(rows: DataFrame) -> DataFrame:
    """key, kind, y, held, features of every distinct candidate: a value that is copied
    everywhere counts once, whatever the number of documents."""
    one = rows.groupBy(F.sha2(F.concat_ws(":", "kind", "wide", "passes", "value"), 256).alias("key"), "kind").agg(
        F.max("y").alias("y"), *(F.max(c).alias(c) for c in FEATURES))
    held = F.conv(F.substring("key", 9, 4), 16, 10).cast("int") % 4 == 0
    return materialise(one.withColumn("held", held), "pii-training")


def tree_expression(tree: list[tuple], cuts: list[list[float]], x, node: int = 0) -> Column:
    """A tree as nested conditions over the candidate's features."""
    _, f, b, left, right, value, _, _ = tree[node]
    if f < 0:
        return F.lit(float(value))
    return F.when(x(FEATURES[f]) <= F.lit(cuts[f][b]), tree_expression(tree, cuts, x, left)).otherwise(
        tree_expression(tree, cuts, x, right))


def probability(model: bo.TreeModel) -> Column:
    """Score of a candidate's row."""
    z = F.lit(0.0)
    for t in model.trees:
        z = z + tree_expression(t, model.cuts, F.col)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def binned(fit: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """y, n and a bin per feature (the number of cuts below the value): a row per distinct combination."""
    bins = [sum(((F.col(f) > F.lit(v)).cast("int") for v in c), F.lit(0)).alias(f) for f, c in zip(FEATURES, cuts)]
    return fit.select("y", *bins).groupBy("y", *FEATURES).agg(F.count(F.lit(1)).alias("n"))


def grown(table: DataFrame, p: bo.Profile = PROFILE) -> list[list[tuple]]:
    """All rounds of boosting over the binned rows of ``binned``."""
    import numpy as np

    steps = [list(range(p.bins))] * len(FEATURES)  # a row's value is its bin
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f).alias("b")) for k, f in enumerate(FEATURES))))
    trees: list[list[tuple]] = []
    for r in range(p.rounds):
        z = F.lit(0.0)
        for t in trees:
            z = z + tree_expression(t, steps, F.col)
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        whole = lambda c: F.floor(c * F.col("n") * F.lit(float(bo.SCALE)) + 0.5).cast("long")
        state = table.withColumn("p", prob).select(*FEATURES, whole(F.col("p") - F.col("y")).alias("g"), whole(F.col("p") * (1 - F.col("p"))).alias("h"))
        grower = bo.Grower(p)
        while grower.open:
            slot = {node: k for k, node in enumerate(grower.open)}
            tree = [(n, f, b, left, right, float(slot.get(n, -1)), 0.0, 0.0) for n, f, b, left, right, *_ in bo._growing(grower)]
            sums = state.withColumn("leaf", tree_expression(tree, steps, F.col).cast("int")).where("leaf >= 0") \
                .select("leaf", "g", "h", cells.alias("c")).groupBy("leaf", "c").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            hist = np.zeros((2, len(slot), len(FEATURES), p.bins))
            for x in sums.select("leaf", "c.k", "c.b", "g", "h").collect():  # at most leaves x features x bins rows
                hist[:, x["leaf"], x["k"], x["b"]] = x["g"], x["h"]
            grower.add(bo.best_splits(hist, list(range(len(FEATURES))), p, grower.open_paths(), r))
        trees.append(grower.tree())
    return trees


def fitted(rows: DataFrame, precision: float = PRECISION):
    """(model, threshold per kind) from all training rows: a quarter is held out, and a
    kind's threshold is the least score (at least ``LEAST``) from which the held-out
    candidates are true to ``precision``. None where there is one class only."""
    fit = rows.where("not held")
    if fit.select("y").distinct().count() < 2:
        return None
    cuts = bo.quantile_cuts(fit, list(FEATURES), PROFILE.bins)
    table = materialise(binned(fit, cuts), "pii-binned")
    model = bo.TreeModel(list(FEATURES), cuts, PROFILE, grown(table))
    scores = rows.where("held").select("kind", "y", probability(model).alias("p")).groupBy("kind", "p").agg(
        F.sum("y").alias("good"), F.count(F.lit(1)).alias("n"))
    above = running_totals(scores, "p", ["good", "n"], within=["kind"])
    least = above.where((F.col("cum_good") >= F.lit(precision) * F.col("cum_n")) & (F.col("p") >= LEAST)).groupBy("kind").agg(F.min("p").alias("p"))
    return model, {x["kind"]: float(x["p"]) for x in least.collect()}


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """doc_id, base array<struct<start, kind, end>>, added array<struct<start, kind,
    end>> per row of ``docs``; kinds number KINDS."""
    found = materialise(candidates(docs, id_col, text_col), "pii-candidates")
    rows = materialise(labelled(found), "pii-labelled")
    fit = fitted(training_rows(rows), precision)
    chosen = F.lit(False) if fit is None else F.col("apart") & (probability(fit[0]) >= _limit(fit[1], F.col("kind")))
    span = F.struct("start", "kind", "end")
    some = rows.withColumn("chosen", chosen).where("base or chosen").groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(F.collect_set(F.when(F.col("chosen"), span))).alias("added"))
    none = F.array().cast(some.schema["base"].dataType)
    return found.where("first").select("row_id", "doc_id").join(some, "row_id", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _limit(limits: dict[int, float], kind: Column) -> Column:
    out = F.lit(2.0)  # no score reaches it
    for k, p in limits.items():
        out = F.when(kind == k, F.lit(float(p))).otherwise(out)
    return out


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every selected span replaced by its kind in brackets."""
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    marked = pii_spans(rows.select(F.struct("doc_id", "t").alias("row"), F.col("t").alias("t2")), "row", "t2")
    marked = marked.select("doc_id.doc_id", "doc_id.t", F.array_sort(F.concat("base", "added")).alias("spans"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # spans that begin inside an earlier one vanish with it
    kept = F.aggregate("spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["pos"], s["end"]).alias("pos"),
        F.when(s["start"] >= acc["pos"], F.concat(acc["out"], t.substr(acc["pos"] + 1, s["start"] - acc["pos"]),
                                                  F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], t.substr(acc["pos"] + 1, F.length(t))))
    return marked.select("doc_id", kept.alias("text"))


def _joined(spans: Column, names: tuple[str, ...]) -> Column:
    labels = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(labels, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    # added kinds are listed after the base ones
    every = F.array_sort(F.concat("base", F.transform("added", lambda s: F.struct(
        s["start"].alias("start"), (s["kind"] + len(KINDS)).alias("kind"), s["end"].alias("end")))))
    names = KINDS + tuple(f"{k}+" for k in KINDS)
    return out.select("doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)),
                      F.sha2(_joined(F.col("base"), names), 256).alias("base_sha256"), _joined(every, names).alias("spans"))
