"""Language ID by Bayesian evidence fusion (operator 6).

The classes are all languages that label a row, found by grouped aggregation,
and one more for texts in none of them. Evidence for a document's class:

* text: naive Bayes over byte trigrams (ASCII lower case, hashed to 2**16
  buckets), counted over all labelled documents. A text's mean
  log-likelihood counts as at most ``TEXT_WEIGHT`` trigrams, as neighbouring
  trigrams are no independent evidence. The class "none of them" has the
  threshold of the best language as its mean: the point as many standard
  deviations below that language's own texts as above the nearest other
  language's, each scored by the trigrams of the half of the rows it is not in;
* declared language (markup's lang attribute, or a table's column):
  P(declared | language) from the corpus, smoothed;
* address suffix and host: a prior that shrinks from all documents to the
  suffix to the host (Dirichlet weights), counted by grouped aggregation of
  what the texts alone say; a document's own vote is taken out of its prior.

The model is languages x 2**16 numbers, summed per task before the shuffle.
Scores (no texts) are written once; counts per host are partial aggregates,
so one host with a third of all rows is a few rows per task, and priors join
back by Spark's size-checked choice of join.

A document is rejected where no language reaches ``MIN_POSTERIOR`` or the text
has no letter; its language is null where "none of them" is likeliest. Defined
results: null text counts as empty and is rejected; null declarations,
addresses and hosts give no evidence of their own (a null host has the suffix's
prior); a declaration that labels no row speaks for "none of them", unless the
corpus' texts say otherwise; null and empty labels are no languages; repeated
rows each count; columns other than those named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, materialise, ship, table

BUCKETS = 1 << 16
#: Mean log-likelihood of evenly spread trigrams; no threshold lies below it.
UNIFORM = -math.log(BUCKETS)
#: Class of the texts in no labelled language.
OTHER = ""
#: Models that a task adds up before it sends them.
HELD_MODELS = 64
TEXT_WEIGHT = 64.0
SUFFIX_WEIGHT = 50.0
HOST_WEIGHT = 20.0
DECLARED_WEIGHT = 5.0
MIN_POSTERIOR = 0.5


def trigram_buckets(raw):
    """Bucket of the byte trigram that starts at each byte but the last two."""
    import numpy as np

    low = np.arange(256, dtype=np.uint32)
    low[65:91] += 32
    b = low[raw]
    key = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(16)


def _trigrams(texts: list[bytes]):
    """(buckets of all texts, first bucket and number of buckets per text): the
    texts are laid end to end and trigrams across two texts left out."""
    import numpy as np

    n = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts) + b"\0\0", np.uint8)
    start = np.cumsum(n) - n
    return trigram_buckets(raw), start, np.maximum(n - 2, 0)


def _slices(column, size: int = 2_000_000):
    out, held = [], 0
    for v in column:
        out.append(v.as_py())
        held += len(out[-1])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def _labelled(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """t, l, fold of all rows with a text and a label; copies share a fold."""
    label = F.nullif(F.lower(F.trim(F.col(label_col))), F.lit(OTHER))
    return labelled.where(label.isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("binary").alias("t"), label.alias("l"), F.pmod(F.xxhash64(text_col), F.lit(2)).cast("int").alias("fold"))


def trigram_counts(rows: DataFrame) -> DataFrame:
    """language, fold, bucket, n over ``rows`` (t, l, fold): each task adds up
    its own rows and sends its sums once (once per ``HELD_MODELS`` languages and folds)."""

    def sums(total):
        import numpy as np
        import pyarrow as pa

        for (label, fold), n in total.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(bucket), pa.string()), pa.array(np.full(len(bucket), fold, np.int32)),
                 pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], names=["language", "fold", "bucket", "n"])

    def run(batches):
        import numpy as np

        total = {}
        for b in batches:
            at = 0
            for texts in _slices(b.column(0)):
                keys = list(zip(b.column(1).slice(at, len(texts)).to_pylist(), b.column(2).slice(at, len(texts)).to_pylist()))
                at += len(texts)
                buckets, start, n = _trigrams(texts)
                parts = {}
                for key, s, c in zip(keys, start.tolist(), n.tolist()):
                    parts.setdefault(key, []).append(buckets[s:s + c])
                for key, own in parts.items():
                    if key not in total:
                        if len(total) == HELD_MODELS:
                            yield from sums(total)
                            total.clear()
                        total[key] = np.zeros(BUCKETS, np.int64)
                    total[key] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        yield from sums(total)

    return (rows.mapInArrow(run, "language string, fold int, bucket int, n long")
            .groupBy("language", "fold", "bucket").agg(F.sum("n").alias("n")))


def _logs(counts):
    """Log-likelihoods per bucket and language, smoothed by one half."""
    import numpy as np

    counts = counts + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def score_moments(rows: DataFrame, halves, languages) -> DataFrame:
    """label, language (number), n, sum and sum of squares of the mean log-likelihoods
    of the rows with ``TEXT_WEIGHT`` trigrams or more, by the other fold's model."""
    shared = rows.sparkSession.sparkContext.broadcast(halves)
    ways = len(languages)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = {}
        for b in batches:
            at = 0
            for texts in _slices(b.column(0)):
                labels, folds = (b.column(i).slice(at, len(texts)).to_pylist() for i in (1, 2))
                at += len(texts)
                buckets, start, n = _trigrams(texts)
                for label, fold, s, c in zip(labels, folds, start.tolist(), n.tolist()):
                    if c >= TEXT_WEIGHT:
                        x = shared.value[1 - fold][buckets[s:s + c]].sum(axis=0, dtype=np.float64) / c
                        total[label] = total.get(label, 0) + np.array([np.ones(ways), x, x * x])
        for label, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * ways, pa.string()), pa.array(np.arange(ways, dtype=np.int32)),
                                              *(pa.array(v) for v in m)], names=["label", "language", "n", "x", "xx"])

    return (rows.mapInArrow(run, "label string, language int, n double, x double, xx double").groupBy("label", "language")
            .agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx")))


def thresholds(moments, languages):
    """Per language the mean log-likelihood under which a text is none of its own,
    from the rows of ``score_moments``; never within three standard deviations
    of its own mean."""
    import numpy as np

    at = {(r["label"], r["language"]): (r["x"] / r["n"], math.sqrt(max(0.0, r["xx"] / r["n"] - (r["x"] / r["n"]) ** 2)))
          for r in moments}
    out = np.full(len(languages), UNIFORM)
    for i, own in enumerate(languages):
        if (own, i) in at:
            mean, sd = at[own, i]
            others = [at[x, i] for x in languages if x != own and (x, i) in at]
            cuts = [m + (mean - m) * (s / (s + sd) if s + sd else 0.5) for m, s in others if m < mean] or [(mean + UNIFORM) / 2]
            out[i] = max(UNIFORM, min(max(cuts), mean - 3 * sd))
    return out


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang"):
    """Languages, log-likelihoods per bucket and language (2**16 rows), thresholds."""
    import numpy as np

    ship(labelled.sparkSession)
    rows = _labelled(labelled, text_col, label_col)
    found = trigram_counts(rows).toArrow()
    names = found["language"].to_numpy(zero_copy_only=False)
    languages = sorted(set(names))
    counts = np.zeros((2, len(languages), BUCKETS))
    counts[found["fold"].to_numpy(), np.searchsorted(languages, names) if languages else [], found["bucket"].to_numpy()] = found["n"].to_numpy()
    moments = score_moments(rows, [_logs(c) for c in counts], languages).collect()
    return languages, _logs(counts.sum(axis=0)), thresholds(moments, languages)


def suffix_of(host: Column) -> Column:
    """Last label of a host name with a dot; none otherwise."""
    return F.when(host.contains("."), F.lower(F.regexp_extract(host, r"([^.]+)\.?$", 1)))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def declared_of(html: Column) -> Column:
    """Language of the root element's lang attribute, without region."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))


def text_scores(docs: DataFrame, model, limits, id_col: str, text: Column, declared: Column, host: Column) -> DataFrame:
    """doc_id, declared, host, suffix, letters, n (trigrams), scores: mean
    log-likelihood per language of the whole text, then the best one's limit."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model, limits))
    ways = model.shape[1] + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m, least = shared.value
        for b in batches:
            at = 0
            for texts in _slices(b.column(3)):
                buckets, start, n = _trigrams(texts)
                sums = np.zeros((len(texts), ways))
                for k, (s, c) in enumerate(zip(start.tolist(), n.tolist())):
                    if c:
                        sums[k, :-1] = m[buckets[s:s + c]].sum(axis=0, dtype=np.float64) / c
                        sums[k, -1] = least[sums[k, :-1].argmax()] if ways > 1 else UNIFORM
                scores = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * ways),
                                                  pa.array(sums.ravel()))
                head = [b.column(i).slice(at, len(texts)) for i in (0, 1, 2, 4, 5)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(n), scores], names=[
                    "doc_id", "declared", "host", "letters", "text_hash", "n", "scores"])
                at += len(texts)

    t = F.coalesce(text, F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.nullif(F.lower(F.trim(declared)), F.lit(OTHER)).alias("declared"), host.alias("host"),
                       t.cast("binary").alias("t"), t.rlike(r"\p{L}").alias("letters"),
                       F.xxhash64(t).alias("text_hash")).mapInArrow(
        run, f"doc_id {kind}, declared string, host string, letters boolean, text_hash long, n long, scores array<double>"
    ).withColumn("suffix", suffix_of(F.col("host")))


def _vote() -> Column:
    """Number of the class that the text alone favours; none without trigrams."""
    return F.when(F.col("n") > 0, F.array_position("scores", F.array_max("scores")).cast("int"))


def _share(counts: Column, own: Column, parent: Column, weight: float) -> Column:
    """Shrunk shares: (counts - own vote + weight * parent) / their sum."""
    less = F.transform(counts, lambda c, i: F.greatest(c - F.when(own == i + 1, 1).otherwise(0), F.lit(0)).cast("double"))
    return let(less, lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda s: F.zip_with(
        c, parent, lambda x, p: (x + F.lit(weight) * p) / (s + F.lit(weight)))))


def fuse(scored: DataFrame, languages, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """doc_id, language, posterior, text_language, declared, host, kept from the
    stored rows of ``text_scores``."""
    classes = [*languages, OTHER]
    ways = len(classes)
    s = scored.withColumn("vote", _vote())
    votes = [F.sum((F.col("vote") == i + 1).cast("long")) for i in range(ways)]
    counts = F.array(*(F.coalesce(v, F.lit(0)) for v in votes))
    everyone = s.agg(counts.alias("all_votes"))  # one row
    by_suffix = s.where("suffix is not null").groupBy("suffix").agg(counts.alias("suffix_votes"))
    by_host = s.where("host is not null").groupBy("host").agg(counts.alias("host_votes"))
    by_declared = s.where("declared is not null").groupBy("declared").agg(counts.alias("declared_votes"))
    zero = F.array(*(F.lit(0).cast("long") for _ in classes))
    even = F.array(*(F.lit(1.0 / ways) for _ in classes))
    known = F.array(*(F.lit(x) for x in classes))
    stated = F.when(F.array_contains(known, F.col("declared")), F.col("declared")).otherwise(OTHER)
    joined = (s.crossJoin(F.broadcast(everyone)).join(by_suffix, "suffix", "left").join(by_host, "host", "left")
              .join(by_declared, "declared", "left"))
    own = F.coalesce("vote", F.lit(0))

    def level(column, parent, weight):
        return _share(F.coalesce(column, zero), own, parent, weight)

    prior = let(level(F.col("all_votes"), even, 4.0), lambda p: let(level(F.col("suffix_votes"), p, SUFFIX_WEIGHT), lambda q: level(
        F.col("host_votes"), q, HOST_WEIGHT)))
    # P(declared | language), a little held back for honest mistakes where the corpus is small
    said = F.transform(F.coalesce("declared_votes", zero), lambda c, i: (
        c - F.when(own == i + 1, 1).otherwise(0)
        + F.lit(DECLARED_WEIGHT) * F.when(F.element_at(known, i + 1) == stated, 0.9).otherwise(0.1 / max(1, ways - 1)))
        / (F.element_at(F.col("all_votes"), i + 1) + F.lit(DECLARED_WEIGHT)))
    # no declaration says nothing
    said = F.when(F.col("declared").isNotNull(), said).otherwise(F.array(*(F.lit(1.0) for _ in classes)))
    weight = F.least(F.col("n").cast("double"), F.lit(TEXT_WEIGHT))
    logs = joined.withColumn("prior", prior).withColumn("said", said).withColumn("log", F.zip_with(
        F.zip_with("scores", "prior", lambda x, p: weight * x + F.log(p)), "said", lambda x, d: x + F.log(F.greatest(d, F.lit(1e-9)))))
    total = let(F.array_max("log"), lambda m: F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    best = F.array_position("log", F.array_max("log")).cast("int")
    return (logs.withColumn("posterior", 1 / total).withColumn("language", F.nullif(F.element_at(known, best), F.lit(OTHER)))
            .withColumn("text_language", F.nullif(F.element_at(known, F.nullif(F.col("vote"), F.lit(0))), F.lit(OTHER)))
            .withColumn("kept", F.col("letters") & F.col("language").isNotNull() & (F.col("posterior") >= min_posterior))
            .select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", "host", "kept", "text_hash"))


def identify(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, declared: Column | None = None,
             host: Column | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Fused language per row. For pages pass ``declared_of(html)`` and ``host_of(url)``;
    ``labelled`` (text, lang) trains the text model and defaults to ``docs``."""
    languages, model, limits = fit(labelled if labelled is not None else docs)
    none = F.lit(None).cast(T.StringType())
    scored = materialise(text_scores(docs, model, limits, id_col, F.col("text") if text is None else text,
                                     none if declared is None else declared, none if host is None else host), "language-scores")
    return fuse(scored, languages)


def op6_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: its ``lang`` column is the declaration, ``source`` the host."""
    return identify(table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source")).drop("text_hash")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, source and others) whose language is
    identified. Rejected rows are named by id and text hash; the texts are
    shuffled only where those are too many for a broadcast join."""
    rejected = (identify(docs, declared=F.col("lang"), host=F.col("source")).where(~F.col("kept"))
                .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_id"])
                     & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == rejected["_hash"]), "left_anti")
