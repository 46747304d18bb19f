"""Operator 13: base spans against plain Python, added spans on planted forms."""

import hashlib
import random
import re

from ivnflow.llm import pii_boosting as pb

BASE = ((0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        (2, "card", r"[0-9]([\x20-]?[0-9])+"), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


PREFIX = ("call", "ring", "und", "of the")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, name, pattern in BASE:
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in re.findall("[0-9]+", m.group())) or k == 2 and not (14 <= len(d) <= 19 and luhn(d)) \
                    or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), name))
    return sorted(out)


def card(r):
    d = "".join(r.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def corpus(seed=4, n=400):
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    docs = []
    for k in range(n):
        phone = f"({r.randint(200, 999)}) 555-{num(4)}"
        parts = [f"mail u{k}@site{k % 7}.example.org", f"host 10.{r.randint(0, 255)}.{r.randint(0, 255)}.7", f"card {card(r)}",
                 f"{r.choice(PREFIX)} +1 {phone}", f"id {num(16)}", f"v 1.2.{r.randint(256, 999)}.4", f"order {num(9)}", f"+{num(4)}", "plain words é日本"]
        docs.append((k, " ; ".join(r.sample(parts, 6))))
    return docs


def run(spark, docs):
    df = spark.createDataFrame([(*d, "x", 1, True) for d in docs], "doc_id long, text string, kind string, start int, base boolean")
    return {r["doc_id"]: r for r in pb.pii_spans(df).collect()}, df


def test_base_spans_equal_brute_force_and_planted_forms_are_added(spark):
    docs = corpus()
    planted = {1000: "ring (415) 555-0199 today", 1001: "nothing but words", 1002: "10, 20, 30, 40 and 1.2.300.4",
               1003: "call +1 (826) 555-4081 190.137.223.204 now", 1004: None, 1005: "", 1006: "4111 1111 1111 1112"}
    got, _ = run(spark, docs + list(planted.items()))
    for k, text in docs + list(planted.items()):
        assert [(s["start"], s["kind"], s["end"]) for s in got[k]["base"]] == [b[:3] for b in brute(text)], text
    added = {k: [(planted[k][s["start"]:s["end"]], s["kind"]) for s in got[k]["added"]] for k in planted}
    assert added[1000] == [("(415) 555-0199", 3)] and added[1003] == [("(826) 555-4081", 3)]
    assert all(not added[k] for k in (1001, 1002, 1004, 1005, 1006))
    assert not any(got[k]["added"] for k, _ in docs)


def test_long_texts_and_many_matches(spark):
    text = "日" * 70_000 + " 1.2.3.4 é" * 3_000 + "a@b.co"
    got, _ = run(spark, [(1, text), (2, text), (2, text)])
    assert [(s["start"], s["kind"], s["end"]) for s in got[1]["base"]] == [b[:3] for b in brute(text)]


def test_redaction(spark):
    docs = corpus() + [(2000, "é ring (415) 555-0199, a@b.co"), (2001, None), (2002, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pb.redact_pii(df).collect()}
    assert got[2000] == "é ring [PHONE], [EMAIL]" and got[2001] == "" and got[2002] == "clean"


def test_empty_and_clean_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pb.pii_spans(df).collect() == []
    got, _ = run(spark, [(1, "no data"), (None, "+12 345 678 9012")])
    assert not got[1]["base"] and len(got[None]["base"]) == 1 and not got[None]["added"]


def test_query_columns(spark):
    from conftest import SF001
    out = pb.op13_pii_boosting(spark, SF001)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    for r in out.collect():
        b = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in b).encode()).hexdigest()
        assert [r[f"n_{n}"] for n in pb.KINDS] == [sum(x[3] == n for x in b) for n in pb.KINDS]
        assert {f"{n}:{s}:{e}" for s, _, e, n in b} <= set(r["spans"].split(",")) or not b


def test_the_model_counts_every_distinct_candidate(spark):
    """Trees over all rows by aggregates equal the ones over whole arrays; no part of the rows is left out."""
    import numpy as np

    r = random.Random(8)
    rows = [(f"{k:064x}", r.randrange(4), r.randrange(2), r.random() < 0.25, *(float(r.choice([0, 0, 1, k % 7])) for _ in pb.FEATURES)) for k in range(21_000)]
    df = spark.createDataFrame(rows, "key string, kind int, y int, held boolean, " + ", ".join(f"{c} double" for c in pb.FEATURES))
    fit = [x for x in rows if not x[3]]
    cuts = pb.bo.quantile_cuts(df.where("not held"), list(pb.FEATURES), pb.PROFILE.bins)
    table = pb.binned(df.where("not held"), cuts)
    assert table.agg({"n": "sum"}).first()[0] == len(fit)
    got = pb.grown(table.coalesce(2).cache(), pb.bo.replace(pb.PROFILE, rounds=1))
    bins = np.array([[np.searchsorted(c, v, "left") for c, v in zip(cuts, x[4:])] for x in fit]).astype(np.uint8)
    want, _ = pb.bo.grow_all(np.arange(len(fit)), np.array([x[2] for x in fit], float), np.ones(len(fit)), np.zeros(len(fit), bool), bins,
                             pb.bo.replace(pb.PROFILE, rounds=1))
    assert [[n[:5] for n in t] for t in got] == [[n[:5] for n in t] for t in want]
    assert got[0][0][7] == want[0][0][7] == len(fit) / 4  # the root's cover: p (1 - p) of every row


def test_long_runs_take_no_stack(spark):
    """Java's matcher recurses for every turn of a greedy group: a few thousand turns ended the task and its executor."""
    n = 20_000
    runs = ((pb.CARD, "1" * n), (pb.CARD, "12 3-4 " * n + "5"), (pb.EMAIL, "a@b" + ".c" * n), (pb.WIDE[0], "a(at)b" + " (dot) c" * n))
    for pattern, text in runs:
        m = spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher(text)
        assert m.find() and (m.start(), m.end()) == (0, len(text))
    docs = [(k, f"first 10.0.0.7 {text} é then {card(random.Random(k))}; x@y.org") for k, (_, text) in enumerate(runs) if k]
    got, _ = run(spark, docs)
    for k, text in docs:
        assert [(s["start"], s["kind"], s["end"]) for s in got[k]["base"]] == [b[:3] for b in brute(text)]


def test_candidates_are_rows(spark):
    """Texts dense with candidates, read back as arrays by 4096 texts at a time, overran an executor's memory."""
    dense = "10.0.0.7 " * 300
    df = spark.createDataFrame([(1, dense), (2, "none"), (None, "a@b.co"), (4, None)], "doc_id long, text string")
    found = pb.candidates(df)
    assert not any(t.startswith("array") for _, t in found.dtypes)
    rows = found.select("doc_id", "first", "kind", "wide", "start").collect()
    assert len(rows) == 600 + 3  # base and wide ones
    assert sorted((r["doc_id"] or 0, r["kind"] is None) for r in rows if r["first"]) == [(0, False), (1, False), (2, True), (4, True)]
    assert sorted(r["start"] for r in rows if r["kind"] == 1 and not r["wide"]) == list(range(0, 2700, 9))
