"""Operators 11 and 12 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ivnflow.llm import conversation_repair as cr
from ivnflow.llm import importance_resampling as ir

CONV = "conv_id long, turn long, role string, text string, audit string, pos int"


def brute_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def brute_audit(rows):
    """Forward search over whole audits: the least (cost, letters) per state."""
    def order(r):
        return (r[1] is not None, r[1] or 0, r[2],
                hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())

    rows = sorted(rows, key=order)
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def insert(best):
        for _ in range(3):
            new = dict(best)
            for s, (c, w) in best.items():
                for r in "ua":
                    q = after[s].get(r)
                    if q and (c + 5, w + "I") < new.get(q, (1 << 60, "")):
                        new[q] = (c + 5, w + "I")
            best = new
        return best

    for (_, _, role, _), fault in zip(rows, faults):
        new = {}
        for s, (c, w) in insert(best).items():
            options = [(s, 2, "D")]
            if fault not in ("blank", "duplicate"):
                add = 5 if fault else 0
                if role[:1] in after[s]:
                    options.append((after[s][role[:1]], add, "K"))
                options += [(after[s][r], 1 + add, "R") for r in "ua" if r in after[s]]
            for q, d, letter in options:
                if (c + d, w + letter) < new.get(q, (1 << 60, "")):
                    new[q] = (c + d, w + letter)
        best = new
    cost, audit = min(v for q, v in insert(best).items() if q in ("", "a"))
    out, k, last = [], 0, ""
    for letter in audit:
        role = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append(f"{role}:")
        else:
            _, _, own, text = rows[k]
            k += 1
            if letter == "D":
                continue
            role = own if letter == "K" else role
            out.append(f"{role}:{text}")
        last = role[0]
    turns = [r[1] for r in rows if r[1] is not None]
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{n: faults.count(n) for n in ("blank", "duplicate", "truncated")},
            "illegal": sum((a[2][:1], b[2][:1]) not in legal for a, b in zip(rows, rows[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def check_repair(spark, rows, conversations=None, **how):
    conversations = rows if conversations is None else conversations
    df = spark.createDataFrame([(*r, "x", 1) for r in conversations], CONV)
    mine = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV)
    got = {r["conv_id"]: r.asDict() for r in cr.audit_table(df, mine, **how).collect()}
    for conv in {r[0] for r in conversations}:
        want = brute_audit([r for r in rows if r[0] == conv])
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == want, conv
    assert len(got) == len({r[0] for r in conversations})


def random_rows(seed, convs=30, most=14):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "And so", " ", "", "Why?", "a.\n", "done. "] + [f"t{k}{e}" for k in range(12) for e in (".", "")]
    return [(c if c else None, r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), r.choice(texts))
            for c in range(convs) for _ in range(r.randint(1, most))]


@pytest.mark.parametrize("how", [{}, {"chunk_bits": 2}, {"chunk_bits": 2, "fix_ups": 0}, {"chunk_bits": 1, "fix_ups": 50}])
def test_repair_equals_brute_force(spark, how):
    check_repair(spark, random_rows(3), **how)


def test_one_long_conversation_in_many_chunks(spark):
    r = random.Random(5)
    rows = [(7, k, r.choice(["user", "assistant", "system"]), f"text {r.randint(0, 300)}" + r.choice([".", "", "!"])) for k in range(700)]
    # a stretch where deletion is always cheapest never converges by itself
    rows += [(7, 700 + k, "user", f"cut {k}") for k in range(200)] + [(7, 950, "assistant", "end.")]
    check_repair(spark, rows, chunk_bits=4)


def test_repair_of_lost_and_repeated_conversations(spark):
    rows = [(1, 0, "user", "Hi.")] * 5 + [(1, 1, "assistant", "x" * 300_000 + ".")]
    check_repair(spark, rows, rows + [(2, 0, "user", "gone"), (None, None, None, None)])


def test_damage(spark):
    rows = [(r[0], r[1], r[2] or None, r[3] or None) for r in random_rows(9, convs=60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV)
    got = [tuple(r) for r in cr.damaged(df).collect()]
    assert Counter(got) == Counter(brute_damage(rows))


def test_repair_of_empty_table(spark):
    df = spark.createDataFrame([], CONV)
    assert cr.audit_table(df, cr.damaged(df)).collect() == []


def brute_resample(docs, target, percent, min_words, run, buckets, seed):
    def features(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    sa, ta = sum(s.values()), sum(t.values())
    rows = []
    for k, (i, text) in enumerate(docs):
        f, n = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (sa + buckets) / ((s[b] + 1.0) * (ta + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[2] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = k + 1
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("how", [{}, {"longest_run": 3, "digit_bits": 3, "block_rows": 4, "percent": 60}])
@pytest.mark.parametrize("wide", [False, True])
def test_resampling_equals_brute_force(spark, how, wide):
    r = random.Random(1)
    vocab = ["the", "Über", "naïve", "x9", "日本", "and", "ÀÉ", "of", "a-b", "c_d", "Z"]
    step = 1 << 59 if wide else 1
    docs = [((k - 8) * step, " ".join(r.choices(vocab, k=r.randint(0, 60)))) for k in range(16)] * 3
    docs += [(5, None), (6, ""), (None, "the of and " * 20), (3, "long text " * 50_000)]
    target = ["The of and", "x9 of", None, ""]
    df = spark.createDataFrame([(i, t, "x", 1, 2, 0) for i, t in docs], "doc_id long, text string, rank string, row int, at int, score int")
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(x) for x in ir.resample(df, tf, **how).collect())
    args = {"percent": 10, "min_words": 20, "longest_run": 1, **how}
    assert got == brute_resample(docs, target, args["percent"], args["min_words"], args["longest_run"], ir.BUCKETS, 2024)


def test_radix_ranks_are_a_sort(spark):
    r = random.Random(2)
    rows = [(k, r.randint(-900, 900), r.randint(0, 40)) for k in range(2000)]
    df = spark.createDataFrame(rows, "row long, score long, doc_id long")
    got = {x["row"]: x["at"] for x in ir.radix_ranks(df, digit_bits=4, block_rows=64).collect()}
    want = sorted(rows, key=lambda x: (-x[1], x[2], x[0]))
    assert [got[x[0]] for x in want] == list(range(len(rows)))


def test_resampling_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 40)], "doc_id long, text string")
    assert ir.resample(df, some).collect() == []
    assert [tuple(x) for x in ir.resample(some, df).select("doc_id", "rank").collect()] == [(1, None)]
