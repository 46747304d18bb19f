"""Training-data operators against brute force on small and awkward inputs."""

import hashlib
import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "word", "en", "b"),
    (5, "A b c d e f g h i j " * 30, "en", "a"), (5, "A b c d e f g h i j " * 30, "en", "a"),
    (6, "x" * 70_000, "xx", "c"), (7, "token = \"abcd1234EFGH5678\" and AKIAABCDEFGHIJKL12 " + "0123456789abcdef" * 3, "en", "b"),
    (None, "no id here, but text", "de", "b"), (8, "ünï \U0001F600 code points\nsame line\nsame line", "fr", "c"),
    (9, "password: password: hunter2hunter2 secret=ab", "en", "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), 7) for i, t, lang, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rule_counts(t):
    w = words(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_rules(edge, empty):
    from ivnflow.llm.host_rules import keep_good, quality_rules
    rows = quality_rules(edge).collect()
    assert len(rows) == len(EDGE) and quality_rules(empty).count() == 0
    texts = dict((i, t) for i, t, _, _ in EDGE)
    for r in rows:
        want = rule_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert keep_good(edge).columns == edge.columns and keep_good(empty).count() == 0


def test_host_prior(spark):
    from ivnflow.llm.host_rules import host_rates
    base = spark.createDataFrame([("bad", True)] * 40 + [("good", False)] * 60 + [("one", True)], "host string, base_failed boolean")
    got = {r["host"]: r for r in host_rates(base).collect()}
    assert got["bad"]["host_rejected"] and not got["good"]["host_rejected"]
    assert got["one"]["host_rate"] < got["bad"]["host_rate"]  # one row is little evidence


def test_bad_host_decides(spark, sample, tmp_path):
    """A planted host of boilerplate takes its one good document with it; the query's rows equal the SQL's."""
    import duckdb

    from ivnflow.llm.host_rules import OP1_SQL, keep_good, op1_host_rules
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(900_000 + k, "# $ % | " * 20 + f"{good} {k}", "en", "symbols.example", 0) for k in range(60)]
    rows += [(900_100, good, "en", "symbols.example", 0), (900_101, good + " x", "en", "small.example", 0),
             (900_102, "< > | $ # " * 10 + good, "en", "small.example", 0), (900_103, good + " y", "en", None, 0)]
    planted = spark.createDataFrame(rows, sample.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = sample.select(*planted.columns).unionByName(planted)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = op1_host_rules(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}
    assert not got[900_100]["kept"] and not got[900_100]["base_failed"] and got[900_100]["host_rejected"]
    assert all(got[k]["kept"] for k in (900_101, 900_102, 900_103))
    assert all(r["kept"] != r["base_failed"] for k, r in got.items() if k < 900_000)
    kept = sorted(r["doc_id"] for r in keep_good(docs).select("doc_id").collect())
    assert kept == sorted(k for k, r in got.items() if r["kept"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cols = sorted(out.columns)
    want = con.execute(f"select {', '.join(cols)} from ({OP1_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in cols)) for r in got.values())


def brute_spans(t):
    t = t or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secret_spans(spark, edge, empty):
    from ivnflow.llm.secret_ownership import COPIED, LIVE, redact, secret_spans
    texts = dict((i, t) for i, t, _, _ in EDGE)
    for r in secret_spans(edge).collect():
        assert [tuple(s) for s in r["base"]] == brute_spans(texts[r["doc_id"]])
    assert secret_spans(empty).count() == 0 and redact(empty).count() == 0
    key, own = "Zq8rT5wLp2Xn7VbK", "Mk4sD9fGh1JyU6oP"
    many = spark.createDataFrame(
        [(i, f"token = {key} end", "en", f"s{i}", 30) for i in range(5)] + [(9, f"say secret={own}!", "en", "s1", 30)],
        "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in secret_spans(many).collect()}
    assert got == {**{i: [COPIED] for i in range(5)}, 9: [LIVE]}
    clean = {r["doc_id"]: r["text"] for r in redact(many).collect()}
    assert clean[9] == "say secret=[SECRET]!" and clean[0] == "token = [EXAMPLE] end"


def test_syncmers(edge, empty):
    from ivnflow.llm.syncmers import edited_text, with_next
    from pyspark.sql import functions as F
    assert with_next(empty).count() == 0
    got = with_next(edge).withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).collect()
    order = sorted(EDGE, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t, _, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        want.append((i, t, t[:len(t) - third] + nxt[:third]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["text"], r["edited"]) for r in got), key=key) == sorted(want, key=key)
    same = [r["hashes"] for r in got if r["doc_id"] == 5]
    assert same[0] == same[1]


def test_syncmer_choice(spark):
    from ivnflow.llm.syncmers import K, S, anchors, positional_matches
    from pyspark.sql import functions as F
    text = " ".join(f"w{i * 37 % 101}" for i in range(120))
    r = spark.createDataFrame([(text, "new words first " + text)], "a string, b string").select(
        anchors(F.col("a")).alias("x"), positional_matches(anchors(F.col("a")), anchors(F.col("b"))).alias("m"),
        F.transform(F.split("a", " "), lambda w: F.xxhash64(w)).alias("h")).first()
    pairs = [spark.range(1).select(F.xxhash64(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0] for a, b in zip(r["h"], r["h"][1:])]
    inner = K - S + 1
    want = [i for i in range(len(r["h"]) - K + 1) if min(pairs[i:i + inner]) in (pairs[i], pairs[i + inner - 1])]
    assert [x["pos"] for x in r["x"]] == want
    assert {m["pos_b"] - m["pos_a"] for m in r["m"]} >= {3}


def test_simhash(spark, edge, empty):
    from ivnflow.llm.simhash_bktree import BKTree, near_duplicates, one_of_each, shard_forest
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0
    base = "one two three four five six seven eight nine ten " * 8
    docs = spark.createDataFrame(
        [(i + 100, base + ("" if i % 3 else f"tail{i % 2}"), "en", "s", 1) for i in range(30)] + [(99, "quite another text about nothing at all", "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long").union(edge.drop("n_words"))
    rows = near_duplicates(docs, shard_limit=2).collect()
    fps = [int(r["fingerprint"], 16) for r in rows]
    label = [r["doc_id"] if r["doc_id"] is not None else 1 << 40 for r in rows]
    while True:
        new = [min(label[j] for j, g in enumerate(fps) if (f ^ g).bit_count() <= 2) for f in fps]
        if new == label:
            break
        label = new
    assert [r["component_id"] if r["component_id"] is not None else 1 << 40 for r in rows] == label
    assert one_of_each(docs).count() == len(set(label))
    tree = BKTree()
    keys = [(i * 0x9E3779B97F4A7C15) & 0xFF for i in range(200)]
    for k in keys:
        tree.add(k)
    for q in range(256):
        assert sorted(tree.search(q, 2)) == [i for i, k in enumerate(keys) if (k ^ q).bit_count() <= 2]
    assert len(shard_forest([0, 1, 3, 255], 2)) == 2


def test_language(spark, sample, edge, empty):
    from ivnflow.llm.language_evidence import declared_of, host_of, identify, keep_identified
    from pyspark.sql import functions as F
    train, test = sample.where("doc_id % 2 = 0"), sample.where("doc_id % 2 = 1")
    out = identify(test, labelled=train).join(test.select("doc_id", "lang"), "doc_id")
    assert out.where("language = lang").count() >= 0.98 * out.count()  # held out
    short = spark.createDataFrame([(1, "de la", "en", "http://x.example.fr/a")], "doc_id long, text string, lang string, url string")
    got = identify(short, labelled=train, declared=F.col("lang"), host=host_of(F.col("url"))).first()
    assert got["declared"] == "en" and got["host"] == "x.example.fr"
    assert identify(empty).count() == 0
    kept = {r["doc_id"] for r in keep_identified(edge).collect()}
    assert 2 not in kept and 3 not in kept and keep_identified(edge).columns == edge.columns
    page = spark.createDataFrame([('<!DOCTYPE html><html class="x" lang="de-AT">',)], "html string")
    assert page.select(declared_of(F.col("html"))).first()[0] == "de"


def test_language_rejects_foreign(spark, sample):
    import random

    from ivnflow.llm.language_evidence import identify
    rng = random.Random(1)
    texts = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。" * 2,
        "x" * 300, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))]
    foreign = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = identify(foreign, labelled=sample).collect()
    assert len(rows) == len(texts) and not any(r["kept"] for r in rows), rows
    assert {r["language"] for r in rows} == {None}
    # a language that labels rows is one of the classes
    russian = spark.createDataFrame([(9000 + i, texts[0] * (i + 1), "ru", "s", 1) for i in range(9)], sample.schema)
    got = identify(foreign.where("doc_id = 0"), labelled=sample.union(russian)).first()
    assert got["language"] == "ru" and got["kept"]
    assert identify(sample).where("kept").count() >= 0.95 * sample.count()


def test_sharding(spark, edge, empty, tmp_path):
    from ivnflow.llm.slot_sharding import load_map, rebalance, shard_by_bytes, store_map
    assert shard_by_bytes(empty, str(tmp_path / "e")).count() == 0
    rows = shard_by_bytes(edge, str(tmp_path / "m"), shards=3, slots=64).collect()
    assert len(rows) == len(EDGE)
    for s in range(3):
        assert sorted(r["place"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((t or "").encode()) for _, t, _, _ in EDGE}
    sizes = [(i * 7919) % 1000 for i in range(512)]
    even = rebalance([i % 8 for i in range(512)], sizes, 8)
    loads = [sum(s for s, a in zip(sizes, even) if a == k) for k in range(8)]
    assert max(loads) - min(loads) <= 2
    store_map(spark, str(tmp_path / "v"), even, 4)
    assert [r["shard"] for r in load_map(spark, str(tmp_path / "v"), 4).orderBy("vslot").collect()] == even


@pytest.mark.parametrize("which", ["edge", "sample"])
def test_packing(request, which):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from ivnflow.llm.common import materialise
    from ivnflow.llm.nnls_packing import pack, sequence_ids, tokenise
    docs = request.getfixturevalue(which)
    docs = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    tokens = materialise(tokenise(docs, P.path("word_bpe_49k.json"), keep_ids=True), "test-tokens")
    pieces = pack(tokens)
    rows = pieces.collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    for d, ids in want.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]):
            part = np.array(ids[at:at + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    seqs = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert seqs.get(r["sequence_id"], 0) == r["offset"]
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in seqs.values())  # no padding at all
    built = sequence_ids(tokens, pieces).collect()
    assert sum(len(r["ids"]) for r in built) == sum(map(len, want.values()))


def test_packing_empty(empty):
    import public_tokenizers as P

    from ivnflow.llm.nnls_packing import pack_documents
    assert pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_event_is_an_edit(spark, sf):
    from ivnflow.llm.url_lists import event_edits
    pages, events = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("pages", "events"))
    edits = event_edits(pages, events)
    assert edits.count() == events.count() == edits.select("edit_id").distinct().count()
    assert event_edits(pages.limit(0), events).count() == 0


def test_url_lists(spark):
    from ivnflow.llm.url_lists import filter_urls
    urls = ["http://a.bad.org/x", "https://u:p@BAD.org:80/", "http://ok.net", None, "nonsense", "http://sub.ok.net/q?z=http://bad.org/"]
    caps = spark.createDataFrame([(i, u, t, "extra") for i, u in enumerate(urls) for t in (5, 10, 15, 20, 99, None)] * 2,
                                 "page_id long, url string, fetched_at long, pattern string")
    log = [("block", "bad.org", 10, 1, "add"), ("block", "bad.org", 20, 2, "remove"), ("allow", "a.bad.org", 15, 3, "add"),
           ("block", "ok.net", 15, 4, "add"), ("allow", "ok.net", 15, 5, "add"), ("block", "ok.net", 20, 6, "add"), (None, "x", 1, 7, "add")]
    edits = spark.createDataFrame(log, "list string, pattern string, at long, edit_id long, action string")

    def verdict(host, t):
        for p in [".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)] if host and t is not None else []:
            for which in ("allow", "block"):
                past = [e for e in log if e[0] == which and e[1] == p and e[2] <= t]
                if past and max(past, key=lambda e: (e[2], e[3]))[4] == "add":
                    return which
        return "none"

    hosts = ["a.bad.org", "bad.org", "ok.net", None, None, "sub.ok.net"]
    for chunk in (1, 7, 1000):
        rows = filter_urls(caps, edits, chunk=chunk).collect()
        assert len(rows) == caps.count()
        for r in rows:
            assert r["verdict"] == verdict(hosts[r["page_id"]], r["fetched_at"]), r
    assert {r["verdict"] for r in filter_urls(caps, edits.where("false")).collect()} == {"none"}
    assert filter_urls(caps.where("false"), edits).count() == 0


def test_byte_bpe(edge, empty):
    import base64

    import public_tokenizers as P
    import tiktoken

    from ivnflow.llm.byte_bpe import Encoder, encode_documents
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in encode_documents(edge, path, P.PATTERN).join(edge.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["ids"] == ref.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert encode_documents(empty, path, P.PATTERN).count() == 0
    odd = ["", " ", "a  b", "a \n b", "\x1c x\x1d", "ab" * 700, "don't I'll we've 12345", "日本語テキスト" * 9, "x ", "　y  z"]
    enc = Encoder(path, P.PATTERN, memo_words=3)
    for _ in range(2):
        ids, per = enc.encode(odd)
        at = 0
        for t, n in zip(odd, per.tolist()):
            assert ids[at:at + n].tolist() == ref.encode_ordinary(t), t
            at += n


def test_extraction(spark):
    from ivnflow.llm.composite_density import extract_pages, main_text
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><a href=x>Home</a></nav><div id="content"><div class="post"><h1>Title &amp; more</h1><p>First paragraph with <a href="q">a link</a> and
 text that goes on.<p>Ok.</p><div class="share-buttons"><a>tw</a></div><ul><li>One item of the list<li>Two</ul></div>
<div class="sidebar"><p>Side text that looks like a paragraph of text.</p></div><section id="comments"><p>Reader: nice words here.</p></section></div>
<div class="cookie-notice">We use cookies</div><form><p>Sign up</p></form><footer>&copy; me</footer></body></html>"""
    want = "Title & more\nFirst paragraph with a link and text that goes on.\nOk.\nOne item of the list\nTwo"
    assert main_text(page) == want
    assert main_text(None) == main_text("") == main_text("<body><nav>x</nav>") == ""
    assert main_text("<article><p>cut of") == "cut of" and main_text("<article><p>a</p><p>b <a hre") == "a\nb"
    docs = spark.createDataFrame([(1, None, None, "t"), (2, "u", page, "t"), (2, "u", page, "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in extract_pages(docs).collect()) == ["", want, want]
    assert extract_pages(docs.where("false")).count() == 0


def test_extraction_keeps_pages():
    from ivnflow.llm.composite_density import main_text
    text = "<p>First paragraph of the page, long enough.</p><p>Second one, which goes on.</p>"
    want = "First paragraph of the page, long enough.\nSecond one, which goes on."
    for page in (
            f"<html><head><title>T</title><meta charset=utf-8><body><nav>x</nav><article>{text}</article></body>",
            f"<html><head><title>T</title><article>{text}</article>",
            f"<body><form action=x><nav>x</nav><article>{text}</article></form></body>",
            f"<body><form action=x><div>{text}<button>Go</button></div></form></body>",
            f"<body><article><form>{text}</form></article><nav>x</nav></body>",
            f"<body><aside><main>{text}</main></aside></body>",
            f"<body><div class='sidebar'><article>{text}</article></div><p>Short.</p></body>",
            *(f"<body><div class='{c}'>{text}</div></body>" for c in (
                "layout has-sidebar", "no-sidebar", "page-with-comments", "elementor-widget", "promo")),
            *(f"<body><div id='{c}'><article>{text}</article><div class='post-comments'>Nice.</div></div></body>" for c in (
                "has-sidebar", "elementor-widget elementor-widget-text"))):
        assert main_text(page) == want, page
    main = f"<article>{text}</article>"
    for noise in ("<aside><article>A teaser, longer than all of the page's own text taken together, with plenty of words.</article></aside>",
                  "<section id=comments><article>A comment</article></section>", "<form>Sign up</form>", "<div class=site-footer>Foot</div>"):
        assert main_text(f"<body>{main}{noise}</body>") == want, noise
    assert main_text("<body><div hidden><article>x y</article></div></body>") == "" == main_text("<body><nav>x</nav></body>")


def test_extraction_by_density(spark):
    """Without article or main tags the density rule alone finds the same text on every given page."""
    from ivnflow.llm.composite_density import main_text
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        want = main_text(r["html"])
        plain = r["html"].replace("<article", "<div").replace("</article", "</div")
        assert want and main_text(plain) == want
    long = "A paragraph of the page itself that goes on for a good while, as paragraphs do, with many words in it. " * 3
    body = f"<div><h1>Head</h1><p>{long}</p><p>Short.</p><p>{long}</p></div>"
    want = f"Head\n{long.strip()}\nShort.\n{long.strip()}"
    links = "".join(f"<li><a href=/{k}>More {k}</a></li>" for k in range(9))
    assert main_text(f"<body><div>Hint of the day</div>{body}<div><ul>{links}</ul></div></body>") == want
    # several articles: the densest one; short text outside is not taken
    two = f"<article><p>Teaser of another.</p></article><p>{long}</p><article>{body}</article>"
    assert main_text(f"<body>{two}</body>") == want
    deep = "<div>" * 3000 + f"<p>{long}</p>" + "</div>" * 3000
    assert main_text(deep) == long.strip() and main_text(f"<p>{'x' * 500_000}</p>") == "x" * 500_000


def test_pipeline(spark, edge, empty, sample):
    import corpus_pipeline
    for first in (edge.drop("n_words"), empty.drop("n_words"), sample):
        docs = first
        for name, stage in corpus_pipeline.STAGES[:-1]:
            n = docs.count()
            docs = stage(spark, docs, SF)
            assert docs.columns == first.columns and docs.count() <= n, name
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns) >= {"doc_id", "sequence_id", "offset", "length"}


def test_oracles(spark):
    import duckdb

    from ivnflow.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        key = lambda rows: sorted(map(repr, rows))
        want = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert key(tuple(r) for r in df.select(*cols).collect()) == key(want), name
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
