"""Packing (operator 8): non-negative least squares over length combinations.

Every document is cut into whole windows and one tail. The histogram of tail
lengths (at most window - 1 numbers, whatever the corpus) goes to the
driver, which enumerates combinations of two and three lengths that fill a
window, solves how often to repeat each by non-negative least squares,
rounds to counts the histogram can pay for and packs what is left greedily:
once more by exact combinations, then by cutting the residual tails into
powers of two, laid end to end from the largest. Sequences never need
padding: they hold a whole window, or a power of two of the last residue.

The plan is a row per length (rank ranges -> sequences), joined back by
length; a tail finds its place by its rank among tails of its length. Ranks
are taken per (length, salt) with prefix sums over the salts, so one length
shared by a third of all documents is not sorted in one task.

Defined results: null and empty texts have no ids of their own, only the
closing id; repeated rows are packed one by one; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import Memo, text_slices
from .common import materialise, ship, shuffle_width, table

#: Every other length in a combination of three is free; the first is a multiple of this.
TRIPLE_STEP = 64

#: Pieces a worker remembers before it starts anew, about 250 bytes each.
MEMO_WORDS = 800_000


class WordTokenizer:
    """A ``tokenizers`` file applied to white-space-separated pieces, which its
    rules never join, with a bounded memory of pieces."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = tokenizer.encode_batch_fast
        # special tokens are matched before folding; texts that may hold one keep their case
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.lower = tokenizer.normalizer is not None and "lowercase" in str(tokenizer.normalizer).lower() \
            and all("|>" in t for t in special)
        # a full stop or comma after a letter is a piece of its own where the rules part the two anyway
        ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.parts = ids("ab, cd.\nef.") == ids("ab , cd .\nef .")
        self.apart = re.compile(r"(?<=[a-z])([.,])(?=[ \n]|$)").sub
        self.memo_words = memo_words
        self.memo = Memo()

    def pieces(self, text: str) -> list[str]:
        text = self.folded(text)
        return (self.apart(r" \1", text) if self.parts else text).replace("\n", " ").split(" ")

    def folded(self, text: str) -> str:
        """The text in lower case where the tokenizer, which composes and then folds
        each character by itself, gives the same ids for it: more pieces are alike."""
        if not self.lower or "|>" in text or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return text
        return text.replace("\u03a3", "\u03c3").lower()

    def encode(self, texts: list[str]):
        """(ids of all texts in one array, ids per text)."""
        import numpy as np

        if len(self.memo.codes) > self.memo_words:
            self.memo = Memo()
        codes = [self.memo.look(self.pieces(t)) for t in texts]
        fresh = self.memo.fresh
        if fresh:
            parts = []
            for lo in range(0, len(fresh), 4096):
                parts += [e.ids for e in self.encode_batch(fresh[lo:lo + 4096], add_special_tokens=False)]
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            self.memo.add(np.fromiter((i for p in parts for i in p), np.int32, int(counts.sum())), counts)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        ids, n = self.memo.gather(np.concatenate([*codes, np.zeros(0, np.int64)]))
        edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(edges)


#: One tokenizer and memory per file in each Python worker, kept from task to task.
_KEPT: dict[tuple[str, int], WordTokenizer] = {}


def worker_tokenizer(path: str, memo_words: int) -> WordTokenizer:
    key = (path, memo_words)
    if key not in _KEPT:
        _KEPT[key] = WordTokenizer(*key)
    return _KEPT[key]


def powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int = 1, window: int = 2048,
             id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """doc_id, n, window_crc array, tail_crc, part_crc array (the tail cut into
    powers of two) and, with ``keep_ids``, the ids themselves. A CRC-32 is over
    the ids as little-endian 32-bit numbers."""
    ship(docs.sparkSession)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        from ivnflow.llm.nnls_packing import worker_tokenizer

        for b in batches:
            tok = worker_tokenizer(tokenizer_file, memo_words)
            at = 0
            for texts in text_slices(b.column(1)):
                ids, per = tok.encode(texts)
                ids = ids.astype("<u4")
                n, wins, tails, parts, kept, lo = [], [], [], [], [], 0
                for c in per.tolist():
                    own = np.append(ids[lo:lo + c], np.uint32(end_id)).astype("<u4")
                    lo += c
                    raw = memoryview(own.tobytes())
                    n.append(c + 1)
                    full = (c + 1) // window
                    wins.append([zlib.crc32(raw[4 * window * k:4 * window * (k + 1)]) for k in range(full)])
                    edge = 4 * window * full
                    tails.append(zlib.crc32(raw[edge:]))
                    some = []
                    for p in powers((c + 1) % window):
                        some.append(zlib.crc32(raw[edge:edge + 4 * p]))
                        edge += 4 * p
                    parts.append(some)
                    if keep_ids:
                        kept.append(own.astype(np.int32))
                longs = pa.list_(pa.int64())
                out = [b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(wins, longs),
                       pa.array(tails, pa.int64()), pa.array(parts, longs)]
                names = ["doc_id", "n", "window_crc", "tail_crc", "part_crc"]
                if keep_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"doc_id {kind}, n long, window_crc array<long>, tail_crc long, part_crc array<long>"
        + (", ids array<int>" if keep_ids else "")))


def combinations(window: int):
    """Combinations of two or three lengths that fill a window, as an array of
    rows (a, b, c) with c = 0 for two."""
    import numpy as np

    rows = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    seen = set()
    for a in range(TRIPLE_STEP, window - 1, TRIPLE_STEP):
        for b in range(1, (window - a) // 2 + 1):
            key = tuple(sorted((a, b, window - a - b)))
            if key not in seen:
                seen.add(key)
                rows.append(key)
    return np.array(rows, np.int64)


def solve_nnls(combos, histogram, rounds: int = 400):
    """Repeat counts x >= 0 with least ||A x - h||, by accelerated projected
    gradient; column k of A counts the lengths of combination k."""
    import numpy as np

    size = len(histogram)

    def forward(x):
        y = np.zeros(size)
        for k in range(3):
            y += np.bincount(combos[:, k], x, size)
        y[0] = 0
        return y

    def backward(y):
        return y[combos].sum(axis=1)

    h = histogram.astype(float)
    h[0] = 0
    v = np.ones(len(combos))
    for _ in range(30):
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * (v @ backward(forward(v))))
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        nx = np.maximum(z - step * backward(forward(z) - h), 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = nx + (t - 1) / nt * (nx - x)
        x, t = nx, nt
    return x


def packing_plan(histogram: dict[int, int], window: int = 2048) -> dict:
    """Plan for tails: ``ranges`` by length is a list of (first rank, end rank,
    first sequence, offset); ranks from ``covered`` on are cut into powers of
    two, where power p starts at position ``power_at[p]`` of the residual line
    and the length's own pieces from index ``power_first[length][p]`` on."""
    import numpy as np

    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    left[0] = 0
    combos = combinations(window)
    x = solve_nnls(combos, left)
    used = np.zeros(window + 1, np.int64)
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    seqs = 0
    order = np.argsort(-x, kind="stable")
    for greedy in (False, True):
        for k in order.tolist():
            want = None if greedy else int(x[k] + 0.5)
            if want == 0:
                break
            lens = [n for n in combos[k].tolist() if n]
            can = min(int(left[n]) // lens.count(n) for n in lens)
            take = can if greedy else min(want, can)
            if not take:
                continue
            offset = 0
            for n in lens:
                ranges.setdefault(n, []).append((int(used[n]), int(used[n]) + take, seqs, offset))
                used[n] += take
                left[n] -= take
                offset += n
            seqs += take
    by_power: dict[int, int] = {}
    power_first: dict[int, dict[int, int]] = {}
    for n in range(1, window):
        if left[n]:
            power_first[n] = {}
            for p in powers(n):
                power_first[n][p] = by_power.get(p, 0)
                by_power[p] = by_power.get(p, 0) + int(left[n])
    at, power_at = 0, {}
    for p in sorted(by_power, reverse=True):
        power_at[p] = at
        at += p * by_power[p]
    whole, rest = divmod(at, window)
    return {"ranges": ranges, "covered": {n: int(used[n]) for n in range(window) if used[n]},
            "power_first": power_first, "power_at": power_at, "combined": seqs, "whole": whole,
            "rest": powers(rest), "sequences": seqs + whole + len(powers(rest))}


def pack(tokens: DataFrame, window: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for the
    rows of ``tokenise`` (a stored table: it is read more than once)."""
    spark = tokens.sparkSession
    salts = shuffle_width(spark)
    t = tokens.select("doc_id", "n", "window_crc", "tail_crc", "part_crc",
                      (F.col("n") % window).cast("int").alias("tail"), (F.col("n") / window).cast("long").alias("full"),
                      F.pmod(F.xxhash64("doc_id", "n", "tail_crc"), F.lit(salts)).cast("int").alias("salt"))
    counts = materialise(t.groupBy("tail", "salt").agg(F.count("*").alias("c"), F.sum("full").alias("f")), "packing-counts")
    totals = {r["tail"]: (r["c"], r["f"]) for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).collect()}
    plan = packing_plan({n: c for n, (c, _) in totals.items() if n}, window)
    rows, base = [], plan["sequences"]
    bits = [1 << b for b in range(window.bit_length() - 2, -1, -1)]
    for n in sorted(totals):
        first = plan["power_first"].get(n, {})
        rows.append((n, base, plan["covered"].get(n, 0),
                     [{"end": e, "seq": s - a, "off": o} for a, e, s, o in plan["ranges"].get(n, [])],
                     [first.get(p, 0) for p in bits]))
        base += totals[n][1]
    # at most ``window`` rows of bounded arrays, whatever the corpus
    places = F.broadcast(spark.createDataFrame(
        rows, "tail int, full_at long, covered long, ranges array<struct<end:long,seq:long,off:int>>, firsts array<long>"))
    before = Window.partitionBy("tail").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tail", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rank_at"),
                           F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f_at"))
    own = Window.partitionBy("tail", "salt").orderBy("doc_id", "n", "tail_crc")
    ranked = (t.withColumn("k", F.row_number().over(own) - 1)
              .withColumn("f_before", F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .join(starts, ["tail", "salt"]).join(places, "tail")
              .withColumn("rank", F.col("k") + F.col("rank_at"))
              .withColumn("seq0", F.col("full_at") + F.col("f_at") + F.col("f_before")))
    piece = "named_struct('start', {0}, 'length', {1}, 'crc', {2}, 'seq', {3}, 'off', {4})"
    windows = "if(full > 0, transform(sequence(0L, full - 1), w -> " + piece.format(
        f"w * {window}L", f"{window}L", "window_crc[int(w)]", "seq0 + w", "0L") + "), array())"
    kept = ("transform(slice(filter(ranges, r -> r.end > rank), 1, 1), r -> " + piece.format(
        f"full * {window}L", "bigint(tail)", "tail_crc", "r.seq + rank", "bigint(r.off)") + ")")
    power_at = "array(" + ",".join(f"{plan['power_at'].get(p, 0)}L" for p in bits) + ")"
    edges = [0]
    for p in plan["rest"]:
        edges.append(edges[-1] + p)
    ends = "array(" + ",".join(f"{e}L" for e in edges[1:]) + ")" if plan["rest"] else "array(0L)"
    begins = "array(" + ",".join(f"{e}L" for e in edges) + ")"
    whole_at = plan["whole"] * window
    # a residual piece: its power, its place in the tail, its position in the line
    cut = (f"transform(filter(sequence(0, {len(bits) - 1}), b -> (tail & shiftright({bits[0]}, b)) > 0), (b, i) -> "
           f"named_struct('p', bigint(shiftright({bits[0]}, b)), 'i', i, 'high', bigint(tail) - bigint(tail % shiftright({2 * bits[0]}, b)), "
           f"'pos', element_at({power_at}, b + 1) + (firsts[b] + rank - covered) * bigint(shiftright({bits[0]}, b))))")
    seg = f"size(filter({ends}, e -> e <= c.pos - {whole_at}L))"
    parts = f"transform({cut}, c -> " + piece.format(
        f"full * {window}L + c.high", "c.p", "part_crc[c.i]",
        f"if(c.pos < {whole_at}L, {plan['combined']}L + c.pos div {window}L, {plan['combined'] + plan['whole']}L + {seg})",
        f"if(c.pos < {whole_at}L, c.pos % {window}L, c.pos - {whole_at}L - element_at({begins}, {seg} + 1))") + ")"
    tails = f"case when tail = 0 then array() when rank < covered then {kept} else {parts} end"
    return (ranked.select("doc_id", F.col("n").alias("doc_tokens"), F.expr(f"inline(concat({windows}, {tails}))"))
            .select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
                    F.col("seq").alias("sequence_id"), F.col("off").alias("offset")))


def sequence_ids(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed ids for rows of ``tokenise(keep_ids=True)``
    with distinct ids and their pieces; a sequence has at most one window."""
    cut = tokens.select("doc_id", "ids").join(pieces, "doc_id").select(
        "sequence_id", F.struct("offset", F.expr("slice(ids, int(start) + 1, int(length))").alias("part")).alias("p"))
    return cut.groupBy("sequence_id").agg(
        F.expr("flatten(transform(array_sort(collect_list(p)), x -> x.part))").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, window: int = 2048,
                   memo_words: int = MEMO_WORDS) -> DataFrame:
    """Pieces of all documents; texts are tokenised once. ``memo_words`` bounds a worker's memory
    and changes the time only."""
    return pack(materialise(tokenise(docs, tokenizer_file, end_id, window, memo_words=memo_words), "packing-tokens"), window)


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
