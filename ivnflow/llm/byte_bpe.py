"""Byte-level BPE encoding and decoding (operator 10): segment-tree merges.

Every match of the split pattern is encoded on its own. A segment tree over
the match's byte positions holds in each node the leftmost smallest pair
rank below it; the root names the next merge. A merge makes three point
updates (the merged position, its live left neighbour, and the position
that dies), each in logarithmic time. Matches of equal tree size are merged
side by side, one numpy row per match.

Each task keeps the ids of matches it has met, up to
``memo_words``; then the memory is emptied and built anew, which changes
the time and never the ids. Texts are worked through in slices of about
``SLICE_CHARS``, so memory does not follow a batch's size.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows return repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: Split pattern with Rust's White_Space set in place of Python's wider one.
_WS = r"\t-\r \x85\xa0  -     　"
SLICE_CHARS = 2_000_000
#: Trees of more leaves than this are merged one match at a time.
WIDE = 64
_NONE = 1 << 30


def split_pattern(pattern: str) -> str:
    """The tokenizer's pattern for the ``regex`` module."""
    return (pattern.replace(r"[^\s", f"[^{_WS}").replace(r"(?!\S)", f"(?![^{_WS}])")
            .replace(r"\s+", f"[{_WS}]+"))


class Ranks:
    """Rank table of a vocabulary file: bytes -> id, id -> bytes, and pair -> id."""

    def __init__(self, path: str):
        import numpy as np

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        size = max(self.rank.values()) + 1
        lengths = np.zeros(size, np.int64)
        for t, r in self.rank.items():
            lengths[r] = len(t)
        self.length = lengths
        self.start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = bytearray(int(lengths.sum()))
        for t, r in self.rank.items():
            flat[self.start[r]:self.start[r] + len(t)] = t
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def pair_rank(self, a, b):
        """Rank of joining ids a and b, elementwise; _NONE where they don't join."""
        import numpy as np

        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one match by a segment tree of (rank, position) packed in one integer."""
    n = len(piece)
    size = 1 << max(0, (n - 1).bit_length())
    tok = ranks.byte[list(piece)].tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    get, none = ranks.pairs.get, _NONE << 32

    def leaf(i):
        j = nxt[i]
        r = get(tok[i] << 20 | tok[j]) if j < n else None
        return none if r is None else r << 32 | i

    tree = [none] * (2 * size)
    for i in range(n):
        tree[size + i] = leaf(i)
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a <= b else b

    def put(i, value):
        p = size + i
        tree[p] = value
        p >>= 1
        while p:
            a, b = tree[2 * p], tree[2 * p + 1]
            tree[p] = a if a <= b else b
            p >>= 1

    while tree[1] < none:
        i = tree[1] & 0xFFFFFFFF
        j = nxt[i]
        tok[i] = tree[1] >> 32
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        put(j, none)
        put(i, leaf(i))
        if prv[i] >= 0:
            put(prv[i], leaf(prv[i]))
    out, i = [], 0
    while i < n:
        out.append(tok[i])
        i = nxt[i]
    return out


def merge_many(pieces: list[bytes], size: int, ranks: Ranks):
    """Ids of many matches of at most ``size`` bytes (a power of two): the same
    tree and updates as ``merge_one``, a row per match. Returns (ids, kept)."""
    import numpy as np

    m = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    pos = np.arange(size)
    alive = pos[None, :] < lengths[:, None]
    # arrays are kept flat; one spare column per row: its token -1 joins with nothing
    cols = size + 1
    tok = np.full((m, cols), -1, np.int64)
    tok[:, :size] = np.where(alive, ranks.byte[raw], -1)
    nxt = np.tile(np.arange(1, cols + 1), m)
    prv = np.tile(np.arange(-1, size), m)
    none = _NONE << 8
    tree = np.full((m, 2 * size), none, np.int64)
    rank0 = ranks.pair_rank(tok[:, :size], tok[:, 1:])
    tree[:, size:] = np.where(rank0 < _NONE, rank0 << 8 | pos, none)
    width = size
    while width > 1:
        tree[:, width // 2:width] = np.minimum(tree[:, width:2 * width:2], tree[:, width + 1:2 * width:2])
        width //= 2
    tok, tree = tok.ravel(), tree.ravel()
    levels = size.bit_length() - 1

    def put(rows, at, value):
        base, p = rows * (2 * size), at + size
        tree[base + p] = value
        for _ in range(levels):
            p >>= 1
            left = base + 2 * p
            tree[base + p] = np.minimum(tree[left], tree[left + 1])

    def leaf(rows, at):
        here = rows * cols
        after = np.minimum(nxt[here + at], size)
        r = ranks.pair_rank(tok[here + at], tok[here + after])
        return np.where(r < _NONE, r << 8 | at, none)

    rows = np.arange(m)
    while True:
        top = tree[rows * (2 * size) + 1]
        go = top < none
        rows, top = rows[go], top[go]
        if not rows.size:
            break
        i = top & 0xFF
        here = rows * cols
        j = nxt[here + i]
        tok[here + i] = top >> 8
        far = nxt[here + j]
        nxt[here + i] = far
        inside = far < size
        prv[here[inside] + far[inside]] = i[inside]
        tok[here + j] = -1
        put(rows, j, none)
        put(rows, i, leaf(rows, i))
        before = prv[here + i]
        has = before >= 0
        if has.any():
            put(rows[has], before[has], leaf(rows[has], before[has]))
    ids = tok.reshape(m, cols)[:, :size]
    return ids, ids >= 0


class Memo:
    """Ids of strings met so far: a code per string, ids by code in flat arrays."""

    def __init__(self):
        import numpy as np

        fresh = self.fresh = []

        class Codes(dict):
            def __missing__(self, key):
                code = self[key] = len(self)
                fresh.append(key)
                return code

        self.codes = Codes()
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def look(self, keys: list[str]):
        import numpy as np

        return np.fromiter(map(self.codes.__getitem__, keys), np.int64, len(keys))

    def add(self, ids, counts):
        """Ids of the fresh strings, in their order."""
        import numpy as np

        self.fresh.clear()
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids = np.concatenate([self.ids, ids])
        self.counts = np.concatenate([self.counts, counts])

    def gather(self, code):
        n = self.counts[code]
        return self.ids[ragged(self.starts[code], n)], n


class Encoder:
    """Encoder of whole texts with a bounded memory of matches.

    A text is first cut before each space that has no white space after it:
    no match spans such a cut, so a chunk (a space and what follows) always
    gives the same matches. Texts with a space before white space or at
    their end are matched whole.
    """

    def __init__(self, path: str, pattern: str, memo_words: int = 1_000_000):
        import regex

        self.ranks = Ranks(path)
        self.find = regex.compile(split_pattern(pattern)).findall
        self.uneven = regex.compile(f" (?:[{_WS}]|$)").search
        self.memo_words = memo_words
        self.clear()

    def clear(self):
        self.matches, self.chunks = Memo(), Memo()

    def learn(self):
        """Encode the matches met for the first time."""
        import numpy as np

        fresh = self.matches.fresh
        if not fresh:
            return
        pieces = [w.encode() for w in fresh]
        parts: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        rank = self.ranks.rank
        for k, p in enumerate(pieces):
            whole = rank.get(p)  # a match that is a token itself is not merged
            if whole is not None:
                parts[k] = [whole]
            elif len(p) > WIDE:
                parts[k] = merge_one(p, self.ranks)
            else:
                by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for size, at in by_size.items():
            for lo in range(0, len(at), 8192):
                some = at[lo:lo + 8192]
                ids, kept = merge_many([pieces[k] for k in some], size, self.ranks)
                flat, n = ids[kept].tolist(), kept.sum(axis=1).tolist()
                lo2 = 0
                for k, c in zip(some, n):
                    parts[k] = flat[lo2:lo2 + c]
                    lo2 += c
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.matches.add(np.fromiter((i for p in parts for i in p), np.int32, int(counts.sum())), counts)

    def match_ids(self, texts: list[str]):
        """(ids of all texts in one array, ids per text), by their matches."""
        import numpy as np

        codes = [self.matches.look(self.find(t)) for t in texts]
        sizes = [len(c) for c in codes]
        self.learn()
        ids, n = self.matches.gather(np.concatenate([*codes, np.zeros(0, np.int64)]))
        edges = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes])]
        return ids, np.diff(edges)

    def chunk_ids(self, words: list[str]):
        """(ids of all chunks, ids per chunk): one search over the chunks in a
        row, as no match spans two of them."""
        import numpy as np

        found = self.find(" " + " ".join(words))
        code = self.matches.look(found)
        self.learn()
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        edges = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        ids, n = self.matches.gather(code)
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(total[np.concatenate([[0], np.searchsorted(ends, edges) + 1])])

    def encode(self, texts: list[str]):
        """(ids of all texts in one array, ids per text)."""
        import numpy as np

        if len(self.matches.codes) + len(self.chunks.codes) > self.memo_words:
            self.clear()
        parts, heads = [], []
        for t in texts:
            if self.uneven(t):
                heads.append(t)
                parts.append(None)
            else:
                first, *rest = t.split(" ")
                heads.append(first)
                parts.append(self.chunks.look(rest))
        if self.chunks.fresh:
            self.chunks.add(*self.chunk_ids(self.chunks.fresh))
        head_ids, head_n = self.match_ids(heads)
        ids, n = self.chunks.gather(np.concatenate([*(p for p in parts if p is not None), np.zeros(0, np.int64)]))
        sizes = np.array([0 if p is None else len(p) for p in parts], np.int64)
        tail_n = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])])
        per = head_n + tail_n
        out = np.empty(int(per.sum()), np.int32)
        at = np.cumsum(per) - per
        out[ragged(at, head_n)] = head_ids
        out[ragged(at + head_n, tail_n)] = ids
        return out, per

    def decode(self, ids):
        """(bytes of all ids in one array, bytes per id)."""
        n = self.ranks.length[ids]
        return self.ranks.flat[ragged(self.ranks.start[ids], n)], n


def ragged(start, count):
    """Indices start[k] .. start[k] + count[k] - 1 of every k, one after another."""
    import numpy as np

    total = int(count.sum())
    shift = start - (np.cumsum(count) - count)
    return np.repeat(shift, count) + np.arange(total)


def text_slices(column, chars: int = SLICE_CHARS):
    """Slices of an Arrow text column as lists of str, of about ``chars`` each."""
    out, size = [], 0
    for v in column:
        t = v.as_py() or ""
        out.append(t)
        size += len(t)
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", memo_words: int = 1_000_000) -> DataFrame:
    """doc_id, ids array<int>, decoded binary per row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = None
        for b in batches:
            enc = enc or Encoder(rank_file, pattern, memo_words)
            at = 0
            for texts in text_slices(b.column(1)):
                ids, per = enc.encode(texts)
                data, lengths = enc.decode(ids)
                edges = np.concatenate([[0], np.cumsum(per)])
                byte_edges = np.concatenate([[0], np.cumsum(lengths)])[edges]
                out_ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                out_bytes = pa.Array.from_buffers(
                    pa.binary(), len(texts),
                    [None, pa.py_buffer(byte_edges.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), out_ids, out_bytes],
                                                 names=["doc_id", "ids", "decoded"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
            .mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
