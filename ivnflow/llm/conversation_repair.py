"""Conversation structure repair (operator 11): rank-convergence parallel Viterbi.

Every row of a conversation is kept (K), given another role (R), deleted (D),
or has empty rows inserted before it (I), so that the role initials read
``(s?(ua)+)?`` at least cost. The dynamic program has four states (nothing
yet, ``s``, after ``u``, after ``a``) and is run backwards: a vector of four
costs to the end, of which only the differences matter.

Rows are numbered by one range sort over all conversations and cut into
chunks of ``2**chunk_bits`` numbers, so a conversation with a third of all
rows is many chunks, each a short array of codes. All chunks run at once from
a speculative vector. Fix-up passes rerun a chunk from its right neighbour's
vector until every vector differs from the one that was used only by a
constant. Some rows (those whose deletion is always cheapest) never make
vectors converge; after ``FIX_UPS`` passes the chunks that still wait give
their costs from each single state to each other, and one streamed sweep over
these 4 x 4 tables, a row per chunk, gives the exact vectors. The stitched
vectors then drive the trace of the ASCII-least audit: a letter is taken if
it still leads to the least cost; the state at a chunk's start comes from the
same kind of sweep over the chunks' four exits.

Texts are shuffled once, to lay the repaired rows out in order; codes, hashes
and vectors are what all other steps move. A conversation's SHA-256 is
sequential by nature: its rows stream through one task in constant memory.

Defined results: null ids are one conversation; null turns come first; rows
of equal turn are ordered by role and then by the text's hash; null role and
text are one space; an empty role has no initial and is never legal; repeated
rows are duplicates; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, ship, table

CHUNK_BITS = 16
#: Passes before chunks whose vectors don't converge are settled by their 4 x 4 tables.
FIX_UPS = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Costs to the end after the last row, inserts included, by state: nothing yet, s, after u, after a.
END = (0, 2 * INSERT, INSERT, 0)
#: State after an inserted or rerolled row.
NEXT = (2, 2, 3, 2)
_BIG = 1 << 40
_MARK = 16


class Viterbi:
    """Backward steps and trace steps over normalised cost vectors. Their
    differences are bounded by a few inserts, so there are few and both steps are
    remembered. A code is an initial (0 s, 1 u, 2 a, 3 other) plus four times a
    fault (0 none, 1 truncated, 2 duplicate, 3 blank)."""

    def __init__(self):
        self.backs: dict = {}
        self.acts: dict = {}

    @staticmethod
    def moves(code: int, state: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of consuming a row, in ASCII order."""
        initial, fault = code & 3, code >> 2
        out = [("D", DELETE, state)]
        if fault < 2:
            late = TRUNCATED if fault else 0
            if initial == 0 and state == 0:
                out.append(("K", KEEP + late, 1))
            if initial == 1 and state != 2 or initial == 2 and state == 2:
                out.append(("K", KEEP + late, NEXT[state]))
            out.append(("R", REROLE + late, NEXT[state]))
        return out

    def back(self, right: tuple, code: int) -> tuple:
        """(vector before a row, its minimum taken off) from the vector after it."""
        key = (right, code)
        got = self.backs.get(key)
        if got is None:
            v = [min(c + right[q] for _, c, q in self.moves(code, s)) for s in range(4)]
            v = self.insert(self.insert(v))
            low = min(v)
            # states that cannot reach the wanted one stay out of reach
            got = self.backs[key] = (tuple(x - low if x < _BIG // 2 else _BIG for x in v), low)
        return got

    @staticmethod
    def insert(v: list) -> list:
        return [min(v[s], INSERT + v[NEXT[s]]) for s in range(4)]

    def act(self, left: tuple, low: int, right: tuple, code: int, state: int) -> tuple:
        """(letters, state after the row, cost) from ``state`` before it."""
        key = (right, code, state)
        got = self.acts.get(key)
        if got is None:
            letters, cost, s = "", 0, state
            while True:
                best = left[s] + low
                choices = [(a, c, q) for a, c, q in self.moves(code, s) if c + right[q] == best]
                if INSERT + left[NEXT[s]] + low == best and (not choices or choices[0][0] > "I"):
                    letters, cost, s = letters + "I", cost + INSERT, NEXT[s]
                    continue
                a, c, q = choices[0]
                got = self.acts[key] = (letters + a, q, cost + c)
                break
        return got

    def left(self, codes: list[int], right: tuple) -> tuple:
        """Vector before all of ``codes``."""
        for c in reversed(codes):
            right = self.back(right, c)[0]
        return right

    def transfer(self, codes: list[int]) -> list[int]:
        """Least costs from each state before ``codes`` to each state after them (row by row)."""
        columns = []
        for to in range(4):
            v, add = tuple(0 if s == to else _BIG for s in range(4)), 0
            for c in reversed(codes):
                v, low = self.back(v, c)
                add += low
            columns.append([x + add for x in v])
        return [columns[to][s] for s in range(4) for to in range(4)]

    def trace(self, codes: list[int], right: tuple, state: int, last: bool) -> tuple[str, int, int]:
        """(letters, state after, cost) of the least audit of ``codes``."""
        steps, v = [], right
        for c in reversed(codes):
            after = v
            v, low = self.back(v, c)
            steps.append((v, low, after, c))
        letters, cost = [], 0
        for v, low, after, c in reversed(steps):
            a, state, d = self.act(v, low, after, c, state)
            letters.append(a)
            cost += d
        while last and state in (1, 2):
            letters.append("I")
            cost += INSERT
            state = NEXT[state]
        return "".join(letters), state, cost


def codes_of(tags) -> list[int]:
    """Codes of a chunk from its tags: a row's tag, then 16 where it is the first of its role and text."""
    import numpy as np

    t = np.asarray(tags, np.int64)
    row = t < _MARK
    first = np.append(t[1:], 0)[row] == _MARK
    t = t[row]
    return np.where((t < 8) & ~first, t & 3 | 8, t).tolist()


def _by_row(df: DataFrame, keep: list[str], fields: list[tuple[str, str]], fn) -> DataFrame:
    """``keep`` and the fields that ``fn(viterbi, *other columns)`` returns, per row."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c not in keep]
    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {t}" for n, t in fields])
    arrow = {"string": "string", "int": "int32", "long": "int64", "array<long>": "longs"}

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int32": pa.int32(), "int64": pa.int64(), "longs": pa.list_(pa.int64())}
        v = Viterbi()
        for b in batches:
            rows = [fn(v, *r) for r in zip(*(b.column(c).to_pylist() for c in rest))]
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(c, kinds[arrow[t]]) for c, (_, t) in zip(columns, fields)],
                names=keep + [n for n, _ in fields])

    return df.select(*keep, *rest).mapInArrow(run, schema)


def _sweep(df: DataFrame, order: Column, fields: str, columns: list[str], start, step) -> DataFrame:
    """conv_id, block and a value carried along each conversation's chunks in
    ``order``: ``value, carry = step(carry, *columns)``, from ``start``. One small
    row a chunk streams by; only the carry is held."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        seen, carry = None, None
        for b in batches:
            conv = b.column("conv_id").to_pylist()
            out = []
            for c, *row in zip(conv, *(b.column(x).to_pylist() for x in columns)):
                if seen is None or seen[0] != c:
                    seen, carry = (c,), start
                value, carry = step(carry, *row)
                out.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("block"),
                 pa.array(out, pa.list_(pa.int64()) if "array" in fields else pa.int32())],
                names=["conv_id", "block", fields.split()[0]])

    return (df.select("conv_id", "block", *columns).repartition("conv_id").sortWithinPartitions("conv_id", order)
            .mapInArrow(run, f"conv_id {kind}, block long, {fields}"))


def _less(v) -> list[int]:
    low = min(v)
    return [x - low for x in v]


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, mark, pos, tag: one short row per row, numbered in
    conversation order by one range sort; equal rows may lie in several ranges."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(0), F.lit("u"), F.lit(1), F.lit("a"), F.lit(2)),
                                      F.substring("role", 1, 1)), F.lit(3))
    order = ["conv_id", "turn", "role", "mark", "spread"]
    light = rows.select(
        "conv_id", "turn", "role", "mark", F.monotonically_increasing_id().alias("spread"),
        (initial + F.when(blank, 12).when(cut, 4).otherwise(0)).cast("int").alias("tag"))
    return materialise(light.repartitionByRange(*order).sortWithinPartitions(*order)
                       .select("conv_id", "turn", "role", "mark", "tag", F.monotonically_increasing_id().alias("pos")),
                       "repair-rows")


def chunks_of(rows: DataFrame, chunk_bits: int) -> DataFrame:
    """conv_id, block, head (the first row's order key), tags, alone (no other
    chunk), last per chunk of a conversation."""
    block = F.shiftright("pos", chunk_bits).alias("block")
    firsts = rows.where("tag < 12").groupBy("conv_id", "mark").agg(F.min("pos").alias("pos"))
    tagged = rows.select("conv_id", block, "pos", F.col("tag").cast("tinyint").alias("tag"),
                         F.struct("turn", "role", "mark").alias("key")).unionByName(
        firsts.select("conv_id", block, "pos", F.lit(_MARK).cast("tinyint").alias("tag")), allowMissingColumns=True)
    grouped = tagged.groupBy("conv_id", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"),
        F.min("key").alias("head"))
    w = Window.partitionBy("conv_id").orderBy("block")
    return materialise(grouped.withColumn("before", F.lag("block").over(w)).withColumn("after", F.lead("block").over(w))
                       .select("conv_id", "block", "head", "tags", F.col("after").isNull().alias("last"),
                               (F.col("before").isNull() & F.col("after").isNull()).alias("alone")), "repair-chunks")


def stitched(chunks: DataFrame, fix_ups: int = FIX_UPS) -> DataFrame:
    """conv_id, block, right (vector after the chunk), entry (state before it) of
    the chunks of conversations that have several."""
    ids = ["conv_id", "block"]
    same = lambda a, b: (a["conv_id"].eqNullSafe(b["conv_id"])) & (a["block"] == b["block"])
    many = materialise(chunks.where(~F.col("alone")).select("conv_id", "block", "tags", "last"), "repair-many")
    right = Window.partitionBy("conv_id").orderBy("block")

    def run(v, tags, used):
        return (list(v.left(codes_of(tags), tuple(used))),)

    used = F.array(*(F.lit(x).cast("long") for x in END))
    # speculative start: the vector after a last row, which is exact for last chunks
    state = materialise(_by_row(many.select(*ids, used.alias("used"), "tags", used.alias("u")), [*ids, "used"],
                                [("left", "array<long>")], run), "repair-vectors")
    for _ in range(fix_ups):
        asked = state.withColumn("want", F.lead("left").over(right))
        stale = F.col("want").isNotNull() & (F.col("want") != F.col("used"))
        asked = materialise(asked.withColumn("stale", stale), "repair-asked")
        if asked.where("stale").isEmpty():
            return _entries(many, asked)
        a, m = asked.where("stale").select(*ids, "want").alias("a"), many.alias("m")
        again = a.join(m, same(a, m)).select("a.conv_id", "a.block", F.col("a.want").alias("used"), "m.tags",
                                             F.col("a.want").alias("u"))
        fresh = _by_row(again, [*ids, "used"], [("left", "array<long>")], run)
        state = materialise(asked.where("not stale").select(*ids, "used", "left").unionByName(fresh), "repair-vectors")
    # chunks that do not converge: their 4 x 4 tables, swept from the right
    tables = _by_row(many.select(*ids, "tags"), ids, [("costs", "array<long>")],
                     lambda v, tags: (v.transfer(codes_of(tags)),))
    swept = _sweep(tables, F.desc("block"), "used array<long>", ["costs"], list(END),
                   lambda carry, costs: (carry, _less([min(costs[4 * s + q] + carry[q] for q in range(4)) for s in range(4)])))
    return _entries(many, materialise(swept, "repair-asked"))


def _entries(many: DataFrame, vectors: DataFrame) -> DataFrame:
    """The state before each chunk, from the exits of its neighbours."""
    ids = ["conv_id", "block"]
    a, m = vectors.alias("a"), many.alias("m")
    exact = materialise(a.join(m, a["conv_id"].eqNullSafe(m["conv_id"]) & (a["block"] == m["block"])).select(
        "a.conv_id", "a.block", F.col("a.used").alias("right"), "m.tags"), "repair-exact")

    def exits(v, tags, right):
        codes = codes_of(tags)
        return ([v.trace(codes, tuple(right), s, False)[1] for s in range(4)],)

    out = _by_row(exact.select(*ids, "tags", "right"), ids, [("exits", "array<long>")], exits)
    entry = _sweep(out, F.asc("block"), "entry int", ["exits"], 0, lambda s, e: (s, int(e[s])))
    x, e = exact.alias("x"), entry.alias("e")
    return x.join(e, x["conv_id"].eqNullSafe(e["conv_id"]) & (x["block"] == e["block"])).select(
        "x.conv_id", "x.block", "x.right", "e.entry")


def traced(chunks: DataFrame, fix_ups: int = FIX_UPS) -> DataFrame:
    """conv_id, block, head, audit, cost, blank, duplicate, truncated, illegal
    (pairs inside), first, final (initials) per chunk."""
    ids = ["conv_id", "block"]
    end = F.array(*(F.lit(x).cast("long") for x in END))
    alone = chunks.where("alone").select(*ids, "head", "tags", "last", end.alias("right"), F.lit(0).alias("entry"))
    if chunks.where("not alone").isEmpty():
        ready = alone
    else:
        c, s = chunks.where("not alone").alias("c"), stitched(chunks, fix_ups).alias("s")
        ready = alone.unionByName(c.join(s, c["conv_id"].eqNullSafe(s["conv_id"]) & (c["block"] == s["block"])).select(
            "c.conv_id", "c.block", "c.head", "c.tags", "c.last", "s.right", "s.entry"))

    def run(v, tags, last, right, entry):
        codes = codes_of(tags)
        audit, _, cost = v.trace(codes, tuple(right), entry, last)
        faults = [c >> 2 for c in codes]
        initials = [c & 3 for c in codes]
        wrong = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))
        return audit, cost, faults.count(3), faults.count(2), faults.count(1), wrong, initials[0], initials[-1]

    return materialise(_by_row(ready, [*ids, "head"], [
        ("audit", "string"), ("cost", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"),
        ("illegal", "long"), ("first", "int"), ("final", "int")], run), "repair-traces")


def summary(traces: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit per conversation."""
    w = Window.partitionBy("conv_id").orderBy("block")
    was, now = F.lag("final").over(w), F.col("first")
    legal = (was == 0) & (now == 1) | (was == 1) & (now == 2) | (was == 2) & (now == 1)
    parts = traces.withColumn("edge", F.when(was.isNotNull() & ~legal, 1).otherwise(0))
    return parts.groupBy("conv_id").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        F.sum(F.col("illegal") + F.col("edge")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    # role and text in one 128-bit mark; the length keeps the two apart
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                       F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("mark"))


def repair_traces(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", chunk_bits: int = CHUNK_BITS, fix_ups: int = FIX_UPS) -> DataFrame:
    """The least audits by chunk; ``summary`` and ``repaired`` read them."""
    return traced(chunks_of(numbered(_prepared(rows, conv_col, turn_col, role_col, text_col)), chunk_bits), fix_ups)


def repaired(rows: DataFrame, traces: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n, role, text of the repaired conversations: their rows in order,
    each conversation's in one partition. Letters and rows are merged as they
    stream by; letters of chunks that delete every row are held as a number."""
    kind = rows.schema[conv_col].dataType.simpleString()
    full = _prepared(rows, conv_col, turn_col, role_col, text_col)
    nothing = F.lit(None).cast("string")
    edits = traces.select("conv_id", "head.turn", "head.role", F.col("head.mark").alias("mark"), "block", "audit", nothing.alias("text"))
    both = full.select("conv_id", "turn", "role", "mark", F.lit((1 << 63) - 1).alias("block"), nothing.alias("audit"), "text").unionByName(edits)
    laid = both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "block").select("conv_id", "role", "audit", "text")

    def run(batches):
        from collections import deque

        import pyarrow as pa

        seen, held, letters, at, n = None, deque(), "", 0, 0
        conv_type = None

        def batch(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], conv_type), pa.array([r[1] for r in out], pa.int64()),
                 pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())],
                names=["conv_id", "n", "role", "text"])

        def emit(out, initial_role, text):
            nonlocal n
            out.append((seen[0], n, initial_role, text))
            n += 1

        def turn_role():
            """Role of the next row: the one after a system row or nothing is a user's."""
            return "assistant" if after == "u" else "user"

        def finish(out):
            """Inserts that close the conversation."""
            nonlocal after, letters, at
            while True:
                while at < len(letters):
                    emit(out, turn_role(), "")
                    after = "a" if after == "u" else "u"
                    at += 1
                if not held:
                    return
                letters, at = held.popleft(), 0

        after = ""
        for b in batches:
            conv_type = b.column(0).type
            out = []
            for c, role, audit, text in zip(*(x.to_pylist() for x in b.columns)):
                if seen is None or seen[0] != c:
                    if seen is not None:
                        finish(out)
                    seen, letters, at, n, after = (c,), "", 0, 0, ""
                    held.clear()
                if audit is not None:
                    held.append(len(audit) if audit.count("D") == len(audit) else audit)
                    continue
                while True:
                    if isinstance(letters, int):
                        if letters:
                            letters -= 1
                            move = "D"
                            break
                    elif at < len(letters):
                        move = letters[at]
                        at += 1
                        if move != "I":
                            break
                        emit(out, turn_role(), "")
                        after = "a" if after == "u" else "u"
                        continue
                    letters, at = held.popleft(), 0
                if isinstance(letters, int) and not letters:
                    letters, at = "", 0
                if move == "K":
                    emit(out, role, text)
                    after = role[0]
                elif move == "R":
                    emit(out, turn_role(), text)
                    after = "a" if after == "u" else "u"
            yield batch(out)
        if seen is not None:
            out = []
            finish(out)
            yield batch(out)

    ship(rows.sparkSession)
    return laid.mapInArrow(run, f"conv_id {kind}, n long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 over ``role:text`` lines of the rows of ``repaired``."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        seen, h, conv_type = None, None, None
        for b in batches:
            conv_type = b.column(0).type
            done = []
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if seen is not None and seen[0] == c:
                    h.update(f"\n{role}:{text}".encode())
                    continue
                if seen is not None:
                    done.append((seen[0], h.hexdigest()))
                seen, h = (c,), hashlib.sha256(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], conv_type), pa.array([d[1] for d in done], pa.string())],
                                             names=["conv_id", "repaired_sha256"])
        if seen is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seen[0]], conv_type), pa.array([h.hexdigest()], pa.string())],
                                             names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32(conv_id:turn) % 20."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                             (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("h"))
    d = d.where("h <> 0").withColumn("text", F.when(F.col("h") == 1, "").when(
        F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).withColumn(
        "role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return d.select("conv_id", "turn", "role", "text", F.explode(F.expr("sequence(1, if(h = 3, 2, 1))")).alias("copy")).drop("copy")


def audit_table(conversations: DataFrame, rows: DataFrame, chunk_bits: int = CHUNK_BITS, fix_ups: int = FIX_UPS) -> DataFrame:
    """The contract's row per original conversation from its damaged ``rows``."""
    traces = repair_traces(rows, chunk_bits=chunk_bits, fix_ups=fix_ups)
    gaps = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select("conv_id").distinct()
    for part in (summary(traces), gaps, digests(repaired(rows, traces))):
        every = every.unionByName(part, allowMissingColumns=True)
    empty = F.sha2(F.lit(""), 256)
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(n), F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))


def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return audit_table(conversations, damaged(conversations))
