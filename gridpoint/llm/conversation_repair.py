"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal, by A* on the edit lattice.

A node of the lattice is (rows read, state of the role pattern `(s?(ua)+)?`). Keep, Rerole, Delete and Insert lead on from
it. The heuristic is the suffix sum of what no path can avoid: a deletion for each blank or repeated row, the charge for
each truncated one. It is consistent, so with a queue keyed (cost plus heuristic, audit) the first path to reach a node is
its cheapest, and among equally cheap ones that with the ASCII-least audit.

Rows of conversations of up to LONG rows are shuffled once, by conversation, and pass through a task as a sorted stream;
one conversation is held at a time. Longer ones are ordered by range over many tasks and cut into BLOCK rows: each block is
searched from every state to every state, and FOLD blocks at a time are joined, level by level, so no task holds one
whole. Only their digest, which SHA-256 defines as one sequence, is computed in one pass over rows that stream by.

Nulls in any column read as one space; a null conversation is one of its own. Rows of a conversation are taken by turn
(nulls first), then role and text, so ties have one order; rows that repeat are duplicates. A role whose first letter is
not s, u or a (or an empty one) is never kept. An empty table gives no row. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm import sql
from gridpoint.llm.common import table, with_facts, written

#: Conversations of more rows are searched in blocks; rows of a block; blocks joined at once.
LONG = 512
BLOCK = 256
FOLD = 64
#: Costs of edits, and the charge of a truncated row that stays. Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The role pattern: from nothing yet (0), after s (1), after u (2), after a (3), by initial; states in which it may end. Fixed values.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\f\r"
BLANK, REPEATED, CUT = "b", "d", "t"


def search(initials: list[str], faults: list[str], entry: int = 0, ends: tuple = ENDS, first: bool = True) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) from a state before the rows to the states after them: the first of ends reached, or all."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] in (BLANK, REPEATED) else TRUNCATED if faults[i] == CUT else 0)
    queue, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        least, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = least - ahead[i]
        if i == n and state in ends:
            found[state] = (cost, audit)
            if first:
                break
        for letter, to in NEXT[state].items():
            if letter != "s" and (i, to) not in closed:
                heapq.heappush(queue, (cost + INSERT + ahead[i], audit + "I", i, to))
        if i == n:
            continue
        after = ahead[i + 1]
        heapq.heappush(queue, (cost + DELETE + after, audit + "D", i + 1, state))
        if faults[i] not in (BLANK, REPEATED):
            charge = TRUNCATED if faults[i] == CUT else 0
            for letter, to in NEXT[state].items():
                if letter == initials[i]:
                    heapq.heappush(queue, (cost + charge + after, audit + "K", i + 1, to))
                elif letter != "s":
                    heapq.heappush(queue, (cost + REROLE + charge + after, audit + "R", i + 1, to))
    return found


class Repair:
    """Applies an audit to rows as they come; out() tells role and text of each repaired row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.made(), ""

    def made(self) -> str:
        letter = next(x for x in NEXT[self.state] if x != "s")
        self.state = NEXT[self.state][letter]
        return ROLES[letter]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[:1]]
            yield role, text
        elif edit == "R":
            yield self.made(), text


class Digest:
    """SHA-256 of role:text, joined by newlines, as rows come."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.some = True


def fault(text: str, repeated: bool) -> str:
    bare = text.rstrip(WHITE)
    return BLANK if not bare else REPEATED if repeated else CUT if bare[-1] not in ".!?" else ""


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


COUNTED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: list[tuple]) -> tuple:
    """What COUNTED names, of one conversation's rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    ((cost, audit),) = search(initials, faults).values()
    repair, digest = Repair(audit), Digest()
    for _, role, text in rows:
        digest.add(repair.row(role, text))
    digest.add(repair.inserted())
    return gaps, faults.count(BLANK), faults.count(REPEATED), faults.count(CUT), illegal_pairs(initials), cost, audit, digest.sha.hexdigest()


def conversations(found: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(key, rows) of a stream that is sorted by its first column, one after another; each row is a tuple of the other columns."""
    key, held, some = None, [], False
    for batch in found:
        values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        for own, *row in zip(*values):
            if some and own != key:
                yield key, held
                held = []
            key, some = own, True
            held.append(row)
    if some:
        yield key, held


def short_ones():
    """Sorted rows (conv, turn, role, text, copies) to what COUNTED names, one conversation at a time."""
    fields = [c.split()[0] for c in COUNTED.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in COUNTED.split(", ")]

    def repair(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = None, []

        def batch() -> pa.RecordBatch:
            keys, rows = zip(*out)
            columns = [pa.array(keys, kinds), *(pa.array(c, t) for c, t in zip(zip(*rows), types))]
            return pa.RecordBatch.from_arrays(columns, ["conv", *fields])

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for b in found:
                kinds = b.schema.field("conv").type
                yield b

        for conv, rows in conversations(noted(), ["conv", "turn", "role", "text", "copies"]):
            out.append((conv, repaired([(t, r, x) for t, r, x, n in rows for _ in range(n)])))
            if len(out) == 2000:
                yield batch()
                out = []
        if out:
            yield batch()

    return repair


TRANSFERS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"


def joined_blocks(parts: list[list[tuple]]) -> list[tuple]:
    """The transfers (entry, exit, cost, audit) over blocks that follow each other."""
    best = {(e, x): (c, a) for e, x, c, a in parts[0]}
    for part in parts[1:]:
        by: dict[int, list] = {}
        for e, x, c, a in part:
            by.setdefault(e, []).append((x, c, a))
        after: dict = {}
        for (e, middle), (c, a) in best.items():
            for x, more, audit in by.get(middle, ()):
                one = (c + more, a + audit)
                if (e, x) not in after or one < after[e, x]:
                    after[e, x] = one
        best = after
    return [(e, x, c, a) for (e, x), (c, a) in best.items()]


def search_block(rows: pa.Table) -> pa.Table:
    """One block of a long conversation, searched from each state."""
    rows = rows.sort_by("at")
    initials, faults = rows.column("initial").to_pylist(), rows.column("fault").to_pylist()
    found = [(e, x, c, a) for e in range(4) for x, (c, a) in search(initials, faults, e, (0, 1, 2, 3), first=False).items()]
    return block_row(rows, found, illegal_pairs(initials), initials[0], initials[-1])


def fold_blocks(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("block")
    parts = [[tuple(t.values()) for t in p] for p in rows.column("transfers").to_pylist()]
    first, last = rows.column("first").to_pylist(), rows.column("last").to_pylist()
    between = sum(a + b not in LEGAL for a, b in zip(last, first[1:]))
    return block_row(rows, joined_blocks(parts), sum(rows.column("illegal").to_pylist()) + between, first[0], last[-1])


def block_row(rows: pa.Table, transfers: list[tuple], illegal: int, first: str, last: str) -> pa.Table:
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    one = [dict(zip(("entry", "exit", "cost", "audit"), t)) for t in transfers]
    columns = [rows.column("key").combine_chunks().slice(0, 1), rows.column("group").combine_chunks().slice(0, 1), pa.array([one], kind), pa.array([illegal], pa.int64()), pa.array([first]), pa.array([last])]
    return pa.Table.from_arrays(columns, ["key", "block", "transfers", "illegal", "first", "last"])


def digests_of_long(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose audit comes first and whose rows follow in order."""
    key, repair, digest, out, kind = None, None, None, [], None

    def done() -> None:
        if repair is not None:
            digest.add(repair.inserted())
            out.append((key, digest.sha.hexdigest()))

    for batch in found:
        kind = batch.schema.field("key").type
        for own, audit, role, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "audit", "role", "text"))):
            if audit is not None:
                done()
                key, repair, digest = own, Repair(audit), Digest()
            else:
                digest.add(repair.row(role, text))
    done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([s for _, s in out])], ["key", "repaired_sha256"])


def long_ones(rows: DataFrame) -> DataFrame:
    """conv and what COUNTED names, of rows (key, conv, turn, role, text, copies) of long conversations."""
    kind = rows.schema["key"].dataType.simpleString()
    each = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("key", "turn", "role", "text")
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "long-conversations")  # at is in the order of all rows, and stays as it is
    firsts = placed.groupBy("key", "role", F.sha2("text", 256).alias("sha")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    facts = placed.select("key", "turn", "at", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("none"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    what = F.when(F.col("none"), BLANK).when(F.col("fresh").isNull(), REPEATED).when(~F.col("ended"), CUT).otherwise("")
    facts = written(facts.join(firsts, "at", "left").select("key", "turn", "at", "initial", what.alias("fault")), "faults")
    shape = f"key {kind}, block long, transfers {TRANSFERS}, illegal long, first string, last string"
    blocks = written(facts.withColumn("group", F.floor(F.col("at") / BLOCK)).groupBy("key", "group").applyInArrow(search_block, shape), "blocks")
    while not blocks.groupBy("key").count().where("count > 1").isEmpty():
        blocks = written(blocks.withColumn("group", F.floor(F.col("block") / FOLD)).groupBy("key", "group").applyInArrow(fold_blocks, shape), "blocks")
    ends = F.filter("transfers", lambda t: (t["entry"] == 0) & t["exit"].isin(*ENDS))
    best = F.array_min(F.transform(ends, lambda t: F.struct(t["cost"].alias("cost"), t["audit"].alias("audit"))))
    audits = blocks.select("key", "illegal", best.alias("best")).select("key", "illegal", "best.*")
    stream = audits.select("key", F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = stream.unionByName(placed.select("key", "at", F.lit(None).cast("string").alias("audit"), "role", "text"))
    shas = stream.repartition("key").sortWithinPartitions("key", "at").mapInArrow(digests_of_long, f"key {kind}, repaired_sha256 string")
    counted = facts.groupBy("key").agg(*(F.count(F.when(F.col("fault") == f, 1)).alias(n) for f, n in ((BLANK, "blank"), (REPEATED, "duplicate"), (CUT, "truncated"))))
    turns = facts.where("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = rows.select("key").distinct().join(counted, "key", "left").join(turns, "key", "left").join(audits, "key", "left").join(shas, "key", "left")
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none = hashlib.sha256(b"").hexdigest()
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(none))}).withColumn("conv", F.col("key.conv")).drop("key")


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """conv and what COUNTED names, a row for every conversation of df. copies: how often a row stands there (once; 0: it only names its conversation)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), told(role).alias("role"), told(text).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    rows = rows.withColumn("key", F.struct("conv"))
    kind = df.schema[conv].dataType.simpleString()
    counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "lengths").where(F.col("n") > LONG)
    some = not counts.isEmpty()
    if some:
        total = rows.count()
        kept = written(with_facts(rows, counts, ["key"], "n", total), "rows-of-long").drop("n")
        rows = rows.join(counts.select("key"), "key", "left_anti")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    short = rows.drop("key").repartition("conv").sortWithinPartitions(*order).mapInArrow(short_ones(), f"conv {kind}, {COUNTED}")
    names = ["conv", *(c.split()[0] for c in COUNTED.split(", "))]
    out = short.select(*names).unionByName(long_ones(kept).select(*names)) if some else short.select(*names)
    return out.withColumnRenamed("conv", conv)


def damaged(df: DataFrame) -> DataFrame:
    """conversations with planted faults, by a check sum of conversation and turn; copies tells how often a row stands there then."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(k == 4, "user").otherwise(blank("role"))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), copies=F.col("copies"))


def _step(state: str, edit: str, cost: str, role: str = "", text: str = "") -> str:
    told = f"coalesce({state}.r || chr(10), '') || {role} || ':' || {text}" if role else f"{state}.r"
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', r := {told})"


def _stay(state: str, letter: str) -> str:
    kept, made = _step(state, "K", "charge", "role", "text"), _step(state, "R", "2 + charge", f"'{ROLES[letter]}'", "text")
    return f"CASE WHEN must THEN never WHEN initial = '{letter}' THEN {kept} ELSE {made} END"


#: The same by dynamic programming: the best (cost, audit, text) of each state after each row.
OP11_SQL = f"""WITH RECURSIVE {sql.CRC_TABLE},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {sql.crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hit),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed),
rows_ AS (SELECT *, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN 1 ELSE 0 END AS charge, {{'c': 1000000000, 'a': '', 'r': NULL::VARCHAR}} AS never FROM judged),
walk(conv_id, n, s0, s1, s2, s3) AS (
    SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 'r': NULL::VARCHAR}}, {{'c': 1000000000, 'a': '', 'r': NULL::VARCHAR}},
        {{'c': 2, 'a': 'I', 'r': 'user:'}}, {{'c': 4, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, n, s0, s1, s2, least(s3, {_step("s2", "I", "2", "'assistant'", "''")}) FROM (
        SELECT conv_id, n, s0, s1, least(s2, {", ".join(_step(s, "I", "2", "'user'", "''") for s in ("s0", "s1", "s3"))}) AS s2, s3 FROM (
            SELECT w.conv_id, w.n + 1 AS n, {_step("w.s0", "D", "3")} AS s0,
                least({_step("w.s1", "D", "3")}, CASE WHEN must OR initial <> 's' THEN never ELSE {_step("w.s0", "K", "charge", "role", "text")} END) AS s1,
                least({_step("w.s2", "D", "3")}, {", ".join(_stay(s, "u") for s in ("w.s0", "w.s1", "w.s3"))}) AS s2,
                least({_step("w.s3", "D", "3")}, {_stay("w.s2", "a")}) AS s3
            FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.n + 1))),
last_ AS (SELECT conv_id, arg_max(least(s0, s3), n) AS best FROM walk GROUP BY conv_id),
counted AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM last_ l LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": OP11_SQL}
