"""Conversation structure repair by bidirectional Dijkstra over the edit lattice (operator 12).

A node of the lattice is a number of rows done and a state of the role pattern
``(s?(ua)+)?``; its edges keep, rerole or delete the next row or insert one. A forward and a
reverse search, each by its heap, go on until no crossing can be cheaper or as cheap as the
best, and the least of the concatenated audits of those crossings is taken.

Rows are sorted over all partitions at once and cut into pieces of bounded length, so that
a conversation of any length is many pieces. A piece that may be part of a longer
conversation gets the cheapest way between any two states, else only the ways from the
pattern's start to its ends; a conversation's pieces are then linked by states.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import scratch

BLANK = r"\A[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"

#: The pattern's automaton: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 and 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = 4, (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a piece, and characters of its texts; a longer row is a piece of its own.
PIECE, PIECE_CHARS = 256, 4_000_000
LEGAL = ("su", "ua", "au")


def added(state: int) -> str:
    """The one role, user or assistant, that may come next."""
    return "a" if state == 2 else "u"


def onward(codes: str, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges out of a node: (i, q, cost, edit). A code is the row's role initial (o for others), upper
    case where it is truncated, or x where it has to go."""
    yield i, STEP[q, added(q)], INSERT, "I"
    if i < len(codes):
        code = codes[i]
        yield i + 1, q, DELETE, "D"
        if code != "x":
            extra = TRUNCATED if code.isupper() else 0
            if (kept := STEP.get((q, code.lower()))) is not None:
                yield i + 1, kept, extra, "K"
            yield i + 1, STEP[q, added(q)], REROLE + extra, "R"


BEFORE = [[(p, c) for (p, c), t in STEP.items() if t == q] for q in range(STATES)]


def backward(codes: str, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges into a node, likewise."""
    for p, role in BEFORE[q]:
        if role != "s":
            yield i, p, INSERT, "I"
    if i:
        code = codes[i - 1]
        yield i - 1, q, DELETE, "D"
        if code != "x":
            extra = TRUNCATED if code.isupper() else 0
            for p, role in BEFORE[q]:
                if role == code.lower():
                    yield i - 1, p, extra, "K"
                if role != "s":
                    yield i - 1, p, REROLE + extra, "R"


@lru_cache(maxsize=50_000)
def cheapest(codes: str, start: int, end: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way from one state before the rows to another after them.

    Heaps are ordered by cost, then rows done: the only edges without cost lead over a row, so
    that a node's least audit is known when it is taken. Audits of equal cost at one node are
    never prefixes of each other, which is why least halves make least wholes.
    """
    n = len(codes)
    heaps = ([(0, 0, "", start)], [(0, 0, "", end)])
    done: tuple[dict, dict] = ({}, {})
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1]:
        if best and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, far, audit, q = heapq.heappop(heaps[side])
        i = n - far if side else far
        if (i, q) in done[side]:
            continue
        done[side][i, q] = cost, audit
        if (other := done[1 - side].get((i, q))) is not None:
            whole = (cost + other[0], other[1] + audit if side else audit + other[1])
            best = min(best, whole) if best else whole
        for j, p, price, edit in (backward if side else onward)(codes, i, q):
            longer = edit + audit if side else audit + edit
            if (other := done[1 - side].get((j, p))) is not None:
                whole = (cost + price + other[0], other[1] + longer if side else longer + other[1])
                best = min(best, whole) if best else whole
            if (j, p) not in done[side]:
                heapq.heappush(heaps[side], (cost + price, n - j if side else j, longer, p))
    return best


def links(codes: str, whole: bool) -> list[dict]:
    """The cheapest ways through a piece by its states at both ends. Rows that all have to go are
    deleted before anything is inserted, however many they are."""
    out, more = [], 0
    if codes.strip("x") == "":
        codes, more = "x", len(codes) - 1
    for start in (0,) if whole else range(STATES):
        for end in ENDS if whole else range(STATES):
            if found := cheapest(codes, start, end):
                out.append({"start": start, "end": end, "cost": found[0] + DELETE * more, "audit": "D" * more + found[1]})
    return out


class Audit:
    """A piece's audit and those after it, compared from the front without being joined."""

    def __init__(self, head: str, rest: Audit | None):
        self.head, self.rest = head, rest

    def __lt__(self, other: Audit) -> bool:
        a: Audit | None = self
        b: Audit | None = other
        x = y = 0  # characters done of a's head and of b's
        while a is not None and b is not None and (a is not b or x != y):
            size = min(len(a.head) - x, len(b.head) - y)
            if (left := a.head[x : x + size]) != (right := b.head[y : y + size]):
                return left < right
            x, y = x + size, y + size
            if x == len(a.head):
                a, x = a.rest, 0
            if b is not None and y == len(b.head):
                b, y = b.rest, 0
        return a is None and b is not None


def linked(pieces: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and each piece's first state and audit, of the cheapest chain from 0 to an end of the pattern."""
    ways: dict[int, tuple[int, Audit, tuple]] = {q: (0, Audit("", None), ()) for q in ENDS}
    for own in reversed(pieces):
        new: dict[int, tuple[int, Audit, tuple]] = {}
        for x in own:
            if x["end"] in ways:
                cost, audit, then = ways[x["end"]]
                way = (cost + x["cost"], Audit(x["audit"], audit), (x["start"], x["audit"], then))
                old = new.get(x["start"])
                if old is None or (way[0], way[1]) < (old[0], old[1]):
                    new[x["start"]] = way
        ways = new
    cost, _, then = ways[0]
    out = []
    while then:
        start, audit, then = then
        out.append((start, audit))
    return cost, out


NAMES = {"u": "user", "a": "assistant"}


def applied(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows of a piece."""
    at = 0
    for edit in audit:
        if edit == "I":
            yield NAMES[added(state)], ""
            state = STEP[state, added(state)]
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            yield role, text
            state = STEP[state, role[:1]]
        elif edit == "R":
            yield NAMES[added(state)], text
            state = STEP[state, added(state)]


def damaged(rows: DataFrame) -> DataFrame:
    """The given faults: by crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties its text, 2 removes
    its ends of sentences, 3 repeats it, 4 sets its role to user. Nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"), fault.alias("__fault"),
    )
    return out.where("__fault <> 0").withColumn("__copy", F.explode(F.when(F.col("__fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__fault", "__copy")


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text, copies, fault, code): equal rows once, with the first one's fault and code.

    A row is a duplicate if its role and text stand in the conversation before it. What repeats
    is grouped by a digest of the text first, so that only such rows meet others of their key.
    """
    once = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    once = once.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    again = once.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    again = again.select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"), "first")
    on = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    both = once.join(again.hint("merge"), on, "left")
    late = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    blank = F.col("text").rlike(BLANK)
    cut_off = F.col("text").rlike(CUT_OFF)
    fault = F.when(blank, "b").when(late, "d").when(cut_off, "t").otherwise("")
    return both.select("conv_id", "turn", "role", "digest", "text", "copies", fault.alias("fault"), F.when(blank | late, "x").when(cut_off, F.upper(code)).otherwise(code).alias("code"))


LINK = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
NUMBERS = ("blank", "duplicate", "truncated", "illegal", "turns")


def piece_schema(conv: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("conv_id", conv), ("part", pa.int32()), ("place", pa.int32()), ("numbers", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())),
        ("links", pa.list_(LINK)), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))),
    ])


PIECE_DDL = "part int, place int, numbers array<bigint>, turns array<bigint>, ends array<string>, links array<struct<start:int,end:int,cost:bigint,audit:string>>, rows array<struct<role:string,text:string,copies:bigint>>"


def piece(conv: object, part: int, place: int, rows: list[tuple], whole: bool) -> dict:
    """A piece's faults, links and rows. ``rows`` are (turn, role, text, copies, fault, code)."""
    codes = "".join(code + "x" * (copies - 1) for *_, copies, _, code in rows)
    initials = [role[:1] for _, role, *_ in rows]
    illegal = sum((a + b) not in LEGAL for a, b in zip(initials, initials[1:])) + sum(r[3] - 1 for r in rows)
    copies = [0 if r[4] == "b" else r[3] - 1 for r in rows]
    faults = [sum(r[4] == "b" and r[3] for r in rows), sum(r[4] == "d" for r in rows) + sum(copies), sum(r[4] == "t" for r in rows)]
    turns = sorted({r[0] for r in rows if r[0] is not None})
    return {
        "conv_id": conv, "part": part, "place": place, "numbers": [*faults, illegal, len(turns)], "turns": [turns[0], turns[-1]] if turns else [], "ends": [initials[0], initials[-1]],
        "links": links(codes, whole), "rows": [{"role": r[1], "text": r[2], "copies": r[3]} for r in rows],
    }


def pieces_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into pieces. One that begins or ends the task's rows, or that a bound cuts
    off, may have neighbours of its conversation elsewhere; all others are whole."""
    ready: list[dict] = []
    held: list[tuple] = []
    conv, place, size, cut = None, 0, 0, True

    def close(whole: bool) -> None:
        nonlocal held, place, size
        if held:
            ready.append(piece(conv, part, place, held, whole))
            held, place, size = [], place + 1, 0

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            own, part, row = row[0], row[1], row[2:]
            if held and own != conv:
                close(not cut)
                cut = False
            elif len(held) >= PIECE or size + len(row[2]) > PIECE_CHARS:
                close(False)
                cut = True
            conv = own
            held.append(row)
            size += len(row[2])
            if (copies := row[3]) > PIECE:  # all but the first are a piece of their own
                held[-1] = (*row[:3], 1, *row[4:])
                close(False)
                held.append((*row[:3], copies - 1, "b" if row[4] == "b" else "d", "x"))
                close(False)
                cut = True
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)
            ready = []
    close(False)
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


def in_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of all conversations, written to the shared folder.

    Sorting over all partitions deals a long conversation out by its turns, and rows of one
    turn by role and digest; equal rows are one row here.
    """
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "digest"]
    ranged = coded(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    ready = ranged.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "copies", "fault", "code")
    kind = rows.schema["conv_id"].dataType
    schema = piece_schema(pa.string() if kind.simpleString() == "string" else pa.int64())
    path = scratch(spark, "conversation-pieces")
    out = ready.mapInArrow(lambda batches: pieces_of(batches, schema), f"conv_id {kind.simpleString()}, {PIECE_DDL}")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def solved(batches: Iterator[pa.RecordBatch], schema: pa.Schema, messages: bool) -> Iterator[pa.RecordBatch]:
    """Conversations from their pieces, sorted by conversation: first all links of one, which give the
    audits, then its rows piece by piece, which are repaired and hashed as they come."""
    ready: list[dict] = []
    chain: list[dict] = []
    state: dict = {}

    def begin() -> None:
        cost, audits = linked([x["links"] for x in chain])
        numbers = [sum(x["numbers"][k] for x in chain) for k in range(len(NUMBERS))]
        given = [x["turns"] for x in chain if x["turns"]]
        numbers[4] -= sum(a[1] == b[0] for a, b in zip(given, given[1:]))
        ends = [x["ends"] for x in chain]
        numbers[3] += sum((a[1] + b[0]) not in LEGAL for a, b in zip(ends, ends[1:]))
        gaps = given[-1][1] - given[0][0] + 1 - numbers[4] if given else 0
        state.update(conv=chain[0]["conv_id"], audits=audits, at=0, lines=0, hash=hashlib.sha256(), out={"gaps": gaps, **dict(zip(NUMBERS[:4], numbers)), "cost": cost, "audit": "".join(a for _, a in audits)})
        chain.clear()

    def finish() -> None:
        if state and not messages:
            ready.append({"conv_id": state["conv"], **state["out"], "repaired_sha256": state["hash"].hexdigest()})

    for batch in batches:
        for x in batch.to_pylist():
            if x["kind"] == 0:
                if not chain:
                    finish()
                chain.append(x)
                continue
            if chain:
                begin()
            start, audit = state["audits"][state["at"]]
            state["at"] += 1
            rows = [(r["role"], r["text"]) for r in x["rows"] for _ in range(r["copies"])]
            for role, text in applied(audit, start, rows):
                if messages:
                    ready.append({"conv_id": x["conv_id"], "place": state["lines"], "role": role, "text": text})
                else:
                    state["hash"].update(f"{chr(10) if state['lines'] else ''}{role}:{text}".encode())
                state["lines"] += 1
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)
            ready = []
    finish()
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


COSTS = ("gaps", *NUMBERS[:4], "cost")


def from_pieces(pieces: DataFrame, messages: bool) -> DataFrame:
    kinds = F.explode(F.array(F.lit(0), F.lit(1)))
    both = pieces.withColumn("kind", kinds).select(
        "conv_id", "kind", "part", "place", "numbers", "turns", "ends", F.when(F.col("kind") == 0, F.col("links")).alias("links"), F.when(F.col("kind") == 1, F.col("rows")).alias("rows"),
    )
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "place")
    ident = pieces.schema["conv_id"].dataType.simpleString()
    key = pa.string() if ident == "string" else pa.int64()
    if messages:
        schema, ddl = pa.schema([("conv_id", key), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]), f"conv_id {ident}, place bigint, role string, text string"
    else:
        schema = pa.schema([("conv_id", key), *((c, pa.int64()) for c in COSTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        ddl = f"conv_id {ident}, {', '.join(f'{c} bigint' for c in COSTS)}, audit string, repaired_sha256 string"
    return dealt.mapInArrow(lambda batches: solved(batches, schema, messages), ddl)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of every conversation after its cheapest repair, from place 0."""
    return from_pieces(in_pieces(rows), True)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation; rows are (conv_id, turn, role, text).

    ``conversations`` (conv_id) adds those that have no rows: zeros, an empty audit, the hash of
    nothing. A null conv_id is a conversation, null turns come first, null roles and texts are one
    space; rows of one turn go by role and digest of the text. Repeated rows are duplicates. An
    empty table gives no rows; other columns are not read. Ids are long or string.

    A conversation's texts pass through one task as a stream, since a digest of all of them is
    asked for; that task holds the conversation's audits, a letter a row and way, and the rows of
    one piece: 256 rows or 4 million characters, or one longer text.
    """
    found = from_pieces(in_pieces(rows), False)
    if conversations is None:
        return found
    own = conversations.select(F.col("conv_id").alias("__conv")).distinct()
    both = own.join(found.hint("merge"), F.col("__conv").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COSTS]
    return both.select(F.col("__conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
faulty AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM named n, crc),
damaged AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM faulty WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
coded AS (SELECT *, left(role, 1) AS initial, regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank, regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') AS cut FROM placed),
r AS (SELECT *, blank OR nth > 1 AS must, (NOT blank AND nth = 1 AND cut)::INT AS extra FROM coded),
convs AS (SELECT DISTINCT conv_id FROM conversations),
step(q, c, q2, role) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ins(q, q2, n, lines) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, chr(10) || 'user:'), (1, 2, 1, chr(10) || 'user:'), (2, 3, 1, chr(10) || 'assistant:'), (3, 2, 1, chr(10) || 'user:'),
(0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (3, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:')),
moves AS (SELECT conv_id, i, q, q AS q2, 3 AS cost, 'D' AS edit, '' AS line FROM r, range(4) t(q)
UNION ALL SELECT conv_id, i, q, q2, extra, 'K', chr(10) || r.role || ':' || text FROM r JOIN step ON c = initial WHERE NOT must
UNION ALL SELECT conv_id, i, q, q2, 2 + extra, 'R', chr(10) || step.role || ':' || text FROM r, step WHERE NOT must AND c <> 's'),
edges AS (SELECT m.conv_id, i, m.q, ins.q2, m.cost + 2 * n AS cost, edit || repeat('I', n) AS edit, line || lines AS line FROM moves m JOIN ins ON ins.q = m.q2),
way(conv_id, i, q, cost, audit, lines) AS (
SELECT conv_id, 0::BIGINT, q2, 2 * n, repeat('I', n), lines FROM convs, ins WHERE q = 0
UNION ALL
SELECT conv_id, i, q2, cost, audit, lines FROM (
SELECT w.conv_id, e.i, e.q2, w.cost + e.cost AS cost, w.audit || e.edit AS audit, w.lines || e.line AS lines, row_number() OVER (PARTITION BY w.conv_id, e.i, e.q2 ORDER BY w.cost + e.cost, w.audit || e.edit) AS k
FROM way w JOIN edges e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = w.q) WHERE k = 1),
size AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND nth > 1) AS duplicate, sum(extra)::BIGINT AS truncated FROM r GROUP BY conv_id),
bad AS (SELECT conv_id, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id),
ended AS (SELECT c.conv_id, w.cost, w.audit, substr(w.lines, 2) AS repaired, row_number() OVER (PARTITION BY c.conv_id ORDER BY w.cost, w.audit) AS k
FROM convs c LEFT JOIN size s ON s.conv_id IS NOT DISTINCT FROM c.conv_id JOIN way w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = coalesce(s.n, 0) AND w.q IN (0, 3))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(repaired) AS repaired_sha256
FROM ended e LEFT JOIN size s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN bad b ON b.conv_id IS NOT DISTINCT FROM e.conv_id WHERE k = 1
"""
