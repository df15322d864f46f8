import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm.conversation_repair import PIECE, STEP, cheapest, damaged, linked, links, repair, repaired_messages

GAP = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edits(code, q):
    """(cost, edit, state) of what may be done with a row."""
    yield 3, "D", q
    if code != "x":
        extra = code.isupper()
        yield from ((extra, "K", t) for (p, c), t in STEP.items() if p == q and c == code.lower())
        yield from ((2 + extra, "R", t) for (p, c), t in STEP.items() if p == q and c != "s")


def inserts(ways):
    for _ in range(3):
        for q, (cost, audit) in list(ways.items()):
            for (p, c), t in STEP.items():
                if p == q and c != "s":
                    ways[t] = min(ways.get(t, (9**9, "")), (cost + 2, audit + "I"))
    return ways


def plain(codes, start=0):
    """Least (cost, audit) of every state, row by row."""
    ways = inserts({start: (0, "")})
    for code in codes:
        new = {}
        for q, (cost, audit) in ways.items():
            for price, edit, t in edits(code, q):
                new[t] = min(new.get(t, (9**9, "")), (cost + price, audit + edit))
        ways = inserts(new)
    return ways


@pytest.mark.parametrize("seed", range(4))
def test_bidirectional_search_equals_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(250):
        codes = "".join(rng.choices("suaoUAx", weights=(1, 4, 4, 1, 2, 2, 2), k=rng.randrange(1, 12)))
        for start in range(4):
            ways = plain(codes, start)
            assert [cheapest(codes, start, end) for end in range(4)] == [ways.get(end) for end in range(4)]


def test_pieces_link_to_the_whole():
    rng = random.Random(9)
    for _ in range(100):
        codes = "".join(rng.choices("suaoUAx", k=rng.randrange(1, 40)))
        cuts = sorted(rng.sample(range(len(codes) + 1), min(4, len(codes))))
        parts = [p for p in (codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])) if p]
        cost, audits = linked([links(p, False) for p in parts])
        whole = plain(codes)
        assert (cost, "".join(a for _, a in audits)) == min(whole[0], whole[3]) if 3 in whole else whole[0]


def broken(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        for _ in range((fault != 0) + (fault == 3)):
            yield conv, turn, "user" if fault == 4 else role, text


def brute(rows, convs):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv in convs:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
        seen, codes, faults = set(), "", [0, 0, 0]
        for _, _, role, text in own:
            kind = 0 if not text.strip(GAP) else 1 if (role, text) in seen else 2 if text.strip(GAP)[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                faults[kind] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if kind < 2 else code.upper() if kind == 2 else code
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = {r[1] for r in own} - {None}
        ways = plain(codes)
        cost, audit = min(w for q, w in ways.items() if q in (0, 3))
        state, at, lines = 0, 0, []
        for edit in audit:
            role, text = (None, "") if edit == "I" else own[at][2:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == 2 else "user"
                state = STEP[state, role[:1]]
                lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, sha("\n".join(lines)))
    return out


def some_rows():
    rng = random.Random(2)
    texts = ["Fine.", "Yes!", "cut off", "", " \n\t", None, "Fine. ", "what?", "x\x1c.", "\x85", "end. \n", "no end\n", "long " * 3000 + ".", "été"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 7, None, 0]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, t, r, x) for t, r, x in ((0, "user", "Hi."), (1, "assistant", "Ho."), (1, "assistant", "Ho."), (None, None, None))]
    rows += [(1000, t, rng.choice(roles[:6]), rng.choice(texts[:4]) if t % 5 == 0 else f"say {t}{rng.choice('.?!x')}") for t in range(3 * PIECE)]
    rows += [(1001, 7, "user", "same.")] * (3 * PIECE) + [(1001, 8, "assistant", "other.")]
    return [*rows, *rows[:30], (1002, 0, "assistant", "Only this.")]


def test_damaged_conversations(spark):
    rows = some_rows()
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(5)
    hurt = damaged(table)
    assert sorted(map(tuple, hurt.collect()), key=str) == sorted(broken(rows), key=str)
    got = repair(hurt, table).collect()
    assert len(got) == len({r[0] for r in got})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(list(broken(rows)), {r[0] for r in rows})


def test_repaired_messages_fit_the_pattern(spark):
    rows = [(str(c), *r) for c, *r in some_rows() if c is not None]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    told = defaultdict(list)
    for r in repaired_messages(table).collect():
        told[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in repair(table).collect()}
    for conv, lines in told.items():
        lines.sort()
        assert re.fullmatch("s?(ua)+", "".join(role[:1] for _, role, _ in lines))
        assert sha("\n".join(f"{role}:{text}" for _, role, text in lines)) == hashes[conv]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damaged(none), none).collect() == []
    one = spark.createDataFrame([(5, 1, "user", "x")], none.schema)
    assert [tuple(r) for r in repair(none, one).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]
