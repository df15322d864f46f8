import hashlib
import random

import pytest

from quarry.llm.line_dedup import line_dedup


def chunks(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (h[i] + 31 * (h[i - 1] if i > 0 else 0) + 961 * (h[i - 2] if i > 1 else 0)) % 4 == 0:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


@pytest.mark.parametrize("key_bits", [64, 3])
def test_against_brute_force(spark, key_bits):
    rng = random.Random(4)
    block = [f"shared line {k}" for k in range(40)]
    rows = [(1, None, 5), (2, "", 5), (3, "\n\n\n", 5), (4, "\n\n\n", 5), (7, "a\nb" * 9000, 5)]
    for i in range(10, 60):
        own = [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(9))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + block[rng.randrange(20) : 40] + own[at:]), 5))
    rows += [(60, rows[20][1], 5), (61, rows[20][1], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, no int").repartition(4)
    seen, want = set(), []
    for i, t, _ in sorted(rows):
        cut, kept, gone, lines = chunks(t), [], 0, 0
        for c in cut:
            body = "\n".join(c)
            if len(c) >= 2 and body in seen:
                gone, lines = gone + 1, lines + len(c)
            else:
                kept.append(body)
            if len(c) >= 2:
                seen.add(body)
        want.append((i, len((t or "").split("\n")), len(cut), gone, lines, "\n".join(kept)))
    assert sorted(map(tuple, line_dedup(docs, key_bits=key_bits).collect())) == want


def test_repeated_rows_and_empty(spark):
    text = "\n".join(f"line {k}" for k in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (None, "x"), (9, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"] == text) for r in line_dedup(docs).collect()), key=str)
    assert got == [(5, True), (5, True), (9, False), (None, False)]
    assert line_dedup(docs.limit(0)).count() == 0
