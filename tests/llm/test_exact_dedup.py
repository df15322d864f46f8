import hashlib
import random
import re

import pytest

from quarry.llm.exact_dedup import directory, drop_copies, exact_groups, owners


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_directory(capacity):
    rng = random.Random(capacity)
    cells = {rng.randrange(256): rng.randrange(1, 9) for _ in range(90)}
    depth, slots = directory(cells, capacity, 8)
    assert len(slots) == 1 << depth
    held = {}
    for cell, n in cells.items():
        held[slots[cell & (1 << depth) - 1]] = held.get(slots[cell & (1 << depth) - 1], 0) + n
    assert all(n <= capacity or depth == 8 for n in held.values())
    assert directory({}, capacity, 8) == (0, [0])


def test_owners():
    assert owners([5, 5, 5, 5], 2) == [0, 0, 1, 1] and owners([0], 3) == [0]
    own = owners([1, 90, 1, 1, 1, 1, 1], 4)
    assert own == sorted(own) and max(own) <= 3


ROWS = [(9, "a b"), (3, "a  \n b"), (3, "a b"), (None, "a\tb"), (5, None), (4, ""), (None, "only"), (None, "only"), (7, " a b"), (8, "a b"), (1, "x " * 40_000), (2, "x\n" * 40_000), (2, "x\n" * 40_000)]


@pytest.mark.parametrize("key_bits, capacity", [(64, 4096), (64, 3), (5, 1), (2, 4096), (0, 4096)])
def test_groups(spark, key_bits, capacity):
    rows = [(i, t, "clash") for i, t in ROWS] + [(100 + k, f"text {k % 30}", "clash") for k in range(90)] + [(None if k % 2 else 500 + k, "hot  text", "clash") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, _ in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_groups(docs, key_bits=key_bits, capacity=capacity).collect()), key=str) == sorted(want, key=str)


def test_drop_copies(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, norm int")
    got = drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([3, 4, 7, 8, 1, None], key=str)
    assert exact_groups(docs.limit(0)).count() == 0 and drop_copies(docs.limit(0)).count() == 0
    once = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["a b", "a\tb", None, "", " ", "c"])], "doc_id long, text string, __sha int")
    assert sorted((r["doc_id"] for r in drop_copies(once).collect())) == [0, 2, 4, 5] and drop_copies(once).columns == once.columns
