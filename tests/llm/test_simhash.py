import itertools
import random

import pytest
import xxhash

from quarry.llm.components import components
from quarry.llm.simhash import links, masks, near_duplicates, signed, simhash


def brute_simhash(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 254, 257, 258, 17000])
def test_fingerprint(n):
    rng = random.Random(n)
    words = [b"%d" % rng.randrange(50) for _ in range(n)]
    assert simhash(words, 3) == brute_simhash(b" ".join(words).decode())


def test_every_pair_of_bits_is_hidden_by_some_table():
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks())


@pytest.mark.parametrize("small", [16, 0, 3])
def test_links_against_brute_force(spark, small):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            prints.add(signed(x))
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
    rows = spark.createDataFrame([(x,) for x in prints], "fingerprint long")
    got = {r["node"]: r["component"] for r in components(links(rows, small=small)).collect()}
    want = brute_components(prints, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {x: got.get(x, x) for x in prints} == want


def test_long_chain(spark):
    n = 300
    order = random.Random(5).sample(range(n), n)
    edges = spark.createDataFrame([*zip(order, order[1:]), (order[0], order[0])], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(x, 0) for x in range(n)}
    assert components(edges.limit(0)).count() == 0


def test_documents(spark):
    rng = random.Random(7)
    base = [" ".join(str(rng.randrange(99)) for _ in range(n)) for n in (1, 2, 3, 40, 400, 4000)]
    texts = [None, "", " \n", "A b", "a B", *base, *(b + " tail" for b in base), *(b.replace("7", "8", 1) for b in base), "x " * 50_000]
    rows = [(None if i == 4 else 1000 - i, t, "z") for i, t in enumerate(texts)] + [(1000 - 7, texts[7], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    prints = [brute_simhash(t) for _, t, _ in rows]
    group = brute_components(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _, _), f in zip(rows, prints):
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    assert got == sorted(((i, f"{f:016x}", least[group[f]]) for (i, _, _), f in zip(rows, prints)), key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
