import itertools
import random

import pytest

import quarry.llm.near_copies as n
from tests.llm.test_simhash import brute_components


def brute_sets(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_groups(texts):
    """Component of each text by all pairs of different sets of shingles."""
    own = [brute_sets(t) for t in texts]
    number = {s: k for k, s in enumerate(dict.fromkeys(own))}
    sets = list(number)
    group = brute_components(range(len(sets)), lambda a, b: similar(sets[a], sets[b]))
    return [group[number[s]] for s in own]


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    texts = [None, "", " ", "One two", "one TWO", "one two three"]
    for k in (6, 9, 14, 30, 60, 120, 400):
        base = prose(k)
        texts.append(" ".join(base))
        texts.append(" ".join([*base, "more"]))
        for edits in (1, 2, 3, 6, 12):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(k)] = rng.choice(words)
            texts.append(" ".join(own))
            texts.append(" ".join(own[: k - k // 8]))
    crowd = prose(100)
    for _ in range(40):  # copies of one text that are mostly further from each other than from it
        own = list(crowd)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(100)] = rng.choice(words)
        texts.append(" ".join(own))
    passage = prose(40)
    texts += [" ".join([*passage, *prose(rng.randrange(5, 30))]) for _ in range(40)]
    return texts


def test_shingles():
    assert len(n.shingles("", 5)) == 0 and len(n.shingles("a b", 5)) == 1 and len(n.shingles("A b c d e f", 5)) == 2
    for text in corpus(3):
        assert len(n.shingles(text or "", 5)) == len(brute_sets(text))


def test_sketches_that_differ_in_three_positions_meet():
    rng = random.Random(1)
    for gone in itertools.combinations(range(n.POSITIONS), n.RADIUS):
        assert any(not any(m[k] for k in gone) for m in n.SKETCH_MASKS)
    near = far = 0
    for _ in range(300):
        shared = [rng.getrandbits(64) for _ in range(160)]
        a, b = (n.bucket_keys(n.np.array(sorted(shared + [rng.getrandbits(64) for _ in range(20)]), n.np.uint64)) for _ in range(2))
        near += bool(set(a.tolist()) & set(b.tolist()))
        c, d = (n.bucket_keys(n.np.array(sorted(shared[:60] + [rng.getrandbits(64) for _ in range(60)]), n.np.uint64)) for _ in range(2))
        far += bool(set(c.tolist()) & set(d.tolist()))
    assert near >= 0.9 * 300 and far <= 0.1 * 300  # of similarity 0.8, and of a third


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    rows = [(None if i == 7 else 1000 - i, t, "clash", 5) for i, t in enumerate(texts)] + [(1000 - 9, texts[9], "clash", 5), (1000 - 9, "another text", "clash", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, keys int").repartition(3)
    group = brute_groups([r[1] for r in rows])
    least = {}
    for (i, *_), g in zip(rows, group):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    got = n.near_copies(docs).collect()
    ids = sorted(((r["doc_id"], r["component_id"]) for r in got), key=str)
    want = sorted(((i, least[g]) for (i, *_), g in zip(rows, group)), key=str)
    assert len(ids) == len(want)
    missed = [w for g, w in zip(ids, want) if g != w]
    assert len(missed) <= 0.02 * len(want), missed
    kept = {}
    for r in got:
        kept.setdefault(r["component_id"], set()).update({(r["doc_id"], r["row"])} if r["kept"] else ())
    assert all(kept.values()) and (missed or sum(map(len, kept.values())) == len(set(group)))
    assert n.near_copies(docs.limit(0)).count() == 0


def test_recall_on_given_documents(spark):
    """Links between texts of the given table, against all pairs with a shingle in common."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own = {i: brute_sets(t) for i, t in texts.items()}
    holders = {}
    for i, s in own.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() if 1 < len(h) <= 200 for p in itertools.combinations(h, 2)}
    want = {(a, b) for a, b in pairs if own[a] != own[b] and similar(own[a], own[b])}
    component = {r["doc_id"]: r["component_id"] for r in n.near_copies(docs).collect()}
    found = sum(component[a] == component[b] for a, b in want)
    assert want and found >= 0.9 * len(want), (found, len(want))
    assert all(component[i] <= i for i in texts)


def test_members_of_a_large_group_meet_in_blocks(spark, monkeypatch):
    """A group of 2,000 edited copies: components as by checking every pair, whatever the rounds find."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]
    base = [rng.choice(words) for _ in range(100)]
    texts = []
    for _ in range(2000):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(100)] = rng.choice(words)
        texts.append(" ".join(own))
    sets = list(dict.fromkeys(n.shingles(t, 5).tobytes() for t in texts))
    own = [n.np.frombuffer(s, n.np.uint64) for s in sets]
    known = {h: k for k, h in enumerate(sorted({h for s in own for h in s.tolist()}))}
    grid = n.np.zeros((len(own), len(known)), n.np.float32)
    for k, s in enumerate(own):
        grid[k, [known[h] for h in s.tolist()]] = 1
    shared, size = grid @ grid.T, grid.sum(axis=1)
    near = shared >= 0.8 * (size[:, None] + size[None, :] - shared)
    group = brute_components(range(len(own)), lambda a, b: bool(near[a, b]))
    # all members in one bucket, no rounds before: every link has to come from the blocks
    node = {s: n.node_of(own[k]) for k, s in enumerate(sets)}
    held = spark.createDataFrame([(node[s], own[k].view(n.np.int64).tolist()) for k, s in enumerate(sets)], "node long, hashes array<long>")
    now = spark.createDataFrame([(1, node[s], len(own[k]), len(own[k]), node[s]) for k, s in enumerate(sets)], "key long, node long, n int, core long, c long")
    now = now.union(now.selectExpr("key + 1", "node", "n", "core", "c"))
    monkeypatch.setattr(n, "BLOCK", 30_000)
    links = n.links_of_blocks(now, held, 0.8)
    comp = {r["node"]: r["c"] for r in n.merged(now.select("node", "c").distinct(), links).collect()}
    label = {}
    for k, s in enumerate(sets):
        assert label.setdefault(group[k], comp[node[s]]) == comp[node[s]]
    assert len(set(label.values())) == len(label) < len(sets)


def test_a_large_group_forms_no_pairs(spark, monkeypatch):
    """Pairs that are checked one by one are those with the leaders of two rounds, however many members stay apart."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(own))
    asked = []
    checked = n.checked
    monkeypatch.setattr(n, "checked", lambda pairs, *rest: asked.append(pairs.count()) or checked(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert n.near_copies(docs).count() == len(texts)
    keys = sum(len(n.bucket_keys(n.shingles(t, 5))) for t in texts)
    assert len(asked) <= 2 and sum(asked) <= len(texts) + keys, (asked, keys)
