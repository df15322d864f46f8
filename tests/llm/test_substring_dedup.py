import random

import numpy as np
import pytest

from quarry.llm.substring_dedup import internal_nodes, maximal_repeats, shared_prefixes, substring_dedup


def brute_force(rows, window):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        if i is not None:
            for k in range(len(words) - window + 1):
                w = tuple(words[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        if i is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        left = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), len(words) - len(left), b" ".join(left).decode()))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(3 * window)]
    base = [f"b{rng.randrange(40)}" for _ in range(6 * window)]
    rows = [(1, None), (2, ""), (3, "w " * 700), (4, "w " * 900), (5, "a b " * 300), (None, " ".join(passage)), (900, "été ñ\x1cü\xa0x " * window)]
    for i in range(10, 70):
        own = [f"o{rng.randrange(8)}" for _ in range(rng.randrange(3 * window))]
        at = rng.randrange(len(own) + 1)
        cut = sorted(rng.sample(range(3 * window), 2))
        rows.append((i, " ".join(own[:at] + passage[cut[0] : cut[1]] + own[at:]) + rng.choice(["", " \n", "\t"])))
    for i in range(100, 130):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(7, rows[40][1]), (7, rows[40][1]), (12, rows[50][1]), (12, " ".join(base)), (500, "y " * 20_000 + " ".join(base))]
    return rows


@pytest.mark.parametrize("seed, most", [(1, 1_000_000), (2, 2), (3, 40)])
def test_against_brute_force(spark, seed, most):
    window, rows = 20, corpus(seed, 20)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    got = substring_dedup(docs, window=window, k=5, group=most, least_group=1).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_force(rows, window), key=str)


def test_production_window_and_empty(spark):
    rows = corpus(4, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == sorted(brute_force(rows, 50), key=str)
    assert substring_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_internal_nodes_against_brute_force(seed):
    rng = random.Random(seed)
    rows = sorted(tuple(rng.randrange(2 + seed % 2) for _ in range(5)) for _ in range(rng.choice([1, 2, 40])))
    symbols = np.array(rows)
    for cut in (0, len(rows) // 2):  # in one piece, and after what came before
        shared = shared_prefixes(symbols[cut:], symbols[cut - 1] if cut else None)
        assert shared.tolist() == [next((d for d in range(5) if rows[i][d] != rows[i - 1][d]), 5) if i else 0 for i in range(cut, len(rows))]
    want = set()
    for depth in range(1, 6):
        for prefix in {r[:depth] for r in rows}:
            under = [i for i, r in enumerate(rows) if r[:depth] == prefix]
            # a node branches below its depth, or its leaves end there
            if len(under) > 1 and (depth == 5 or len({rows[i][depth] for i in under}) > 1):
                want.add((depth, under[0], under[-1]))
    assert set(internal_nodes(shared_prefixes(symbols))) == want


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_maximal_repeats_against_brute_force(spark, most):
    window, rows = 20, [r for r in corpus(6, 20) if r[0] is not None]
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, i), i)
    want = []
    for i, text in set(rows):
        words = (text or "").encode().split()
        hit = [first[tuple(words[k : k + window])] < i for k in range(len(words) - window + 1)]
        for k in range(len(hit)):
            if hit[k] and not (k and hit[k - 1]):
                end = next((j for j in range(k, len(hit)) if not hit[j]), len(hit)) - 1
                want.append((i, k, end - k + window, b" ".join(words[k : end + window]).decode()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = maximal_repeats(docs, window=window, k=5, group=most, least_group=1).distinct()
    assert sorted((r["doc_id"], r["start"], r["n_words"], r["passage"]) for r in got.collect()) == sorted(want)
    assert maximal_repeats(docs.limit(0)).count() == 0
