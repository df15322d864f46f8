import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.packing import pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def first_fit_decreasing(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        for k, f in enumerate(free):
            if f >= x:
                free[k] -= x
                break
        else:
            free.append(capacity - x)
    return len(free)


@pytest.mark.parametrize("kind", ["one", "small", "pairs", "mixed", "hot", "none"])
def test_plan(kind):
    rng = random.Random(kind)
    lengths = {
        "one": [2048],
        "small": [1] * 5000,
        "pairs": [rng.randrange(900, 1300) for _ in range(800)],
        "mixed": [min(2048, int(rng.paretovariate(1) * 40)) for _ in range(3000)],
        "hot": [700] * 1000 + [rng.randrange(1, 2049) for _ in range(1000)],
        "none": [],
    }[kind]
    histogram = np.bincount(lengths, minlength=2049)
    planned = plan(histogram, 2048)
    used = np.zeros(2049, np.int64)
    for own, times in planned:
        assert sum(own) <= 2048
        for x in own:
            used[x] += times
    assert (used == histogram).all()
    assert sum(t for _, t in planned) <= 1.01 * first_fit_decreasing(lengths, 2048) + 1


def test_pack(spark):
    rng = random.Random(1)
    texts = [None, "", *(" ".join(rng.choice(["alpha", "béta", "x1", "!"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)), "word " * 20_000, "word " * 2047, "same", "same"]
    rows = [(None if k == 5 else k - k % 2 * (k > 60), t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = pack(docs, PATH).collect()
    library, want = Tokenizer.from_file(PATH), []
    for doc_id, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= 1.02 * sum(w[3] for w in want) / 2048 + 1
    assert pack(docs.limit(0), PATH).count() == 0
