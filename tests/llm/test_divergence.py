import random
import re
from collections import Counter

import pytest

from quarry.llm import divergence
from quarry.llm.divergence import Transducer, source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall(lowered(text))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in df.items() if n >= least), key=lambda t: t.encode())
        counts = {s: Counter() for _, s, _ in own}
        for _, s, words in own:
            counts[s].update(w for w in words if df[w] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms, 1)}
    return out


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "alp", "alpha", "beta", "ΒΗΤΑ", "bêta", "日本", "x\x00y", "be ta", "gamma-ray", "z", "Zed", "rare%d"]
    texts = [" ".join(w % rng.randrange(n) if "%" in w else w for w in rng.choices(words, k=rng.choice([0, 1, 5, 30]))) for _ in range(n)]
    rows = [(rng.choice(["en", "en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "ç", "c", "d", None]), t) for t in texts]
    return [*rows, *rows[:5], ("en", "e", None), ("en", "f", ""), ("xx", "one", "only 1 document"), ("yy", "one", ""), ("yy", "two", "9 9"), ("en", "a", "beta alp " * 50_000)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    """With small blocks there are several transducers, rounds, stretches of ordinals and buckets of sources."""
    if small:
        for name, value in (("TERMS_EACH", 3), ("SENT", 300), ("ORDINALS", 2), ("SOURCES", 2)):
            monkeypatch.setattr(divergence, name, value)
    rows = some_rows(1, 120)
    docs = spark.createDataFrame([(i, *r, "t", 7) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, total int").repartition(3)
    got = [tuple(r) for r in source_divergence(docs, least=6, top=3).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 6, 3)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert source_divergence(docs).collect() == []


def test_transducer_is_minimal_and_orders():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices("abcé", k=rng.randrange(1, 7))).encode() for _ in range(300)} | {b"a" * 500})
    t = Transducer.from_bytes(Transducer(terms).to_bytes())
    assert list(t.terms()) == terms
    ends = {x[:k]: None for x in terms for k in range(len(x) + 1)}
    languages = {frozenset(x[len(p) :] for x in terms if x.startswith(p)) for p in ends}
    assert len(t.final) == len(languages)
    asked = [*terms, b"", b"zz", b"a" * 499, b"a" * 501, b"ab", *(x + b"q" for x in terms[:50]), *(x[:-1] for x in terms[:50])]
    data = divergence.np.frombuffer(b" ".join(asked), divergence.np.uint8)
    lengths = divergence.np.array([len(x) for x in asked])
    starts = divergence.np.cumsum(divergence.np.r_[0, lengths[:-1] + 1])
    place = {x: k for k, x in enumerate(terms)}
    assert t.ordinals(data, starts, lengths).tolist() == [place.get(x, -1) for x in asked]
    assert Transducer([]).ordinals(data, starts, lengths).max() == -1
