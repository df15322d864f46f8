import random
import re
from re import _constants as kind
from re import _parser as parser

import pytest

from quarry.llm.licenses import BASE, Place, license_digest, license_scan, rules, scan, settled

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lowered(text))
    places = [(k, label) for label, phrase in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    firsts = [k for k, _ in places]
    return len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "", None, " \t", "Under the MIT License", "under-the_MIT  license, under the mit license", "under the mit\nlicence", "UNDER THE ﬁMIT LICENSE", "Apache License, Version 2.0", "apache license version 22", "CC BY-NC 4.0 cc by nc sa",
    "x\x00cc\x7fby nc", "mit der Lizenz", "under the mit license " * 4000, "a " * 100_000 + "cc by nc", "wundercc by nc", "été cc by ncé", "This work is licensed under the GNU General Public License, version 3.",
]


def test_documents(spark):
    rows = [(None if i == 3 else i % 11, t, "x", 5) for i, t in enumerate([*TEXTS, "same", "same"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, detections int")
    got = license_digest(license_scan(docs)).collect()
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and r["labels"].split(",") == sorted(set(r["labels"].split(",")))
    assert license_scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3 or later.", {"gpl-3"}),
        ("released under the terms of the GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("see https://www.apache.org/licenses/LICENSE-2.0", {"apache-2"}),
        ('"license": "MIT"', {"mit"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("Mozilla Public License 2.0", {"mpl-2"}),
        ("creativecommons.org/licenses/by-sa/4.0", {"cc-by-sa"}),
        ("GPLv3 license: GPLv3", {"gpl-3"}),
        ("ein Text mit Lizenz, all rights reserved, common public works, an open software shop", set()),
    ],
)
def test_labels(text, labels):
    assert {rules()[p.order].label for p in scan(text.encode())[2]} == labels


def example(tree, rng):
    out = ""
    for op, value in tree:
        if op is kind.LITERAL:
            out += chr(value)
        elif op is kind.NOT_LITERAL:
            out += "w"
        elif op is kind.IN:
            op, value = rng.choice(value)
            out += "7" if op is kind.CATEGORY else chr(rng.randint(*value) if op is kind.RANGE else value)
        elif op is kind.BRANCH:
            out += example(rng.choice(value[1]), rng)
        elif op is kind.SUBPATTERN:
            out += example(value[3], rng)
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
            out += "".join(example(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 3))))
        else:
            assert op is kind.ASSERT
    return out


def test_keywords_hide_no_match():
    """Whatever a rule matches has its words, so that the gate never closes on a match."""
    rng = random.Random(5)
    assert len(rules()) > 300
    for rule in rules():
        for _ in range(30):
            text = example(parser.parse(rule.pattern.pattern.decode()), rng)
            assert rule.pattern.search(f" {text.strip()} ".encode())
            words = set(text.encode().split())
            assert rule.needs and all(not n.isdisjoint(words) for n in rule.needs), (rule.label, rule.form, text)


def test_suppression():
    rng = random.Random(7)
    for _ in range(300):
        places = [Place(a, a + rng.randint(1, 6), rng.randrange(8)) for a in (rng.randrange(20) for _ in range(rng.randrange(15)))]
        left = []
        for p in sorted(set(places), key=lambda p: (p.order, p.first - p.end, p.first)):
            inside = lambda a, b: b.first <= a.first and a.end <= b.end
            if not any(inside(p, q) or inside(q, p) for q in left):
                left.append(p)
        assert settled(places, 6) == left
