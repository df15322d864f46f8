import random

import pytest

import quarry.llm.decontamination as d


def vocabulary(n=400):
    rng = random.Random(9)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


@pytest.mark.parametrize("sifted", [d.SIFTED, 0])
def test_planted(spark, monkeypatch, sifted):
    monkeypatch.setattr(d, "SIFTED", sifted)
    rng, words = random.Random(1), vocabulary()

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    question = "A train with 12 wagons leaves for Boston at 40 km per hour while 12 other wagons wait near Boston and need 7 minutes more. How late is the train"
    changed = question.replace("12", "35").replace("Boston", "Denver").replace("40 km", "90 miles").replace("7", "8")
    broken = question.replace("12 other", "99 other").replace("near Boston", "near Madrid").replace("for Boston", "for Lisbon")
    plain = prose(40)
    items = spark.createDataFrame([(1, question, 0), (2, plain, 0), (3, "one short item here", 0), (4, None, 0), (5, "", 0), (6, plain.replace(" ", "\n"), 0)], "item_id long, text string, hash int")
    edited = plain.split()
    edited.insert(20, "extra")
    rows = [
        (1, f"{prose(50)}. {question}. {prose(9)}"), (2, f"{prose(50)}. {changed}. {prose(9)}"), (3, f"{prose(50)}. {broken}. {prose(9)}"), (4, f"{prose(300)} {' '.join(edited)} {prose(30)}"),
        (5, " ".join(plain.split()[:12])), (6, None), (7, ""), (8, f"x {prose(20_000)}"), (9, "Say One short item HERE!"), (None, plain.upper()), (10, f"{question}. Then. {changed}"), (10, plain), (10, plain),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows] + [(100 + k, prose(rng.randrange(5, 200)), 0) for k in range(50)], "doc_id long, text string, slots int")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in d.leaks(docs, items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (4, 2): True, (4, 6): True, (9, 3): True, (None, 2): True, (None, 6): True, (10, 1): False, (10, 2): True, (10, 6): True}
    kept = d.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7, 8, *range(100, 150)]
    # each row by its own text: a clean row stays beside a leaking one of its id
    twice = spark.createDataFrame([(1, question, 0), (1, "nothing of the kind", 1), (None, plain, 2), (None, "clean", 3)], "doc_id long, text string, __row int")
    assert sorted(r["__row"] for r in d.without_leaks(twice, items).collect()) == [1, 3]
    assert d.leaks(docs.limit(0), items).count() == 0 == d.leaks(docs, items.limit(0)).count()


@pytest.mark.parametrize("sifted", [d.SIFTED, 0])
def test_items_of_slots_are_found_verbatim(spark, monkeypatch, sifted):
    monkeypatch.setattr(d, "SIFTED", sifted)
    rows = "Add 17, 23, 42, 65, 81, 90 and 104."
    names = "Paris Rome Lima Oslo Bern Cairo Quito Delhi Tokyo"
    items = spark.createDataFrame([(1, rows), (2, names), (3, "7 8")], "item_id long, text string")
    texts = [f"First some words. {rows} And more.", rows.replace("42", "43").replace("81", "82"), f"towns like {names} lie far apart", "Lima Rome Oslo Paris Cairo Bern Delhi Quito Tokyo", "from 7 8 times", "from 7 9 times", "Add 1, 2, 3 and 4."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["coverage"], r["verbatim"]) for r in d.leaks(docs, items).collect()} == {(0, 1, 1.0, True), (2, 2, 1.0, True), (4, 3, 1.0, True)}


@pytest.mark.parametrize("sifted", [d.SIFTED, 0])
def test_parts_and_edited_items_are_leaks(spark, monkeypatch, sifted):
    monkeypatch.setattr(d, "SIFTED", sifted)
    rng, words = random.Random(4), vocabulary()
    items = {n: rng.sample(words, n) for n in (11, 13, 15, 16, 17, 18, 22, 40)}
    docs, want = [], {}

    def put(text, n, leaks):
        docs.append((len(docs), f"{' '.join(rng.sample(words, 30))} zzz {' '.join(text)} zzz {' '.join(rng.sample(words, 30))}"))
        want[len(docs) - 1] = {n} if leaks else set()

    for n in (11, 13, 15, 16, 17, 18, 22):
        for k in range(n):
            put(items[n][:k] + ["other"] + items[n][k + 1 :], n, True)
            put(items[n][:k] + ["other"] + items[n][k:], n, True)
        put(items[n][: 7 if n < 16 else 6], n, False)
    for n in (12, 13, 19):
        put(items[40][11 : 11 + n], 40, n >= 13)
    put([w for k in range(0, 9, 3) for w in [*items[11][k : k + 3], *rng.sample(words, 40)]], 11, False)
    got = {i: set() for i in want}
    for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect():
        got[r["doc_id"]].add(r["item_id"])
    assert {i: (got[i], want[i], docs[i][1]) for i in want if got[i] != want[i]} == {}


def test_short_items_are_marked(spark):
    items = spark.createDataFrame([(1, "the"), (2, "red hen"), (3, "one red hen")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the fox and one red hen"), (2, "the end")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["short"]) for r in d.leaks(docs, items).collect()) == [(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, True)]
    assert [r["doc_id"] for r in d.without_leaks(docs, items).collect()] == [2]


def brute_tokens(text):
    """(template token, value, is a slot) of each word, from the rules."""
    out, number_before, start = [], False, True
    for word in text.split():
        own = d.bare(word)
        if not own:
            continue
        low = own.lower()
        number = bool(d.NUMBER.fullmatch(own)) or low in d.NUMBERS
        unit = low in d.UNITS and number_before and not number
        name = own[:1].isupper() and own[1:] == own[1:].lower() and not start and not number and not unit
        out.append(("<n>" if number else "<u>" if unit else "<p>" if name else low, low, number or unit or name))
        number_before, start = number, bool(d.ENDS.search(word))
    return out


def brute_leaks(text, item):
    """(coverage, verbatim) if the text leaks the item, by comparing windows word for word."""
    own, asked = brute_tokens(text), brute_tokens(item)
    n = len(asked)
    if not n:
        return None
    is_literal = lambda part: 2 * sum(t[2] for t in part) <= len(part)
    diagonals = {}
    main = min(n, d.WINDOW)
    for size in d.sizes_of(n):
        for k in range(n - size + 1):
            part = asked[k : k + size]
            for at in range(len(own) - size + 1):
                other = own[at : at + size]
                literal = is_literal(part)
                # windows of mostly slots are compared by their values
                hit = [t[0] for t in part] == [t[0] for t in other] and is_literal(other) if literal else [t[1] for t in part] == [t[1] for t in other]
                if hit:
                    found = diagonals.setdefault(at - k, (set(), set()))
                    found[0].add((k, size, literal and size == main))
                    found[1].update((t[1], t[1] if not literal else o[1]) for t, o in zip(part, other) if t[2])
    places = sum(is_literal(asked[k : k + main]) for k in range(n - main + 1))
    regions = {}
    for diagonal, (found, pairs) in diagonals.items():
        values = len({a for a, _ in pairs})
        if 2 * values - len(pairs) < d.CONSISTENT * values:
            continue
        longest, begin, end = 0, -1, -1
        for k, size, _ in sorted(found):
            begin = begin if k <= end else k
            end = max(end, k + size)
            longest = max(longest, end - begin)
        for region in [0] if n >= 2 * d.WINDOW else [2 * (diagonal // (2 * n)), 2 * ((diagonal + n) // (2 * n)) + 1]:
            r = regions.setdefault(region, [set(), 0, True])
            r[0] |= found
            r[1] = max(r[1], longest)
            r[2] &= all(a == b for a, b in pairs)
    out = []
    for found, longest, same in regions.values():
        covered = len({x for k, size, _ in found for x in range(k, k + size)})
        coverage = max(covered / n, len({k for k, _, counts in found if counts}) / places if places else 0)
        if coverage >= d.COVERAGE and covered >= min(n, d.WINDOW) or longest >= d.RUN:
            out.append((coverage, same))
    return (max(c for c, _ in out), max(v for _, v in out)) if out else None


@pytest.mark.parametrize("sifted", [d.SIFTED, 0])
def test_against_brute_force(spark, monkeypatch, sifted):
    monkeypatch.setattr(d, "SIFTED", sifted)
    rng, words = random.Random(6), vocabulary(60)
    some = lambda k: [rng.choice([*words, str(rng.randrange(4)), rng.choice(["Rome", "Oslo"]), "km", rng.choice(words) + "."]) for _ in range(k)]
    items = {k: some(n) for k, n in enumerate([1, 2, 3, 5, 8, 9, 11, 14, 15, 16, 20, 30, 50])} | {40: ["1", "2", "3", "Oslo", "7", "Rome", "5", "6", "8", "9"]}
    docs = {}
    for i in range(160):
        own = list(rng.choice(list(items.values())))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(own) + 1)
            own[k : k + rng.randrange(3)] = some(rng.randrange(3))
        cut = rng.randrange(len(own) + 1)
        docs[i] = " ".join(some(rng.randrange(20)) + (own if i % 3 else own[cut:] + some(3) + own[:cut]) + some(rng.randrange(9)))
    want = {}
    for i, text in docs.items():
        for k, item in items.items():
            if found := brute_leaks(text, " ".join(item)):
                want[i, k] = (round(found[0], 9), found[1])
    got = d.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), r["verbatim"]) for r in got.collect()} == want
    assert len(want) > 150
