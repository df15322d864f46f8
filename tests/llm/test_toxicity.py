import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array

from quarry.llm.toxicity import ADDRESS, EDGE, INNER, INSULTS, LOOKALIKES, NAMES, Lexicon, featured, features, score, terms, toxicity, train, without_toxic


def corpus(n=500, seed=2):
    rng, rows, labels = random.Random(seed), [], []
    calm = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = [rng.choice(calm) for _ in range(rng.randrange(5, 80))]
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorkable", "zorkish", "You MORON!"]))
        rows.append((i, " ".join(words), toxic))
        labels.append((i, 1, toxic))
    return rows, labels


def test_features():
    lexicon = Lexicon({"^zor": 5.0})
    value = dict(zip(NAMES, features("You zork-head! id10t calm", lexicon)))
    assert value["hit_density"] == 0.5 and value["near_address"] == 1.0 and value["obfuscated"] == 0.25 and value["max_weight"] == 5.0
    assert len(features("", lexicon)) == len(NAMES)
    assert terms("abcd") == ["abcd$", "^ab", "^abc", "^abcd"]


def brute_features(text, weights):
    """Every feature from its definition, word by word."""
    once = {t: w for t, w in weights.items() if t[0] != "2"}
    words = text.lower().split()
    n, per = len(words), max(len(words), 1)
    weight, fixed, hidden, best = [], [], [], []
    for raw in words:
        word = EDGE.sub("", raw)
        known, bad = terms(word), word in INSULTS
        obfuscated = bool(word and INNER.search(word))
        if obfuscated:
            plain = re.sub(r"[\W\d_]", "", word.translate(LOOKALIKES))
            known, bad = known + terms(plain), bad or plain in INSULTS
        weight.append(int(16 * max(once.get(t, 0.0) for t in known)) / 16)
        fixed.append(bad)
        hidden.append(obfuscated)
        second = [t for t in known if "2" + t in weights]
        best.append(min(second, key=lambda t: (-weights["2" + t], t)) if second else None)
    hit = [w > 0 or f for w, f in zip(weight, fixed)]
    to = [EDGE.sub("", w) in ADDRESS for w in words]
    near = [any(to[max(0, k - 5) : k + 6]) for k in range(n) if hit[k]]
    twice = [weights["2" + t] for t, c in Counter(best).items() if t and c > 1]
    letters = [c for c in text if c.isascii() and c.isalpha()]
    raw = text.encode()
    return {
        "hit_density": sum(hit) / per, "sure_density": sum(w >= 2 for w in weight) / per, "strong_density": sum(w >= 4 for w in weight) / per, "fixed_density": sum(fixed) / per,
        "log_hits": math.log(1 + sum(hit)), "log_sure": math.log(1 + sum(w >= 2 for w in weight)), "log_strong": math.log(1 + sum(w >= 4 for w in weight)), "max_weight": max(weight, default=0),
        "sum_weight": sum(weight), "mean_weight": sum(weight) / per, "twice_weight": max(twice, default=0), "twice_sum": sum(twice), "near_address": sum(near) / len(near) if near and any(to) else 0,
        "address_density": sum(to) / per, "capitals": sum(c.isupper() for c in letters) / max(len(letters), 1), "punctuation": sum(32 < b < 127 and not chr(b).isalnum() for b in raw) / max(len(raw), 1),
        "exclamations": raw.count(b"!") / max(len(raw), 1), "obfuscated": sum(hidden) / per, "log_words": math.log(1 + n),
    }


def test_features_against_brute_force():
    rng = random.Random(8)
    weights = {"^zo": 1.25, "zork$": 4.5, "2^zo": 3.0, "2zork$": 2.0, "^mor": 2.5, "2^mor": 3.0, "calm$": 0.5}
    some = ["zork", "ZORKED", "zorro!", "moron", "mor-on", "m0ron", "you", "YOUR,", "calm", "été", "Ünder", "a1b", "!!", "$tupid", "x", "...", "idiot?", "12"]
    for n in (0, 1, 2, 7, 40, 300):
        text = " ".join(rng.choice(some) for _ in range(n))
        want = brute_features(text, weights)
        got = dict(zip(NAMES, features(text, Lexicon(weights))))
        assert set(got) == set(want)
        assert {k: v for k, v in got.items() if abs(v - want[k]) > 1e-9} == {}, text


def test_term_counts_and_calibration_against_brute_force(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    positive = sum(y for _, _, y in learned)
    with_term = {}
    for _, text, y in learned:
        held = Counter()
        for w in text.lower().split():
            if w := EDGE.sub("", w):
                held.update(terms(w))
        for t in [*held, *("2" + t for t, n in held.items() if n > 1)]:
            with_term.setdefault(t, [0, 0])[y] += 1
    want = {}
    for t, (c, k) in with_term.items():
        w = math.log((k + 0.5) / (positive + 1)) - math.log((c + 0.5) / (len(learned) - positive + 1)) - 1.645 * math.sqrt(1 / (k + 0.5) + 1 / (c + 0.5))
        if k >= 3 and w >= 1:
            want[t] = w
    assert set(want) == set(model.weights) and all(abs(w - want[t]) < 1e-9 for t, w in model.weights.items())
    # isotonic: pooled neighbours, then straight lines between them
    bounds, values = list(model.calibration.boundaries), list(model.calibration.predictions)
    assert bounds == sorted(bounds) and values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    ready = featured(docs, [model.weights], ["doc_id"]).withColumn("vector", array_to_vector("features"))
    margins = {r["doc_id"]: r["m"] for r in model.trees.transform(ready).select("doc_id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    for r in score(docs, model).collect():
        assert abs(r["score"] - np.interp(margins[r["doc_id"]], bounds, values)) < 1e-9


def test_held_out_accuracy_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id", "left_semi")
    got = toxicity(known, labels).where("held_out").join(labels, "doc_id").join(known.select("doc_id", "lang"), "doc_id").select("lang", "predicted", "toxic").collect()
    assert len(got) > 900
    for lang in ("en", "fr", "de", "es", None):
        own = [r for r in got if lang in (None, r["lang"])]
        caught = sum(r["predicted"] and r["toxic"] for r in own)
        assert caught >= (0.7 if lang else 0.9) * sum(r["toxic"] for r in own), lang
        if not lang:
            assert caught >= 0.9 * sum(r["predicted"] for r in own)


def test_other_labels_and_repeated_ids(spark):
    rows, labels = corpus(120, 5)
    docs = spark.createDataFrame([*(r[:2] for r in rows), (rows[1][0], "zz"), (None, "You idiot moron!"), (None, None)], "doc_id long, text string")
    known = [*labels, *((i, 1, 7) for i, _, _ in rows[:9]), (rows[3][0], 1, None), (None, 1, -1)]
    labelled = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    first, again = ({(r["doc_id"], r["score"]) for r in toxicity(d, labelled).collect()} for d in (docs, docs.repartition(5)))
    assert first == again == {(r["doc_id"], r["score"]) for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    wide = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS row", "3 AS features")
    kept = without_toxic(wide, labelled)
    assert kept.columns == wide.columns
    bad = [r for r in toxicity(docs, labelled).collect() if r["predicted"]]
    assert kept.count() == docs.count() - len(bad) and kept.where("doc_id IS NULL").count() == 1
    assert without_toxic(wide.limit(0), labelled).count() == 0


def test_held_out_accuracy_and_labels_are_not_read(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(10_000, None, 0), (10_001, "", 0), (None, "idiot", 0), (3, rows[3][1], 0)], "doc_id long, text string, score int")
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (77_777, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labelled).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) > 50
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    again = {(r["doc_id"], r["score"]) for r in toxicity(docs, other).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity(docs, labels).collect()} == {(0.0, 0)}
    assert {r["score"] for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    rows, known = corpus(60)
    model = train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, q int, toxic int"))
    assert score(docs.limit(0), model).count() == 0
