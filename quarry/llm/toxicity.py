"""Toxicity by gradient-boosted trees over dense features, calibrated (operator 2).

Features of a whole text: how dense words of a lexicon are, how near they stand to a word
of address, capitals, punctuation and obfuscated words. The lexicon has a fixed part and a
learned one: words and word beginnings that toxic documents hold far more often, once or at
least twice in a text.

The labelled rows that may be learned from are dealt in folds by a hash of their id. The
features of a fold's rows come from a lexicon learned from all other folds, so that no row
is judged by what it has itself suggested; what scores documents is learned from all folds.
Trees are fitted to seven tenths of the rows, the isotonic calibration to the others. At
most ``sample`` labelled rows are used, those with the smallest hash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, partitions, stored

#: Bound of the labelled rows that are learned from, learned terms, and the least of their weights.
SAMPLE, TERMS, LEAST_WEIGHT = 16_000, 4_000, 1.0
#: Weights from which a term is sure or strong, and the number of folds.
SURE_WEIGHT, STRONG_WEIGHT, FOLDS = 2.0, 4.0, 4
HELD_OUT, THRESHOLD = 2, 0.3
#: General insults, and words of address in four languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown fool imbecile hate kill ugly filth freak jerk".split())
ADDRESS = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir ihr euch dein deine usted ustedes vosotros tú ti".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
EDGE = re.compile(r"^\W+|\W+$")
INNER = re.compile(r"[^\W\d_][\d_@$*#!.]+[^\W\d_]|[@$*#0-9]+[^\W\d_]")
NEAR = 5
HIT, SURE, STRONG, FIXED, TO, HIDDEN = 1, 2, 4, 8, 16, 32
#: Where a word's weight in sixteenths, and the number of the term that is judged by its second hit, begin.
WEIGHT_AT, TERM_AT = 6, 20
WORDS_KEPT = 500_000
#: Marks a term of which a text holds two words or more.
TWICE = "2"
NAMES = ("hit_density", "sure_density", "strong_density", "fixed_density", "log_hits", "log_sure", "log_strong", "max_weight", "sum_weight", "mean_weight", "twice_weight", "twice_sum", "near_address", "address_density", "capitals", "punctuation", "exclamations", "obfuscated", "log_words")


def terms(word: str) -> list[str]:
    """A word and its beginnings, as the lexicon knows them."""
    return [word + "$", *("^" + word[:k] for k in range(2, min(len(word), 7) + 1))]


class Lexicon(dict):
    """word as it stands in a lower-cased text -> flags, weight and the number of its best term for a second hit.

    ``twice``: the weights of these terms by their numbers; number 0 is none.
    """

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = {t: w for t, w in weights.items() if t[0] != TWICE}
        second = sorted((t[1:], w) for t, w in weights.items() if t[0] == TWICE)
        self.number = {t: k for k, (t, _) in enumerate(second, 1)}
        self.twice = np.array([0.0, *(w for _, w in second)])

    def __missing__(self, raw: str) -> int:
        word = EDGE.sub("", raw)
        known, fixed, code = terms(word), word in INSULTS, 0
        if word and INNER.search(word):
            code |= HIDDEN
            plain = re.sub(r"[\W\d_]", "", word.translate(LOOKALIKES))
            fixed = fixed or plain in INSULTS
            known += terms(plain)
        weight = max(self.weights.get(t, 0.0) for t in known)
        code |= (HIT if weight or fixed else 0) | (SURE if weight >= SURE_WEIGHT else 0) | (STRONG if weight >= STRONG_WEIGHT else 0) | (FIXED if fixed else 0) | (TO if word in ADDRESS else 0)
        code |= int(weight * 16) << WEIGHT_AT
        code |= max((self.number.get(t, 0) for t in known), key=lambda k: (self.twice[k], -k)) << TERM_AT
        if len(self) < WORDS_KEPT:
            self[raw] = code
        return code


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = text.lower().split()
    n = len(words)
    code = np.fromiter(map(lexicon.__getitem__, words), np.int64, n)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    capitals = letters & (raw < 97)
    marks = (raw > 32) & (raw < 127) & ~letters & ~((raw >= 48) & (raw <= 57))
    hits = (code & HIT) > 0
    address = (code & TO) > 0
    near = 0.0
    if hits.any() and address.any():
        seen = np.cumsum(np.r_[0, address])
        at = np.nonzero(hits)[0]
        near = float((seen[np.minimum(at + NEAR + 1, n)] > seen[np.maximum(at - NEAR, 0)]).mean())
    weight = (code >> WEIGHT_AT & (1 << TERM_AT - WEIGHT_AT) - 1) / 16.0
    second = np.zeros(0)
    number = code >> TERM_AT
    number = number[number > 0]
    if len(number) > 1:
        number, times = np.unique(number, return_counts=True)
        second = lexicon.twice[number[times > 1]]
    h, sure, strong, fixed = (int(((code & flag) > 0).sum()) for flag in (HIT, SURE, STRONG, FIXED))
    per, total = max(n, 1), float(weight.sum())
    return [
        h / per, sure / per, strong / per, fixed / per, math.log1p(h), math.log1p(sure), math.log1p(strong), float(weight.max(initial=0.0)), total, total / per,
        float(second.max(initial=0.0)), float(second.sum()), near, int(address.sum()) / per,
        int(capitals.sum()) / max(int(letters.sum()), 1), int(marks.sum()) / max(len(raw), 1), int((raw == 33).sum()) / max(len(raw), 1), int(((code & HIDDEN) > 0).sum()) / per, math.log1p(n),
    ]


@dataclass
class ToxicityModel:
    """What scoring needs; ``trees`` is None where labels showed one class at most."""

    weights: dict[str, float]
    trees: Any
    calibration: Any
    prior: float


def featured(docs: DataFrame, weights: list[dict[str, float]], carried: list[str], fold: str | None = None) -> DataFrame:
    """(features, *carried) of (text, *carried); ``fold`` names the column that says which lexicon is used."""
    schema = docs.select(F.array(F.lit(0.0)).alias("features"), *carried).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(w) for w in weights]
        for batch in batches:
            which = batch.column(fold).to_pylist() if fold else [0] * len(batch)
            values = [features(text.as_py(), lexicons[k]) for text, k in zip(batch.column("text"), which)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), *(batch.column(c) for c in carried)], names=["features", *carried])

    return docs.select("text", *carried).mapInArrow(compute, schema)


COUNTED = pa.schema([("term", pa.string()), ("fold", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])
#: Counts that a task holds before it passes them on.
COUNTS_HELD = 400_000


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, fold, toxic, clean): partial numbers of documents that hold a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (fold, label), own in seen.items():
                n = list(own.values())
                yield pa.RecordBatch.from_pydict({"term": list(own), "fold": [fold] * len(n), "toxic": n if label else [0] * len(n), "clean": [0] * len(n) if label else n}, COUNTED)
            seen.clear()

        for batch in batches:
            for text, label, fold in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("fold").to_pylist()):
                held: Counter = Counter()
                for raw, n in Counter(text.as_py().lower().split()).items():
                    if word := EDGE.sub("", raw):
                        for t in terms(word):
                            held[t] += n
                own = seen.setdefault((fold, label), Counter())
                own.update(held.keys())
                own.update(TWICE + t for t, n in held.items() if n > 1)
                if sum(map(len, seen.values())) > COUNTS_HELD:
                    yield from passed_on()
        yield from passed_on()

    return labelled.select("text", "label", "fold").mapInArrow(count, "term string, fold int, toxic bigint, clean bigint")


def learn_lexicons(labelled: DataFrame, sizes: dict[tuple[int, int], int]) -> list[dict[str, float]]:
    """For each fold the weights of terms learned from the other folds, and last those learned from all.

    A weight is the least log odds ratio of documents with the term, with 95 % confidence.
    ``sizes``: documents by (fold, label). At most TERMS terms of a lexicon come to the driver.
    """
    totals = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "clean")]
    counted = term_counts(labelled).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *totals).where("toxic >= 3")
    each = []
    for f in range(FOLDS + 1):
        t, c = (F.col(name) - (F.col(f"{name}{f}") if f < FOLDS else F.lit(0)) for name in ("toxic", "clean"))
        toxic, clean = (sum(n for (fold, y), n in sizes.items() if y == label and fold != f) for label in (1, 0))
        odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
        lower = odds - 1.645 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        each.append(F.struct(F.lit(f).alias("lexicon"), F.when(t >= 3, lower).alias("w")))
    weighed = counted.select("term", F.explode(F.array(*each)).alias("e")).select("term", "e.*").where(F.col("w") >= LEAST_WEIGHT)
    weighed = stored(weighed, "term-weights")
    return [{r["term"]: r["w"] for r in weighed.where(F.col("lexicon") == f).orderBy(F.desc("w"), "term").limit(TERMS).collect()} for f in range(FOLDS + 1)]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from rows of ``labels`` whose crc32(id as text) mod 4 is not 2.

    Labels other than 0 and 1, nulls among them, count for nothing. Where an id is repeated,
    its largest label and its least text count.
    """
    rows = id_and_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(remainder() != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    own = own.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")).withColumn("deal", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)).cast("int"))
    own = stored(own.repartition(partitions(docs.sparkSession), "doc_id"), "toxicity-sample")
    sizes = {(r["fold"], r["label"]): r["n"] for r in own.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    parts = {(r["late"], r["label"]) for r in own.select((F.col("deal") >= 7).alias("late"), "label").distinct().collect()}
    positive, negative = (sum(n for (_, y), n in sizes.items() if y == label) for label in (1, 0))
    prior = positive / max(positive + negative, 1)
    if not positive or not negative:
        return ToxicityModel({}, None, None, prior)
    weights = learn_lexicons(own, sizes)
    ready = stored(featured(own, weights, ["label", "deal", "fold"], "fold").withColumn("vector", array_to_vector("features")), "toxicity-features")
    whole = len(parts) < 4  # too few to deal out
    early, late = (ready if whole else ready.where(c) for c in ("deal < 7", "deal >= 7"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=1).fit(early.coalesce(4))
    margin = trees.transform(late).select(vector_to_array("rawPrediction")[1].alias("margin"), F.col("label").cast("double"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin)
    return ToxicityModel(weights[-1], trees, calibration, prior)


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def scores(rows: DataFrame, model: ToxicityModel, carried: list[str]) -> DataFrame:
    """(score, *carried) of (text, *carried); nothing is shuffled, an empty table gives no rows, a text is held whole."""
    if model.trees is None:
        return rows.select(F.lit(float(model.prior)).alias("score"), *carried)
    ready = featured(rows, [model.weights], carried).withColumn("vector", array_to_vector("features"))
    margin = model.trees.transform(ready).select(vector_to_array("rawPrediction")[1].alias("margin"), *carried)
    return model.calibration.transform(margin).select(F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"), *carried)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    A null or empty text is scored like any other; a null id is not held out. Where the
    labels show one class at most, every score is that class.
    """
    held_out = F.coalesce(remainder() == HELD_OUT, F.lit(False))
    scored = scores(id_and_text(docs, id_col, text_col), model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, label_col, sample))


def without_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, each judged by its own text.

    All columns go through the tasks that score, so that rows with null or repeated ids
    are judged one by one and nothing is joined.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scores(rows, train(docs, labels, label_col, sample, text_col=text_col), ["row"]).where(F.col("score") < THRESHOLD).select("row.*")
