"""Work of operators over many rows that repeat what others hold: it grows with the different ones."""

from __future__ import annotations

import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.functions.text import NOT_PLAIN
from quarry.operators import analysis, tools, versions
from quarry.plans import ingest_queries, scenario
from quarry.sources.scratch import stored


def shuffled_rows(spark, run):
    """Rows written to shuffles while ``run()`` is collected, and its rows."""
    context = spark.sparkContext

    def written():
        none = context._gateway.new_array(context._jvm.double, 0)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = run().collect()
    return written() - before, rows


def test_detected_copies(spark):
    """Many tools and many questions of the same words are compared once."""
    n = 600
    known = spark.range(n).select(F.col("id").alias("tool_id"), F.lit("b").alias("bot_id"), F.lit("red_bolt").alias("name"), F.lit("a steel bolt").alias("description"), F.lit(True).alias("enabled"))
    known = known.union(spark.createDataFrame([(n, "b", "blue_ring", "brass", True), (n + 1, "b", "ring", "blue", True)], known.schema))
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit("b").alias("bot_id"), F.when(F.col("id") < 2, "a blue ring").otherwise("the red bolt of steel, please").alias("question"))
    work, rows = shuffled_rows(spark, lambda: tools.detected(asked, known))
    assert {(r["tool"], r["overlap"]) for r in rows if r["query_id"] < 2} == {("blue_ring", 2)} and {(r["tool"], r["overlap"]) for r in rows if r["query_id"] > 1} == {("red_bolt", 3)}
    assert len(rows) == n and work < 10 * n


def test_long_texts_are_cut_in_one_pass(spark):
    """Slices of all words for each word would take minutes."""
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(150_000))
    began = time.time()
    chunks = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string").select(versions.content_chunks(F.col("text")).alias("c")).orderBy(F.size("c")).collect()
    assert chunks[0]["c"] == [] and "".join(chunks[1]["c"]) == text and len(chunks[1]["c"]) > 2000
    assert time.time() - began < 40


def test_passages_in_long_texts(spark):
    """Runs of words made anew for each word would take minutes."""
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, text[5000:5300]), (2, text[70_000:70_020] + " not there"), (3, text[-40:])], "query_id int, question string")
    began = time.time()
    assert sorted(map(tuple, analysis.containing(docs, asked).collect())) == [(1, 1), (3, 1)]
    assert time.time() - began < 20


def test_cleaning_looks_characters_up(spark):
    """Java tests ranges of a class one after the other, but looks up single characters: the class names no range, and means the same."""
    assert "-" not in NOT_PLAIN.removeprefix("[^").removesuffix("-]+")
    text = "".join(map(chr, range(0x250))) + "\u2028\ufeff\U0001f600"
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(F.regexp_replace("text", NOT_PLAIN, "") == F.regexp_replace("text", "[^A-Za-z0-9_ .-]", "")).first()[0]


def test_hashing_holds_few_words_at_a_time():
    texts = ["some words of a text that is repeated " * 100] * 4000 + [None, ""]
    vectors.hashed_counts(texts[:1])
    tracemalloc.start()
    counts = vectors.hashed_counts(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == 4000 * 800 and (counts[0] == counts[3999]).all() and not counts[4000:].any()
    assert vectors.hashed_counts([]).shape == (0, 64)
    assert most < 40_000_000


def test_texts_are_hashed_once(spark):
    """A filter on the counts was pushed below the function that makes them."""
    plan = ingest_queries.embed_hashing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_chunks_are_written_to_the_store_alone(spark, monkeypatch):
    """Chunks with their vectors were written once more before they were stored."""
    written = []
    monkeypatch.setattr(scenario, "stored", lambda rows, name: written.append(name) or stored(rows, name))
    monkeypatch.setattr(scenario, "_filled", {})
    assert scenario.searchable(spark, "/root/testdata/sf0.001").count() > 0 and not written


def test_scores_stay_where_documents_lie(spark):
    """Words that all documents and questions hold made a row for each word of a document and each question."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the same words of"), F.col("id") % 700).alias("text"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("the same words of"), "id").alias("question"))
    work, rows = shuffled_rows(spark, lambda: analysis.bm25(asked, docs, k=3))
    assert len(rows) == 900 and {r["doc_id"] for r in rows if r["query_id"] == 7} == {7, 707, 1407}
    assert work < 20_000


@pytest.mark.parametrize("by", [None, "bot"])
def test_scores_in_rounds_and_pieces(spark, monkeypatch, by):
    """Questions of several rounds, and documents scored in small pieces, have the same scores; equal ones go by id."""
    docs = spark.range(400).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.concat(F.lit("b"), F.col("id") % 3).alias("bot"), F.concat_ws(" ", F.lit("some words"), F.col("id") % 7, F.col("id") % 11, F.lit("W7!")).alias("text"))
    asked = spark.range(12).select(F.col("id").alias("query_id"), F.concat(F.lit("b"), F.col("id") % 4).alias("bot"), F.concat_ws(" ", F.lit("words"), F.col("id") % 7, F.col("id")).alias("question"))
    asked = asked.union(spark.createDataFrame([(50, "b1", "##"), (51, "b1", None), (52, None, "words"), (53, "b1", "none of them"), (3, "b1", "words words")], "query_id long, bot string, question string"))
    whole = sorted(map(tuple, analysis.bm25(asked, docs, k=4, by=by).collect()))
    for name, size in (("QUESTIONS", 3), ("CELLS", 40), ("TEXTS", 5)):
        monkeypatch.setattr(analysis, name, size)
    pieces = sorted(map(tuple, analysis.bm25(asked, docs, k=4, by=by).collect()))
    assert [(*r[:2], round(r[2], 9), r[3]) for r in pieces] == [(*r[:2], round(r[2], 9), r[3]) for r in whole]
    assert len({r[0] for r in whole}) == (10 if by else 13) and all([r[1] for r in whole if r[0] == q and round(r[2], 6) == x] == sorted(r[1] for r in whole if r[0] == q and round(r[2], 6) == x) for q in range(12) for x in {round(r[2], 6) for r in whole if r[0] == q})
    assert analysis.bm25(asked.limit(0), docs, by=by).count() == 0 == analysis.bm25(asked, docs.limit(0), by=by).count()
