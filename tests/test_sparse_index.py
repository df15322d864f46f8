import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import clean_text
from quarry.operators import analysis, sparse_index
from quarry.operators.sparse_index import SparseIndex


def ranked(df, *columns):
    return sorted(map(tuple, df.select(*columns, F.round("score", 5)).collect()), key=str)


def texts(spark, n):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    data = [(k, rng.choice(["a", "a", "b"]), " ".join(rng.choices(words, weights, k=rng.choice([1, 4, 9, 40])))) for k in range(n)]
    data += [(n, "a", None), (n + 1, "b", "##"), (n + 2, "a", "w7 w7"), (n + 3, "a", "w7 w7"), (n + 4, None, "w7"), (n + 5, "a", "W7! w8 " * 3000)]
    return spark.createDataFrame(data, "doc_id long, bot string, text string").repartition(4)


@pytest.mark.parametrize("by", [None, "bot"])
def test_equals_scoring_everything(spark, tmp_path, by):
    docs = texts(spark, 1500)
    asked = spark.createDataFrame([(1, "a", "w7 w8"), (2, "b", "w30 w1 w0 w59"), (3, "a", "nothing here"), (4, "a", ""), (5, "zz", "w1"), (6, "a", "w50"), (7, "b", "w7 w7 W7")], "query_id long, bot string, question string")
    own = docs.where("bot IS NOT NULL")
    index = SparseIndex.build(docs if by else own, str(tmp_path / "index"), by=by)
    got, want = index.search(asked, by=by), analysis.bm25(asked, own, by=by)
    assert ranked(got, "query_id", "doc_id", "rank") == ranked(want, "query_id", "doc_id", "rank")
    shares = {r["query_id"]: r["read"] / r["postings"] for r in index.reading(asked, by=by).collect()}
    assert max(shares.values()) <= 1 and min(shares.values()) < 0.7


def test_most_postings_are_skipped(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").selectExpr("item_id AS query_id", "array_join(slice(split(text, ' '), 1, 3), ' ') AS question")
    read = SparseIndex.build(docs, str(tmp_path / "index")).reading(asked).agg(F.sum("read") / F.sum("postings")).first()[0]
    assert read < 0.35


def test_string_keys_and_empty_tables(spark, tmp_path):
    docs = texts(spark, 50).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    asked = spark.createDataFrame([(1, "w1 w2")], "query_id long, question string")
    index = SparseIndex.build(docs, str(tmp_path / "index"))
    assert ranked(index.search(asked, k=3), "doc_id", "rank") == ranked(analysis.bm25(asked, docs, k=3), "doc_id", "rank")
    assert index.search(asked.limit(0)).count() == 0
    none = SparseIndex.build(docs.limit(0), str(tmp_path / "none"))
    assert none.search(asked).count() == 0


def test_words_are_those_of_clean_text(spark):
    odd = ["", "a#b # c\u00a0D\u2003e\u200bf\ufeffg\u3000h", "\u00e9t\u00e9 caf\u00c9 \x00x\x1fy\u0085z", "\t\n\x0b\f\r", "\u2028a\u2029b_.-\u1680C", *(f"p{chr(c)}q" for c in [*range(0x80, 0x100), *range(0x1FF0, 0x2070)])]
    rows = spark.createDataFrame(list(enumerate(odd)), "k int, text string").select("text", clean_text(F.col("text")).alias("cleaned"))
    assert all(sparse_index.plain(r["text"].encode()).decode().split() == r["cleaned"].split() for r in rows.collect())


def test_a_word_of_a_block_is_one_row(spark, tmp_path):
    """Not one for each range of 32 documents; only rows of words that are asked are handed on."""
    docs = spark.createDataFrame([(k, "same words w%d" % (k % 5)) for k in range(640)], "doc_id long, text string").coalesce(1)
    index = SparseIndex.build(docs, str(tmp_path / "index"))
    rows = index.read("postings").where("token = 'same'").selectExpr("size(ranges) AS ranges", "size(keys) AS n").collect()
    parts = index.read("postings").selectExpr("ranges[0] >> 32 AS part").distinct().count()
    assert len(rows) == parts and sum(r["n"] for r in rows) == 640 and sum(r["ranges"] for r in rows) >= 20
    asked = spark.createDataFrame([(1, "w3 w9")], "query_id long, question string")
    wanted, own = index.wanted(asked, "query_id", "question", None)
    assert {r["token"] for r in own.select("token").collect()} == {"w3"} and wanted.count() == 1
