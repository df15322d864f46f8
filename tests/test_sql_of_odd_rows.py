"""Rows that the given small tables lack, by query and by SQL."""

from __future__ import annotations

import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.plans import ingest_queries, search_queries
from quarry.plans.registry import ORACLE


@pytest.fixture
def tables(spark, tmp_path):
    odd = "words and words " * 20 + "é ç " * 300
    docs = spark.createDataFrame([(k, odd if k % 2 else f"plain text of {k} " * 50, "en", "src0") for k in range(2, 10)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    vectors = spark.createDataFrame([(1, [-1e-8, 1.0, 0.0, 1e-8], 0), (2, [0.6, -0.8, -0.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(str(tmp_path / "embeddings.parquet"))
    return tmp_path


def by_sql(tables, name):
    base = duckdb.connect()
    for path in tables.glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return sorted(base.execute(ORACLE[name]).fetchall(), key=str)


def test_chunk_store_of_chunks_without_plain_text(spark, tables):
    """Chunks that are empty once cleaned have no vector and are not stored."""
    got = sorted((tuple(r) for r in ingest_queries.chunk_store(spark, str(tables)).collect()), key=str)
    assert got == by_sql(tables, "chunk_store") and any(r[1] == 0 and "é" in r[5] for r in got)


def test_forget_file_of_chunks_without_plain_text(spark, tables):
    got = sorted((tuple(r) for r in ingest_queries.forget_file(spark, str(tables)).collect()), key=str)
    assert got == by_sql(tables, "forget_file") and ("src0", "doc3.pptx") in {r[:2] for r in got}


def test_forget_file_of_ids_of_any_size(spark, tmp_path):
    """Forgotten files stay so where ids are beyond 2 ** 40; ids below zero have the last format."""
    ids = [-7, -6, -2, 3, 1 << 40, (1 << 40) + 3, (1 << 50) + 1, (1 << 50) + 4]
    docs = spark.createDataFrame([(k, f"plain text of {k} " * 50, "en", f"src{n % 2 * 3}") for n, k in enumerate(ids)], "doc_id long, text string, lang string, source string")
    docs.union(spark.createDataFrame([((1 << 41) + n, f"more text of {n} ", "en", "src1") for n in range(12)], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [((1 << 41) + n, n % 2, 0) for n in range(12)] + [(3, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((tuple(r) for r in ingest_queries.forget_file(spark, str(tmp_path)).collect()), key=str)
    assert got and got == by_sql(tmp_path, "forget_file")


def test_l2_normalize_keeps_the_sign_of_zero(spark, tables):
    bits = lambda rows: [(k, [struct.pack("d", x) for x in unit]) for k, unit in rows]
    got = sorted((r["vec_id"], r["unit"]) for r in search_queries.unit_vectors(spark, str(tables)).collect())
    assert bits(got) == bits(by_sql(tables, "l2_normalize"))


def test_bm25_topk_of_repeated_and_missing_ids(spark, tmp_path):
    """Rows of one id are one document with the length of each row; without an id they count, and are not found."""
    data = [(1, "red fox runs"), (1, "red fox runs"), (2, "red hen"), (2, "a red fox and a red hen"), (3, "blue"), (4, ""), (None, "red"), (None, "fox fox"), (5, "fox"), (6, "fox"), (7, "the hen runs")]
    spark.createDataFrame([(k, t, "en", "src0") for k, t in data], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "fox red"), (2, "hen, hen"), (3, "##"), (4, "the blue runs")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in search_queries.bm25_topk(spark, str(tmp_path)).collect()), key=str)
    assert got == by_sql(tmp_path, "bm25_topk") and [r[1] for r in got if r[0] == 4]
