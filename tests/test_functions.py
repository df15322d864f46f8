import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions import vectors as v


def values(spark, texts, column):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r["y"] for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_clean_text(spark):
    given_ = ["a & b", "É-1.2_x!", "a b﻿c", " \t\n", "", None, "Mixed   CASE"]
    assert values(spark, given_, t.clean_text) == ["a  b", "-1.2_x", "a b c", "", "", None, "mixed case"]


def test_names_and_previews(spark):
    assert values(spark, ["a/b/C.PDF", "noext", "x.tar.GZ"], lambda c: t.extension(t.base_name(c))) == ["pdf", "noext", "gz"]
    assert values(spark, ["a" * 100, "b" * 101], t.preview) == ["a" * 100, "b" * 100 + "..."]
    assert values(spark, ["a b*(c)!'~", "é/?&"], t.uri_component) == ["a%20b*(c)!'~", "%C3%A9%2F%3F%26"]


def test_fixed_chunks(spark):
    for n in (1, 400, 401, 780, 781):
        text = "".join(chr(97 + k % 26) for k in range(n))
        chunks = values(spark, [text], t.fixed_chunks)[0]
        assert "".join(c if k == 0 else c[20:] for k, c in enumerate(chunks)) == text
        assert all(len(c) == 400 for c in chunks[:-1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_recursive_chunker(text, size):
    overlap = size // 5
    chunks = t.split_recursively(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    letters = [c for c in text if not c.isspace()]
    seen, at = "".join(chunks), 0
    for c in letters:
        at = seen.index(c, at) + 1
    if len(text.strip()) <= size and "\n" not in text and len(text) <= size:
        assert chunks == ([text.strip()] if text.strip() else [])


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0], [3.0, 4.0]), (1, [0.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-2.0, 0.0])], "k int, a array<float>, b array<float>")
    out = rows.select("k", v.l2_normalize(F.col("a")).alias("u"), v.cosine_distance(F.col("a"), F.col("b")).alias("c"), v.l2_distance(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()
    assert out[0]["u"] == [0.6, 0.8] and out[1]["u"] == [0.0, 0.0]
    assert abs(out[0]["c"]) < 1e-12 and math.isnan(out[1]["c"]) and out[2]["c"] == 2.0
    assert [r["d"] for r in out] == [0.0, 1.0, 3.0]


def test_hashing(spark):
    counts = values(spark, ["a b a", "", None], lambda c: v.hashing_counts(8)(c))
    assert sum(counts[0]) == 3 and counts[0][v.token_bucket("a", 8)] >= 2
    assert np.sum(counts[1]) == 0 == np.sum(counts[2])
