import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import neighbour_graph as g
from quarry.operators import search


def edge_recall(graph, base, k):
    asked = base.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = search.knn(asked, base, k + 1).where("query_id <> vec_id AND NOT isnan(distance)")
    exact = exact.withColumn("place", F.row_number().over(g.Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)
    hit = exact.join(graph.select(F.col("a").alias("query_id"), F.col("b").alias("vec_id")).hint("merge"), ["query_id", "vec_id"], "left_semi")
    return hit.count() / exact.count()


@pytest.mark.parametrize("kind", ["given", "clustered"])
def test_edges_against_exact(spark, kind):
    if kind == "given":
        base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    else:
        rng = np.random.default_rng(2)
        centres = rng.normal(size=(30, 12))
        base = spark.createDataFrame([(k, (centres[k % 30] + 0.3 * rng.normal(size=12)).tolist()) for k in range(1500)], "vec_id long, embedding array<double>")
    graph = g.neighbour_graph(base)
    assert graph.groupBy("a").count().where("count <> 10").count() == 0 and graph.where("a = b").count() == 0
    assert edge_recall(graph, base, 10) >= 0.9


def test_walks(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    asked = base.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    graph = g.neighbour_graph(base)
    got = sorted(map(tuple, g.walked(asked, base, graph).collect()))
    want = sorted(map(tuple, search.multi_hop(asked, base).collect()))
    assert len(set(got) & set(want)) >= 0.9 * len(want) and len(got) <= 1.1 * len(want)


def test_few_vectors(spark):
    ddl = "vec_id long, embedding array<double>"
    assert g.neighbour_graph(spark.createDataFrame([], ddl)).count() == 0
    assert g.neighbour_graph(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], ddl)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], ddl)
    assert sorted((r["a"], r["b"], r["rank"]) for r in g.neighbour_graph(odd, k=1).collect()) == [(1, 3, 1), (2, 1, 1), (3, 1, 1)]


def test_exact_graph(spark):
    """Unclustered vectors, of which descent finds too few, and many copies: every edge is the exact one, whatever the tiles."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(1500, 48)).astype(np.float32)
    rows[100:160] = rows[100]
    rows[7] = 0
    unit = rows.astype(np.float64) / np.maximum(np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True), 1e-30)
    far = np.round(1 - unit @ unit.T, 9)
    np.fill_diagonal(far, np.inf)
    want = {(a, int(b), rank) for a in range(1500) for rank, b in enumerate(np.lexsort((np.arange(1500), far[a]))[:10], 1)}
    base = spark.createDataFrame([(k, rows[k].tolist()) for k in range(1500)], "vec_id long, embedding array<double>")
    for tile in (None, 400):
        assert {(r["a"], r["b"], r["rank"]) for r in g.exact_graph(base, tile=tile).collect()} == want


def test_exact_graph_of_few(spark):
    ddl = "vec_id long, embedding array<double>"
    assert g.exact_graph(spark.createDataFrame([], ddl)).count() == 0
    assert g.exact_graph(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], ddl)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], ddl)
    assert sorted((r["a"], r["b"], r["rank"]) for r in g.exact_graph(odd, k=1).collect()) == [(1, 3, 1), (2, 1, 1), (3, 1, 1)]
