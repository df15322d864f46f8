import numpy as np
from pyspark.sql import functions as F

from quarry.operators import search, vector_index
from quarry.operators.vector_index import VectorIndex, fitted_words


def clustered(spark, n=3000, dims=18, clusters=30):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(clusters, dims))
    data = [(k, (centres[k % clusters] + 0.2 * rng.normal(size=dims)).tolist()) for k in range(n)]
    return spark.createDataFrame([*data, (n, [0.0] * dims), (n + 1, None)], "vec_id long, embedding array<double>").repartition(5)


def test_clustered_vectors(spark, tmp_path):
    """A tenth of the cells is read, a hundred vectors a question are compared, nine in ten are found."""
    base = clustered(spark)
    asked = base.where("vec_id % 50 = 0 AND vec_id < 3000").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "index")).build(base)
    found = index.search(asked)
    assert search.recall(found, search.knn(asked, base)).agg(F.avg("recall")).first()[0] >= 0.9
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    seen = index.visited(asked).first()
    assert seen["questions"] == 60 and seen["vectors"] == 3001
    assert max(seen["coded_share"], seen["compared_share"], seen["byte_share"]) < 0.25
    one = index.candidates(asked.where("query_id = 50"), None, 100)
    cells = {r["cell"] for r in one.select("cell").distinct().collect()}
    assert 0 < len(cells) <= len(index.quantiser().centres) // 10 + 1


def test_every_vector_is_indexed(spark, tmp_path, monkeypatch):
    """With all cells probed and all candidates compared the search is exact, whatever lies in one cell."""
    monkeypatch.setattr(vector_index, "PACKED", 40)
    monkeypatch.setattr(vector_index, "ASKED", 6)
    base = clustered(spark, 700, 6, 3).union(spark.createDataFrame([(k, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for k in range(1000, 1400)], "vec_id long, embedding array<double>"))
    asked = base.where("vec_id % 50 = 0 AND vec_id <> 700").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "index")).build(base, cells=4)
    codes = index._read("codes", vector_index.CODES)
    assert codes.agg(F.sum("n")).first()[0] == 1101 and codes.agg(F.max("n")).first()[0] <= 40
    got = index.search(asked, probes=4, refine=1101).select("query_id", "rank", F.round("distance", 5).alias("d"))
    want = search.knn(asked, base).select("query_id", "rank", F.round("distance", 5).alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty(spark, tmp_path):
    base = clustered(spark, 100)
    none = VectorIndex(spark, str(tmp_path / "none")).build(base.limit(0))
    assert none.search(base.withColumnRenamed("vec_id", "query_id")).count() == 0
    index = VectorIndex(spark, str(tmp_path / "index")).build(base)
    assert index.search(base.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0


def test_codebook():
    rows = np.random.default_rng(1).normal(size=(2000, 4))
    book = fitted_words(rows, 64)
    far = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2).min(axis=1).mean()
    assert len(book) == 64 and far < 0.25 * (rows**2).sum(axis=1).mean()
    assert len(fitted_words(np.ones((9, 4)), 64)) == 1


def test_a_question_meets_its_cells_in_one_task(spark, tmp_path, monkeypatch):
    """Each question is one row whatever it probes, and no more than ``refine`` candidates of it leave a tile; ties go by id."""
    monkeypatch.setattr(vector_index, "ASKED", 7)
    monkeypatch.setattr(vector_index, "PACKED", 16)
    monkeypatch.setattr(vector_index, "HELD", 50)
    base = clustered(spark, 600, 6, 3).union(spark.createDataFrame([(k, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for k in range(1000, 1200)], "vec_id long, embedding array<double>"))
    asked = base.where("vec_id % 50 = 0 AND vec_id <> 600").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "index")).build(base, cells=12)
    quantiser = index.quantiser()
    probed = index.probed(asked, 9)
    assert probed.count() == asked.count() == 16
    found = []
    for tile in (1 << 20, 100):
        monkeypatch.setattr(vector_index, "TILE", tile)
        near, tiles = index.near(probed, quantiser, 30)
        assert near.groupBy("q").count().agg(F.max("count")).first()[0] <= 30 * tiles
        found.append(sorted((r["q"], r["id"]) for r in index.candidates(asked, 9, 30).collect()))
    assert found[0] == found[1] and len(found[0]) == 16 * 30
    same = [i for q, i in found[0] if q == 1000 and i >= 1000]
    assert same == list(range(1000, 1030))
    assert {r[0] for r in probed.select(F.size("cells")).collect()} == {9}


def test_distances_by_code_are_those_of_tables():
    rng = np.random.default_rng(2)
    quantiser = vector_index.Quantiser(rng.normal(size=(3, 5)), [rng.normal(size=(7, 4)), rng.normal(size=(7, 1))])
    codes = rng.integers(0, 7, size=(9, 2)).astype(np.uint8)
    parts = np.concatenate([quantiser.books[0][codes[:, 0]], quantiser.books[1][codes[:, 1]]], axis=1)
    assert np.allclose(quantiser.decoded(2, codes), quantiser.centres[2] + parts)
