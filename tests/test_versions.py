import random

from pyspark.sql import functions as F

from quarry.operators import versions
from quarry.sources.store import ChunkStore


def texts():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    long = " ".join(rng.choices(words, k=3000))
    return ["", None, "one", "  lead and trail \n\n", "same " * 1000, long, "a\tb\r\n" + long[:2000]]


def test_chunks_join_to_the_text(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "k int, text string")
    got = {r["k"]: r["chunks"] for r in rows.select("k", versions.content_chunks(F.col("text")).alias("chunks")).collect()}
    for k, text in enumerate(texts()):
        assert "".join(got[k]) == (text or "")
        assert all(len(c.split()) <= versions.MOST for c in got[k])
    assert got[0] == got[1] == [] and 20 < len(got[5]) < 150 and len(got[4]) == 4


def test_only_changes_are_embedded(spark, tmp_path):
    long = texts()[5]
    files = [("b", "f", long), ("b", "g", "short text"), ("c", "f", "same " * 1000)]
    later = [("b", "f", long[:4000] + "something new here " + long[4000:]), ("b", "g", "short text"), ("c", "f", "same " * 744 + "end")]
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(batch):
        import uuid

        (calls / f"{uuid.uuid4().hex}-{len(batch)}").touch()
        return [[float(len(t)), 1.0] for t in batch]

    keys = ["bot_id", "file_name"]
    old, new = (versions.version_chunks(spark.createDataFrame(f, "bot_id string, file_name string, text string"), keys) for f in (files, later))
    status = {r["file_name"] + r["bot_id"]: r for r in versions.aligned(old, new, keys).groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("kept", "new", "gone"))).collect()}
    assert status["fb"]["new"] <= 3 and status["fb"]["gone"] <= 3 and status["fb"]["kept"] > 20
    assert (status["gb"]["kept"], status["gb"]["new"], status["gb"]["gone"]) == (1, 0, 0)
    had = versions.embedded(old, embed=lambda batch: [[float(len(t)), 1.0] for t in batch])
    full = versions.replaced(had, new, keys, embed)
    rows = full.collect()
    assert len(rows) == new.count() and all(r["embedding"] is not None for r in rows)
    assert sum(int(p.name.split("-")[1]) for p in calls.iterdir()) == sum(not r["reused"] for r in rows) <= 5

    store = ChunkStore(spark, str(tmp_path / "store"), 2).create()
    store.append_chunks(had.withColumn("file_hash", F.lit("h1")), "t", F.lit(1))
    store.replace_files(full.withColumn("file_hash", F.lit("h2")), "t", 5)
    left = store.chunks().groupBy("bot_id", F.col("metadata.fileName").alias("f")).agg(F.count("*").alias("n"), F.max("metadata.fileHash").alias("h"), F.min("metadata.fileHash").alias("l"))
    assert all(r["h"] == r["l"] == "h2" for r in left.collect()) and left.agg(F.sum("n")).first()[0] == new.count()
