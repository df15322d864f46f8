import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import rollups
from quarry.operators.pages import PageIndex


def test_pages(spark, tmp_path):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, 1)], "k long, v long"))
    index = PageIndex.build(rows, str(tmp_path / "index"), ["k"], part=100)
    order = [None, *range(1000)]
    for number, size in ((1, 10), (34, 9), (77, 13), (100, 10), (101, 10), (102, 10), (2, 700), (1, 5000)):
        page = index.page(number, size)
        assert [r["k"] for r in page.collect()] == order[(number - 1) * size : number * size]
    assert "(__part#" in (plan := index.page(50, 10)._jdf.queryExecution().toString()) and " = 5)], PushedFilters" in plan
    with pytest.raises(ValueError):
        index.page(0, 10)
    none = PageIndex.build(rows.limit(0), str(tmp_path / "none"), ["k"])
    assert none.page(1, 10).count() == 0


def test_parts_grow_before_they_multiply(spark, tmp_path):
    """Each part is a task and a folder."""
    index = PageIndex.build(spark.range(5000).withColumnRenamed("id", "k"), str(tmp_path / "index"), ["k"], part=5)
    assert spark.read.parquet(f"{index.folder}/counts").count() <= 64
    assert [r["k"] for r in index.page(100, 7).collect()] == list(range(693, 700))


def test_rollups_merge(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [(rng.choice("ab"), rng.randrange(5000), rng.expovariate(0.1), start + dt.timedelta(seconds=rng.randrange(400_000))) for _ in range(30_000)] + [("a", None, None, start), ("c", 1, None, None)]
    events = spark.createDataFrame(data, "event_type string, user_id long, value double, ts timestamp")
    hours = rollups.rollup(events)
    whole = {r["kind"]: r for r in rollups.read_off(rollups.merged(rollups.merged(hours, "1 day"))).collect()}
    assert set(whole) == {"a", "b"}
    for kind, r in whole.items():
        own = [d for d in data if d[0] == kind]
        values = sorted(d[2] for d in own if d[2] is not None)
        assert r["calls"] == len(own) and abs(r["mean"] - sum(values) / len(values)) < 1e-9 and r["most"] == values[-1]
        assert abs(r["users"] - len({d[1] for d in own} - {None})) <= 0.05 * r["users"]
        assert abs(sum(v <= r["quantile"] for v in values) / len(values) - 0.5) < 0.03
    days = rollups.merged(hours, "1 day")
    assert days.agg(F.sum("calls")).first()[0] == 30_001 and days.where("kind = 'a'").count() == 5
    assert rollups.read_off(rollups.merged(rollups.rollup(events.limit(0)))).count() == 0
