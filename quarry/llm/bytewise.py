"""Groups of equal bodies among rows that share a hash, found by comparing bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def chained(members: DataFrame, others: list[str]) -> DataFrame:
    """(key, id, keep, n, *others) of (key, id, first, n, body, *others).

    ``first`` is the smallest id of the key and ``n`` its number of rows. Each row is
    compared with the body of its key's first row. Those that differ go on down the
    chain: they get a first row of their own, until none is left. As bodies of one hash
    hardly ever differ, there is one round as a rule. A key with very many rows is joined
    with one row and never gathered.
    """
    done = None
    while True:
        # written, so that both sides of the join are dealt out for it and a key with very many rows can be split
        heads = stored(members.where(F.col("id").eqNullSafe(F.col("first"))).groupBy("key").agg(F.min("body").alias("head")), "heads")
        compared = members.join(heads.hint("merge"), "key").withColumn("same", F.col("body") == F.col("head"))
        compared = stored(compared.select("key", "id", "first", "n", "same", F.when(~F.col("same"), F.col("body")).alias("body"), *others), "compared")
        rest = compared.where("not same")
        if rest.isEmpty():
            now = compared.select("key", "id", F.col("first").alias("keep"), "n", *others)
            return done.union(now) if done else now
        again = rest.groupBy("key").agg(F.min("id").alias("next"), F.count("*").alias("m"))
        same = compared.where("same").join(again.hint("merge"), "key", "left")
        now = same.select("key", "id", F.col("first").alias("keep"), F.expr("n - coalesce(m, 0)").alias("n"), *others)
        done = done.union(now) if done else now
        members = rest.join(again.hint("merge"), "key").select("key", "id", F.col("next").alias("first"), F.col("m").alias("n"), "body", *others)


def xxhash(body: Column, bits: int = 64) -> Column:
    """A 64-bit hash; fewer bits make keys collide, for tests."""
    return F.xxhash64(body) if bits == 64 else F.pmod(F.xxhash64(body), F.lit(1 << bits))
