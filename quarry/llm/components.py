"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a few shuffles over the edges; its result is written to the shared folder,
so nothing depends on an executor that may go. A node with very many neighbours is safe:
its neighbours are only compared with one minimum, which is aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u < v.

    Large: each node's larger neighbours are linked to its smallest neighbour or itself.
    Small: each node's smaller neighbours, and itself, are linked to the smallest of them.
    """
    flipped = edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
    if large:
        pairs = flipped.union(edges.select(F.col("u").alias("n"), F.col("v").alias("m")))
    else:
        pairs = flipped
    # written, so that both sides of the join are dealt out for it and a node with very many neighbours can be split
    least = stored(pairs.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n")), "least")
    joined = pairs.join(least.hint("merge"), "n")
    if large:
        out = joined.where(F.col("m") > F.col("n")).select(F.col("least").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("least").alias("u"), F.col("m").alias("v")).union(least.select(F.col("least").alias("u"), F.col("n").alias("v")))
    return out.where("u < v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), component the smallest node reachable.

    Nulls and loops are ignored; repeated and reversed edges count once.
    """
    now = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = stored(now, "edges")
    before = None
    for _ in range(max_rounds):
        now = stored(star(star(now, True), False), "edges")
        # stars with equal sums of their ends over as many edges: nothing moved
        after = tuple(now.agg(F.count("u"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())
