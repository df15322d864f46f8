"""A graph of nearest neighbours, exactly or by neighbour descent, and walks over it by joins.

The exact graph deals blocks of vectors out to tiles of vectors, so that a task holds one of
each whatever the table. Its work grows with the square of the vectors, but a pair costs one
product of vectors. Descent compares fewer pairs, and finds enough where vectors are
clustered or few:

A first graph comes from runs of vectors that lie next to each other along random
directions. Then each vector introduces its neighbours to each other: what is near to the
same vector is likely near to each other. Rounds go on until few edges change. No round
compares more than the neighbours of one vector with each other, so the work is about
vectors x neighbours squared and no table of all pairs is formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.search import TOP, knn, matrix_of
from quarry.sources.scratch import stored

#: Neighbours that are held while the graph is made, directions of the first graph, vectors of a run.
HELD, DIRECTIONS, RUN = 24, 6, 256
#: Rounds at most, and the share of edges that change below which they end.
ROUNDS, CHANGED = 10, 0.01
EDGES = "a bigint, b bigint, distance double"
#: Vectors of a tile of the exact graph at most (100 MB of 768 dimensions), at least, and tiles that a table of middle size is dealt into.
TILE, LEAST, TILES = 32_768, 1024, 12
#: Rows and columns whose distances are made at a time, and pairs that are measured again in double precision at a time.
ROWS, COLUMNS, AGAIN = 256, 4096, 50_000


def units(lists: pa.Array) -> np.ndarray:
    rows = matrix_of(lists).astype(np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def nearest_in(ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    """Edges of each vector to its k nearest of the others given; zero vectors are at distance 1 of all."""
    far = 1 - rows @ rows.T
    np.fill_diagonal(far, np.inf)
    k = min(k, len(ids) - 1)
    if k < 1:
        return pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    at = np.argpartition(far, k - 1, axis=1)[:, :k]
    return pa.RecordBatch.from_pydict({"a": np.repeat(ids, k), "b": ids[at].ravel(), "distance": np.take_along_axis(far, at, axis=1).ravel()})


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges inside runs of vectors that come sorted along a direction, runs overlapping by half."""
    ids, rows = np.zeros(0, np.int64), None
    for batch in batches:
        if not len(batch):
            continue
        ids = np.r_[ids, batch.column("id").to_numpy()]
        own = units(batch.column("v"))
        rows = own if rows is None else np.concatenate([rows, own])
        while len(ids) > RUN:
            yield nearest_in(ids[:RUN], rows[:RUN], HELD)
            ids, rows = ids[RUN // 2 :], rows[RUN // 2 :]
    if len(ids):
        yield nearest_in(ids, rows, HELD)


def introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the vectors that each row brings together."""
    for batch in batches:
        for own in batch.column("near"):
            yield nearest_in(own.values.field("id").to_numpy(), units(own.values.field("v")), HELD)


def best(edges: DataFrame, n: int) -> DataFrame:
    """The n nearest of each ``a``, ties by ``b``, with their rank; an edge counts once."""
    once = edges.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("a").orderBy(F.round("distance", 9), "b")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def own_vectors(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """(id, v) of the rows that have a vector, each id once."""
    own = vectors.select(F.col(ident).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    return stored(own.where("v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")), "graph-vectors")


def first_k(of: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each row number in ``of``, ties to nine decimals by id."""
    order = np.lexsort((ids, np.round(far, 9), of))
    of = of[order]
    start = np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]][: len(of)], np.arange(len(of)), 0))
    return order[np.arange(len(of)) - start < k]


def nearest_of_tile(ids: np.ndarray, rows: np.ndarray, others: np.ndarray, tile: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Edges of each vector to its k nearest of a tile, itself not among them.

    Products in single precision, with a margin for their error, tell which pairs are measured
    in double precision.
    """
    small, margin = tile.astype(np.float32), 1e-6 + 2e-7 * tile.shape[1]
    for at in range(0, len(ids), ROWS):
        part, own = rows[at : at + ROWS], ids[at : at + ROWS]
        rough = part.astype(np.float32)
        of, far, to = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        most = np.full(len(own), np.inf)  # the k-th nearest so far
        for left in range(0, len(others), COLUMNS):
            there = others[left : left + COLUMNS]
            d = rough @ small[left : left + len(there)].T
            if left == 0 and len(there) > k:  # itself is one of them at most
                most = 1 - np.partition(d, len(there) - 1 - k, axis=1)[:, len(there) - 1 - k].astype(np.float64)
            x, y = np.divmod(np.flatnonzero(d >= (1 - most - margin).astype(np.float32)[:, None]), len(there))
            other = own[x] != there[y]
            x, y = x[other], y[other]
            exact = [1 - np.einsum("ij,ij->i", part[x[i : i + AGAIN]], tile[left + y[i : i + AGAIN]]) for i in range(0, len(x), AGAIN)]
            of, far, to = np.r_[of, x], np.concatenate([far, *exact]), np.r_[to, there[y]]
            best_ = first_k(of, far, to, k)
            of, far, to = of[best_], far[best_], to[best_]
            full = np.bincount(of, minlength=len(own)) == k
            last = np.r_[of[1:] != of[:-1], True][: len(of)] & full[of]
            most[of[last]] = far[last]
        yield pa.RecordBatch.from_pydict({"a": own[of], "b": to, "distance": far})


def exact_graph(vectors: DataFrame, k: int = TOP, ident: str = "vec_id", column: str = "embedding", tile: int | None = None) -> DataFrame:
    """(a, b, distance, rank): the k nearest others of every vector by cosine, exactly; ties to nine decimals by ``b``.

    Every block of vectors meets every tile of vectors in a task, which hands on the k nearest
    there. Zero vectors are at distance 1 of all. Rows without a vector are left out, repeated
    ids count once; an empty table or a single vector gives no edges. Ids are long.
    """
    base = own_vectors(vectors, ident, column)
    size = tile or TILE
    n = base.count()
    tiles = max(1, -(-n // size), 1 if tile else min(TILES, n // LEAST))
    dealt = base.withColumn("mine", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    all_tiles = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = dealt.select(F.col("id").alias("a"), F.col("v").alias("x"), F.col("mine").alias("block"), all_tiles.alias("tile"))
    right = dealt.select(F.col("id").alias("b"), F.col("v").alias("y"), F.col("mine").alias("tile"), all_tiles.alias("block"))

    def unit(block: pa.Table, others: pa.Table) -> pa.Table:
        found: list[pa.RecordBatch] = []
        if len(block) and len(others):
            found = list(nearest_of_tile(block.column("a").to_numpy(), units(block.column("x")), others.column("b").to_numpy(), units(others.column("y")), k))
        return pa.Table.from_batches(found, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64())]))

    met = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(unit, EDGES)
    order = Window.partitionBy("a").orderBy(F.round("distance", 9), "b")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_graph(vectors: DataFrame, k: int = TOP, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(a, b, distance, rank): about the k nearest others of every vector by cosine, rank from 1.

    An approximation: its recall is measured in the tests (over 0.9 on clustered vectors and on
    500 given ones; of 10,256 given ones it finds too few, see ``exact_graph``). A
    vector introduces its ``HELD`` nearest and the ``HELD`` nearest of those it is near to, so
    that one near to very many is no hot key. Rows without a vector are left out, repeated ids
    count once; an empty table or a single vector gives no edges. Ids are long.
    """
    spark = vectors.sparkSession
    base = own_vectors(vectors, ident, column)
    first = base.limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"{EDGES}, rank int")
    directions = np.random.default_rng(11).normal(size=(DIRECTIONS, len(first[0]["v"])))
    found = None
    for direction in directions.tolist():
        along = F.aggregate(F.zip_with("v", F.array(*map(F.lit, direction)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        ordered = base.select("id", "v", along.alias("along")).repartitionByRange("along", "id").sortWithinPartitions("along", "id")
        edges = ordered.select("id", "v").mapInArrow(runs, EDGES)
        found = edges if found is None else found.union(edges)
    graph = stored(best(found, HELD), "graph")
    for _ in range(ROUNDS):
        turned = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
        met = graph.select("a", "b").union(best(turned, HELD).select("a", "b")).distinct()
        met = met.union(base.select(F.col("id").alias("a"), F.col("id").alias("b")))  # itself among those it brings together
        near = met.join(base.select(F.col("id").alias("b"), "v").hint("merge"), "b").groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("id"), "v")).alias("near"))
        newer = stored(best(graph.select("a", "b", "distance").union(near.select("near").mapInArrow(introduced, EDGES)), HELD), "graph")
        kept, size = newer.join(graph.select("a", "b").hint("merge"), ["a", "b"], "left_semi").count(), newer.count()
        graph = newer
        if size - kept <= CHANGED * size:
            break
    return graph.where(F.col("rank") <= k).select("a", "b", "distance", "rank")


def walked(queries: DataFrame, vectors: DataFrame, graph: DataFrame, k: int = 3, hops: int = 2, query: str = "query_id", ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query, id, hop): the least hop at which a vector is reached; hops after the first follow the graph.

    As in ``search.multi_hop`` a hit asks for its k nearest, itself among them, so a hop leads
    to k - 1 others; no vector is read for it.
    """
    edge = stored(knn(queries, vectors, k, query, ident, column).select(query, F.col(ident).cast("long").alias(ident), F.lit(1).alias("hop")), "first-hop")
    found = edge
    near = graph.where(F.col("rank") < k).select(F.col("a").alias(ident), "b")
    for hop in range(2, hops + 1):
        edge = edge.select(query, ident).join(near.hint("merge"), ident).select(query, F.col("b").alias(ident), F.lit(hop).alias("hop")).distinct()
        found = found.union(edge)
    return found.groupBy(query, ident).agg(F.min("hop").alias("hop"))
