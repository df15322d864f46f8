"""Batch vector search: many questions against all vectors, exact and approximate.

A block of questions, which is bounded, is sent to the data: each task multiplies batches of
vectors with the block's matrix and keeps its k best for each question, so that vectors are
never shuffled and no more than k rows a task and question are. More questions than fill a
block are dealt out with the vectors, block by tile. Questions may be tied to groups (a bot's
own vectors, cells of an index): then distances are computed inside groups only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.vectors import cosine_distance, l2_distance
from quarry.sources.scratch import stored

#: Questions in one block: a block of 2,048 of 768 dimensions is 12 MB.
BLOCK = 2048
TOP = 10
ROUNDED = 9
#: Vectors that are multiplied with a block at a time: 16 MB of distances.
ROWS = 1024
#: Vectors of a tile: 100 MB of 768 dimensions.
TILE = 16_384

#: The groups of vectors: (rows, dimensions) -> (rows, memberships) integers.
Groups = Callable[[np.ndarray], np.ndarray]


def ranked(pairs: DataFrame, k: int, query: str, ident: str) -> DataFrame:
    """The k nearest of each question; distances that agree to 9 decimals are ties, broken by id."""
    order = Window.partitionBy(query).orderBy(F.round("distance", ROUNDED), ident)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int = TOP, query: str = "query_id", ident: str = "vec_id", column: str = "embedding", metric: str = "cosine", where: Column | None = None, by: str | None = None) -> DataFrame:
    """(query, id, distance, rank) of the k nearest vectors of each question.

    ``where`` selects vectors before they are ranked. ``by`` names a column of both tables: a
    question meets only vectors with its own value of it, as with a table for each bot. A zero
    vector is at distance NaN of all by cosine, which ranks last; rows without a vector, and
    with ``by`` those without a value, are not searched. Ids are of any type.
    """
    base = vectors.where(where) if where is not None else vectors
    return searched(queries, base, k, query, ident, column, metric, by)


def searched(queries: DataFrame, vectors: DataFrame, k: int, query: str, ident: str, column: str, metric: str = "cosine", by: str | None = None, groups: Groups | None = None, asked_groups: Groups | None = None) -> DataFrame:
    """Search inside the groups of column ``by``, or of the functions ``groups`` (of vectors) and
    ``asked_groups`` (of questions); inside one group of all where there is neither.

    Questions and, where they fill more than one block, vectors are written first, so that
    whatever makes them runs once. Rows without a vector are left out where they are searched:
    a filter would be pushed below a function that makes vectors, and repeat it.
    """
    group = F.col(by) if by else F.lit(0)
    base = vectors.select(F.col(ident).alias("id"), group.alias("g"), F.col(column).cast("array<double>").alias("v"))
    asked = stored(queries.select(F.col(query).alias("q"), group.alias("g"), F.col(column).cast("array<double>").alias("v")), "questions").where("v IS NOT NULL")
    types = {f.name: f.dataType for f in [*asked.select("q").schema, *base.select("id").schema]}
    search = Search(k, metric, pa.schema([("q", to_arrow_type(types["q"])), ("id", to_arrow_type(types["id"])), ("distance", pa.float64())]), groups, asked_groups)
    ddl = f"q {types['q'].simpleString()}, id {types['id'].simpleString()}, distance double"
    n = asked.count()
    found = beside(asked, base, search, ddl) if n <= BLOCK else in_tiles(asked, stored(base, "vectors"), search, ddl, -(-n // BLOCK))
    return ranked(found.withColumnsRenamed({"q": query, "id": ident}), k, query, ident)


def beside(asked: DataFrame, base: DataFrame, search: Search, ddl: str) -> DataFrame:
    """One block of questions is sent to the vectors, which stay where they are."""
    block = base.sparkSession.sparkContext.broadcast(search.asked(asked.toArrow()))
    return base.mapInArrow(lambda batches: search.found(block.value, batches), ddl)


def in_tiles(asked: DataFrame, base: DataFrame, search: Search, ddl: str, blocks: int) -> DataFrame:
    """Blocks of questions and tiles of vectors are dealt out by shuffle, each block to each tile; no
    question passes the driver, and a task holds one block and one tile."""
    tiles = max(1, -(-base.count() // TILE))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("q", "g", "v", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), number(tiles).alias("tile"))
    right = base.select("id", "g", "v", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"), number(blocks).alias("block"))

    def unit(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        return pa.Table.from_batches(search.found(search.asked(questions), vectors.to_batches()), schema=search.schema)

    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(unit, ddl)


def matrix_of(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


class Block(NamedTuple):
    """Questions of one block: names, vectors, lengths, and the places of each group's questions."""

    names: np.ndarray
    matrix: np.ndarray
    length: np.ndarray
    members: dict[object, np.ndarray]


@dataclass(frozen=True)
class Search:
    """The k nearest vectors of each question of a block, in batches of vectors."""

    k: int
    metric: str
    schema: pa.Schema
    groups: Groups | None
    asked_groups: Groups | None

    def asked(self, table: pa.Table) -> Block:
        matrix = matrix_of(table.column("v"))
        own = self.asked_groups(matrix).tolist() if self.asked_groups and len(matrix) else [[g] for g in table.column("g").to_pylist()]
        members: dict[object, list[int]] = {}
        for j, codes in enumerate(own):
            for code in codes:
                members.setdefault(code, []).append(j)
        return Block(np.array(table.column("q").to_pylist(), object), matrix, np.sqrt((matrix * matrix).sum(axis=1)), {c: np.array(m) for c, m in members.items()})

    def distances(self, rows: np.ndarray, matrix: np.ndarray, length: np.ndarray) -> np.ndarray:
        own = np.sqrt((rows * rows).sum(axis=1))
        if self.metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                return 1 - rows @ matrix.T / (own[:, None] * length[None, :])
        return np.sqrt(np.maximum((own**2)[:, None] + (length**2)[None, :] - 2 * rows @ matrix.T, 0))

    def cut(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each question, each vector once."""
        rough = np.nan_to_num(np.round(d, ROUNDED), nan=np.inf)
        code = pd.factorize(ids, sort=True)[0]
        order = np.lexsort((code, rough, q))
        q, code, ids, d = q[order], code[order], ids[order], d[order]
        once = np.r_[True, (q[1:] != q[:-1]) | (code[1:] != code[:-1])][: len(q)]
        q, ids, d = q[once], ids[once], d[once]
        start = np.r_[True, q[1:] != q[:-1]][: len(q)]
        turn = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        return q[turn < self.k], ids[turn < self.k], d[turn < self.k]

    def found(self, block: Block, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, length, members = block
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            for at in range(0, len(batch) if len(names) else 0, ROWS):
                some = batch.slice(at, ROWS)
                rows, ids = matrix_of(some.column("v")), some.column("id").to_numpy(zero_copy_only=False)
                codes = self.groups(rows) if self.groups else some.column("g").to_numpy(zero_copy_only=False)[:, None]
                for t in range(codes.shape[1]):
                    for code in pd.unique(codes[:, t]):
                        asked = members.get(code.item() if hasattr(code, "item") else code)
                        if asked is None:
                            continue
                        of = np.nonzero(codes[:, t] == code)[0]
                        d = self.distances(rows[of], matrix[asked], length[asked])
                        rough = np.nan_to_num(np.round(d, ROUNDED), nan=np.inf)
                        near = np.ones(d.shape, bool) if len(of) <= self.k else rough <= np.partition(rough, self.k - 1, axis=0)[self.k - 1]
                        j, i = np.nonzero(near.T)
                        held.append((asked[j], ids[of[i]], d[i, j]))
                        size += len(j)
                if size > 8 * self.k * len(names) + 100_000:
                    held = [self.cut(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
        if held:
            q, ids, d = self.cut(*(np.concatenate(x) for x in zip(*held)))
            for at in range(0, len(q), 50_000):
                take = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[q[take]].tolist(), self.schema.field(0).type), pa.array(ids[take], self.schema.field(1).type), pa.array(d[take])], schema=self.schema)


def knn_expressions(queries: DataFrame, vectors: DataFrame, k: int = TOP, query: str = "query_id", ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The same as ``knn`` in column expressions, for one block of questions; what the fast form is tested against."""
    if queries.count() > BLOCK:
        raise ValueError(f"at most {BLOCK} questions; use knn")
    asked = queries.select(F.col(query), F.col(column).alias("__asked"))
    distance = cosine_distance(F.col("__asked"), F.col(column))
    return ranked(vectors.join(F.broadcast(asked)).select(query, ident, distance.alias("distance")), k, query, ident)


def nearest(vectors: DataFrame, question: list[float], k: int = TOP, ident: str = "vec_id", column: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k nearest of one question: a top-k without any shuffle of the rest."""
    asked = F.array(*[F.lit(float(x)) for x in question])
    measure = cosine_distance if metric == "cosine" else l2_distance
    return vectors.withColumn("distance", measure(asked, F.col(column))).orderBy(F.round("distance", ROUNDED), ident).limit(k)


def ivf_cells(vectors: DataFrame, cells: int, sample: int = 20_000, column: str = "embedding", ident: str = "vec_id"):
    """Cell centres fitted on ``sample`` vectors at most, those with the smallest hash of their id."""
    chosen = vectors.orderBy(F.xxhash64(ident), ident).limit(sample).select(array_to_vector(column).alias("features"))
    return KMeans(k=cells, seed=1, maxIter=10, initMode="random").fit(chosen)


def knn_ivf(queries: DataFrame, vectors: DataFrame, k: int = TOP, cells: int = 16, probes: int = 12, query: str = "query_id", ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Approximate search: every vector lies in the cell of its nearest centre, and each
    question looks into the ``probes`` cells whose centres are nearest.

    Cells are found where the vectors lie, so that nothing is dealt out by cell. A share of
    about probes / cells of all pairs is visited.
    """
    centres = np.array(ivf_cells(vectors, cells, column=column, ident=ident).clusterCenters())
    half = (centres * centres).sum(axis=1) / 2

    def nearest_cells(rows: np.ndarray, n: int) -> np.ndarray:
        far = half[None, :] - rows @ centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    return searched(queries, vectors, k, query, ident, column, groups=lambda v: nearest_cells(v, 1), asked_groups=lambda v: nearest_cells(v, probes))


def lsh_groups(tables: int, bits: int, seed: int = 3) -> Groups:
    """On which side of ``bits`` random planes a vector lies, in each table."""

    def sides(rows: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(seed).normal(size=(tables * bits, rows.shape[1]))
        side = (rows @ planes.T > 0).reshape(len(rows), tables, bits)
        return (side << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)

    return sides


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int = TOP, tables: int = 16, bits: int = 3, query: str = "query_id", ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Approximate search by random planes: candidates share a bucket in some table and are
    ranked by their true distance where they lie; no pairs are shuffled but the k best of a task."""
    sides = lsh_groups(tables, bits)
    return searched(queries, vectors, k, query, ident, column, groups=sides, asked_groups=sides)


def planned_cells(n: int, dimension_share: float = 0.1) -> tuple[int, int]:
    """(cells, probes) for ``n`` well clustered vectors: about the root of n cells, a tenth of them probed."""
    cells = max(16, min(4096, math.isqrt(n)))
    return cells, max(1, round(cells * dimension_share))


def recall(approximate: DataFrame, exact: DataFrame, query: str = "query_id", ident: str = "vec_id") -> DataFrame:
    """Share of the exact neighbours that the approximate search found, by question."""
    hits = exact.select(query, ident).join(approximate.select(query, ident).withColumn("hit", F.lit(1)).hint("merge"), [query, ident], "left")
    return hits.groupBy(query).agg((F.count("hit") / F.count("*")).alias("recall"))


def multi_hop(queries: DataFrame, vectors: DataFrame, k: int = 3, hops: int = 2, query: str = "query_id", ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Hits of each hop: the second hop asks with the vectors of the first hop's hits.

    (query, id, hop): the least hop at which a vector is reached. With hits of one
    question bounded by k ** hops, the next hop's questions are its distinct hits.
    """
    found = knn(queries, vectors, k, query, ident, column).select(query, ident, F.lit(1).alias("hop"))
    edge = found
    for hop in range(2, hops + 1):
        asked = edge.select(F.col(ident).alias("__from")).distinct().join(vectors.select(F.col(ident).alias("__from"), column).hint("merge"), "__from")
        near = knn(asked, vectors, k, "__from", ident, column).select("__from", F.col(ident).alias("__to"))
        edge = edge.withColumnRenamed(ident, "__from").join(near.hint("merge"), "__from").select(query, F.col("__to").alias(ident), F.lit(hop).alias("hop")).distinct()
        found = found.union(edge)
    return found.groupBy(query, ident).agg(F.min("hop").alias("hop"))
