"""A stored index for approximate search: inverted cells of product-quantised residuals.

Every vector lies in the cell of its nearest centre. What it differs from the centre by is
cut into subspaces and each part replaced by the number of the nearest word of that
subspace's codebook, so that a vector is one byte a subspace. Codes and vectors lie in a
folder for each cell: a search reads the folders that its questions probe, multiplies blocks
of questions with what the codes stand for, and only the best of those are compared by their
own vectors.

Centres and codebooks are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.vectors import cosine_distance, l2_normalize
from quarry.operators.search import ROUNDED, TOP, ivf_cells, matrix_of, planned_cells, ranked
from quarry.sources.scratch import stored

#: Vectors that centres and codebooks are fitted on at most, words of a codebook, and dimensions of a subspace.
SAMPLE, WORDS, WIDTH = 20_000, 256, 4
#: Vectors of a packed row of codes, and questions of a block.
PACKED, ASKED = 4096, 128
#: Codes of a tile, which a task meets a block of questions with (24 MB of 64 dimensions), and those it multiplies at a time.
TILE, HELD = 1 << 20, 1 << 16
#: Questions whose cells are found at a time.
ROWS = 1024
#: Squared distance of what is at no distance: beyond all others, as unit vectors are not far apart.
BEYOND = 1e6
CODES = "slice bigint, ids binary, codes binary, n int, cell int"
VECTORS = "id bigint, embedding array<float>, cell int"
CENTRES = "cell int, centre array<double>"
WORDS_DDL = "part int, words binary"


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def nearest_of(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    far = (centres * centres).sum(axis=1)[None, :] / 2 - rows @ centres.T
    if n == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def fitted_words(rows: np.ndarray, words: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A codebook of one subspace by k-means; with no more different rows than words it holds them all."""
    some = np.unique(rows, axis=0)
    if len(some) <= words:
        return some
    book = some[np.random.default_rng(seed).choice(len(some), words, replace=False)]
    for _ in range(rounds):
        own = nearest_of(rows, book, 1)[:, 0]
        count = np.bincount(own, minlength=words)
        total = np.stack([np.bincount(own, rows[:, d], words) for d in range(rows.shape[1])], axis=1)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


@dataclass(frozen=True)
class Quantiser:
    """Centres and codebooks: what is sent to tasks. 4,096 centres of 768 dimensions are 25 MB."""

    centres: np.ndarray
    books: list[np.ndarray]

    def cut(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        at = 0
        for book in self.books:
            yield rows[:, at : at + book.shape[1]]
            at += book.shape[1]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([nearest_of(part, book, 1)[:, 0] for part, book in zip(self.cut(residuals), self.books)], axis=1).astype(np.uint8)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of a cell stand for."""
        return self.centres[cell] + np.concatenate([book[codes[:, part]] for part, book in enumerate(self.books)], axis=1)


@dataclass(frozen=True)
class VectorIndex:
    """Codes, vectors, centres and codebooks under one folder. Ids are long; distances are by cosine."""

    spark: SparkSession
    folder: str

    def _write(self, rows: DataFrame, name: str, by_cell: bool = False) -> None:
        (rows.write.partitionBy("cell") if by_cell else rows.write).parquet(f"{self.folder}/{name}")

    def _read(self, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromDDL(ddl)).parquet(f"{self.folder}/{name}")

    def build(self, vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Indexes every row that has a vector. Without ``cells`` their number follows that of the vectors.

        Codes are packed in rows of at most 4,096 vectors, so that a cell of any size is many
        rows; the vectors themselves go into the cell's folder as they are, in single precision.
        Rows without a vector are left out; an empty table makes an index that finds nothing.
        """
        base = stored(vectors.select(F.col(ident).cast("long").alias("id"), F.col(column).cast("array<float>").alias("embedding")).where("embedding IS NOT NULL"), "indexed")
        n = base.count()
        if not n:
            for name, ddl in (("centres", CENTRES), ("words", WORDS_DDL), ("codes", CODES), ("vectors", VECTORS)):
                self._write(self.spark.createDataFrame([], ddl), name)
            return self
        cells = cells or planned_cells(n)[0]
        centres = np.array(ivf_cells(base.select("id", unit_column("embedding").alias("embedding")), cells, SAMPLE, ident="id").clusterCenters())
        self._write(self.spark.createDataFrame([(k, c) for k, c in enumerate(centres.tolist())], CENTRES), "centres")
        self._fit(base, centres)
        quantiser = self.quantiser()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = unit(matrix_of(batch.column("embedding")).astype(np.float64))
                cell = nearest_of(rows, quantiser.centres, 1)[:, 0] if len(rows) else np.zeros(0, np.int64)
                codes = quantiser.codes(rows - quantiser.centres[cell]) if len(rows) else np.zeros((0, 1), np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "embedding", "cell", "code"])

        rows = stored(base.mapInArrow(placed, "id bigint, embedding array<float>, cell int, code binary"), "coded")
        self._write(rows.select("id", "embedding", "cell").hint("rebalance", F.col("cell")), "vectors", by_cell=True)
        sizes = rows.groupBy("cell").agg(F.count("*").alias("__size"))
        slices = F.greatest(F.ceil(F.col("__size") / (PACKED // 2)), F.lit(1))
        dealt = rows.select("id", "cell", "code").join(sizes.hint("shuffle_hash"), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), slices))

        def packed(key: tuple, table: pa.Table) -> Iterator[pa.Table]:
            for at in range(0, len(table), PACKED):
                some = table.slice(at, PACKED)
                ids = some.column("id").to_numpy().astype(np.int64).tobytes()
                yield pa.table({"slice": [key[1].as_py()], "ids": [ids], "codes": [b"".join(some.column("code").to_pylist())], "n": pa.array([len(some)], pa.int32()), "cell": pa.array([key[0].as_py()], pa.int32())})

        def pack(key: tuple, table: pa.Table) -> pa.Table:
            return pa.concat_tables(packed(key, table))

        self._write(dealt.groupBy("cell", "slice").applyInArrow(pack, CODES), "codes", by_cell=True)
        return self

    def _fit(self, base: DataFrame, centres: np.ndarray) -> None:
        """Codebooks, each fitted by a task of its own on the sample's residuals in its subspace."""
        sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        width = WIDTH

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = unit(matrix_of(batch.column("embedding")).astype(np.float64))
                if len(rows):
                    rest = rows - centres[nearest_of(rows, centres, 1)[:, 0]]
                    for part, at in enumerate(range(0, rest.shape[1], width)):
                        own = np.ascontiguousarray(rest[:, at : at + width])
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.shape[1]], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "width", "rows"])

        def fit(key: tuple, table: pa.Table) -> pa.Table:
            width = table.column("width")[0].as_py()
            rows = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, width) for x in table.column("rows").to_pylist()])
            book = fitted_words(rows, WORDS)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([np.array([width], np.float64).tobytes() + book.tobytes()], pa.binary())})

        split = sample.mapInArrow(parts, "part int, width int, rows binary")
        self._write(split.groupBy("part").applyInArrow(fit, WORDS_DDL), "words")

    def quantiser(self) -> Quantiser:
        """Read back from the folder: cells x dimensions numbers, and 256 words of every subspace."""
        centres = np.array([r["centre"] for r in self._read("centres", CENTRES).orderBy("cell").collect()])
        books = []
        for r in self._read("words", WORDS_DDL).orderBy("part").collect():
            data = np.frombuffer(r["words"], np.float64)
            books.append(data[1:].reshape(-1, int(data[0])))
        return Quantiser(centres, books)

    def probed(self, queries: DataFrame, probes: int, query: str = "query_id", column: str = "embedding") -> DataFrame:
        """(q, v, cells): the cells each question looks into, those with the nearest centres."""
        quantiser = self.quantiser()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column("v").is_valid())
                for at in range(0, len(batch) if len(quantiser.centres) else 0, ROWS):
                    some = batch.slice(at, ROWS)
                    cells = nearest_of(unit(matrix_of(some.column("v"))), quantiser.centres, probes)
                    ends = pa.array(np.arange(len(some) + 1) * cells.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([some.column("q"), some.column("v"), pa.ListArray.from_arrays(ends, pa.array(cells.ravel(), pa.int32()))], names=["q", "v", "cells"])

        asked = queries.select(F.col(query).cast("long").alias("q"), F.col(column).cast("array<double>").alias("v"))
        return stored(asked.mapInArrow(near, "q bigint, v array<double>, cells array<int>"), "probes")

    def search(self, queries: DataFrame, k: int = TOP, probes: int | None = None, refine: int | None = None, query: str = "query_id", ident: str = "vec_id", column: str = "embedding") -> DataFrame:
        """(query, id, distance, rank): the k nearest among the ``refine`` best of the probed cells.

        ``probes`` is a tenth of the cells unless given, ``refine`` ten times k. A unit of work is a
        block of some 128 questions by a tile of codes, and hands on ``refine`` candidates a
        question at most; candidates meet their vectors by id within their cell.
        """
        found = self.candidates(queries, probes, refine or 10 * k, query, column)
        cells = [r["cell"] for r in found.select("cell").distinct().collect()]  # one number a cell at most
        asked = stored(queries.select(F.col(query).cast("long").alias("q"), F.col(column).cast("array<double>").alias("__asked")), "questions")
        own = self._read("vectors", VECTORS).where(F.col("cell").isin(cells))
        both = own.join(found.select("q", "id", "cell").hint("merge"), ["cell", "id"]).join(asked.hint("shuffle_hash"), "q")
        return ranked(both.select(F.col("q").alias(query), F.col("id").alias(ident), exact("__asked", "embedding").alias("distance")), k, query, ident)

    def candidates(self, queries: DataFrame, probes: int | None, refine: int, query: str = "query_id", column: str = "embedding") -> DataFrame:
        """(q, id, cell): the ``refine`` vectors of each question whose codes are nearest."""
        quantiser = self.quantiser()
        probed = self.probed(queries, probes or max(1, len(quantiser.centres) // 10), query, column)
        near, tiles = self.near(probed, quantiser, refine)
        return stored((near if tiles == 1 else ranked(near, refine, "q", "id")).select("q", "id", "cell"), "candidates")

    def near(self, probed: DataFrame, quantiser: Quantiser, refine: int) -> tuple[DataFrame, int]:
        """(q, id, cell, distance) by code, at most ``refine`` a question and tile, and the number of tiles.

        Each block of questions is dealt to each tile: a question's cells meet in one task, however many
        cells and tasks there are.
        """
        cells = [r["cell"] for r in probed.select(F.explode("cells").alias("cell")).distinct().collect()]
        codes = self._read("codes", CODES).where(F.col("cell").isin(cells))
        blocks = max(1, -(-probed.count() // ASKED))
        tiles = max(1, -(-(codes.agg(F.sum("n")).first()[0] or 0) // TILE))
        number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = probed.select("q", "v", "cells", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), number(tiles).alias("tile"))
        right = codes.select("cell", "ids", "codes", F.pmod(F.xxhash64("cell", "slice"), F.lit(tiles)).cast("int").alias("tile"), number(blocks).alias("block"))
        found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(lambda asked, own: nearest_codes(asked, own, quantiser, refine), "q bigint, id bigint, cell int, distance double")
        return found, tiles

    def visited(self, queries: DataFrame, probes: int | None = None, refine: int = 10 * TOP, query: str = "query_id", column: str = "embedding") -> DataFrame:
        """One row: questions, vectors, and the shares of all pairs that are looked at by code and by
        vector, and of the bytes that comparing whole vectors would read."""
        quantiser = self.quantiser()
        probed = self.probed(queries, probes or max(1, len(quantiser.centres) // 10), query, column)
        sizes = self._read("codes", CODES).groupBy("cell").agg(F.sum("n").alias("n"))
        of = probed.select("q", F.explode("cells").alias("cell")).join(sizes.hint("shuffle_hash"), "cell").groupBy("q").agg(F.sum("n").alias("coded"))
        whole = sizes.agg(F.sum("n").alias("vectors"))
        wide = 4.0 * quantiser.centres.shape[1]
        pairs = F.col("questions") * F.col("vectors")
        one = of.agg(F.count("*").alias("questions"), F.sum("coded").alias("coded"), F.sum(F.least("coded", F.lit(refine))).alias("compared")).join(F.broadcast(whole))
        return one.select("questions", "vectors", (F.col("coded") / pairs).alias("coded_share"), (F.col("compared") / pairs).alias("compared_share"), ((F.col("coded") * (8 + len(quantiser.books)) / wide + F.col("compared")) / pairs).alias("byte_share"))


def unit_column(column: str) -> Column:
    return l2_normalize(F.col(column))


def exact(asked: str, column: str) -> Column:
    return cosine_distance(F.col(asked), F.col(column))


def best_of(q: np.ndarray, ids: np.ndarray, cells: np.ndarray, far: np.ndarray, refine: int) -> tuple[np.ndarray, ...]:
    """The rows of the ``refine`` nearest of each question, ties by id."""
    order = np.lexsort((ids, np.round(far, ROUNDED), q))
    q = q[order]
    start = np.r_[True, q[1:] != q[:-1]][: len(q)]
    turn = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    order = order[turn < refine]
    return q[turn < refine], ids[order], cells[order], far[order]


def nearest_codes(asked: pa.Table, own: pa.Table, quantiser: Quantiser, refine: int) -> pa.Table:
    """The ``refine`` nearest codes of each question of a block among those of a tile whose cells it
    looks into, ties by id. Distances are those to what the codes stand for."""
    names, n = asked.column("q").to_numpy(), len(asked)
    rows = unit(matrix_of(asked.column("v"))) if n else np.zeros((0, quantiser.centres.shape[-1]))
    lengths = (rows * rows).sum(axis=1)
    looks = np.zeros((n, len(quantiser.centres)), bool)
    lists = asked.column("cells").combine_chunks()
    looks[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)] = True
    held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.float64))
    limit = np.full(n, np.inf)  # of each question, its farthest that is held, where it holds ``refine``
    units: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []

    def cut() -> None:
        nonlocal held
        sizes = [len(ids) for _, ids, _, _ in units]
        far = np.full((n, sum(sizes)), np.inf)
        for at, (who, ids, _, d) in zip(np.cumsum([0, *sizes]), units):
            far[who, at : at + len(ids)] = d
        bound = limit
        if far.shape[1] > refine:
            bound = np.minimum(limit, np.partition(far, refine - 1, axis=1)[:, refine - 1])
        # all ties of the last are kept until they are cut by id
        q, at = np.nonzero((far <= bound[:, None] + 10.0**-ROUNDED) & (far < np.inf))
        ids, cells = np.concatenate([u[1] for u in units]), np.repeat(np.array([u[2] for u in units], np.int32), sizes)
        held = best_of(*(np.concatenate(x) for x in zip(held, (q, ids[at], cells[at], far[q, at]))), refine)
        full = np.bincount(held[0], minlength=n) >= refine
        last = np.full(n, -np.inf)
        np.maximum.at(last, held[0], held[3])
        limit[full] = last[full]
        units.clear()

    size = 0
    for cell, ids, codes in zip(*(own.column(c).to_pylist() for c in ("cell", "ids", "codes"))):
        who = np.nonzero(looks[:, cell])[0]
        if not len(who):
            continue
        ids = np.frombuffer(ids, np.int64)
        points = quantiser.decoded(cell, np.frombuffer(codes, np.uint8).reshape(len(ids), -1))
        d = lengths[who, None] + (points * points).sum(axis=1)[None, :] - 2 * rows[who] @ points.T
        units.append((who, ids, cell, np.nan_to_num(d, nan=BEYOND)))
        size += len(ids)
        if size >= HELD:
            cut()
            size = 0
    if units:
        cut()
    q, ids, cells, far = held
    return pa.table({"q": names[q], "id": ids, "cell": cells, "distance": far})
