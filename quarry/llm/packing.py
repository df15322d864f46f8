"""Best-fit packing by patterns and non-negative least squares (operator 10).

Only the histogram of piece lengths, at most ``capacity`` numbers, comes to the driver.
There, patterns of a few lengths that nearly fill a sequence are enumerated; how often to
repeat each is fitted to the histogram by non-negative least squares; the counts are
rounded down, and what they leave is packed by best fit, again length by length. The plan
says which ranks of each length go to which sequences, so that every piece finds its
place from its length and its rank alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, ship_file, stored
from quarry.llm.word_tokens import word_encoder

CAPACITY, END_ID = 2048, 0
#: Lengths tried beside each longest one, most pieces in an enumerated pattern, share of a
#: sequence that a pattern may leave empty, and rounds of the fit.
TRIED, MOST, WASTE, ROUNDS = 24, 4, 1 / 128, 300
#: Beginnings of patterns that are lengthened by one more piece: so many of each number of
#: pieces, evenly spread over all. This bounds the patterns that are tried, not the rows.
BEGUN = 20_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CUT = PIECES + ", part int, turn bigint"
CUT_ARROW = PIECES_ARROW.append(pa.field("part", pa.int32())).append(pa.field("turn", pa.int64()))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and an end id, cut only where longer than ``capacity``.

    ``part`` is the task that cut a piece and ``turn`` how many of its length the task had
    cut before; a task that is run again cuts the same.
    """

    ship_file(docs.sparkSession, tokenizer_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), np.array([END_ID], "<u4")
        part_id, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.encode(text.as_py()).astype("<u4"), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(part), zlib.crc32(part), part_id, seen[len(part)]))
                    seen[len(part)] += 1
            columns = zip(*out) if out else [[]] * len(CUT_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, CUT_ARROW)], schema=CUT_ARROW)

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, CUT)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Multisets of at most MOST of the given lengths that nearly fill a sequence; rows padded with 0."""
    present = np.unique(lengths)[::-1].astype(np.int64)
    floor = np.zeros(capacity + 1, np.int64)  # the largest present length up to each number
    floor[present] = present
    floor = np.maximum.accumulate(floor)
    spread = np.unique(np.linspace(0, len(present) - 1, min(len(present), TRIED)).astype(np.int64))
    found = {(int(x),) for x in present if capacity - x <= WASTE * capacity}
    grown = [(int(x),) for x in present]
    for size in range(2, MOST + 1):
        new = set()
        for own in grown:
            space = capacity - sum(own)
            last = int(floor[min(space, own[-1])]) if space > 0 else 0
            while last:
                full = (*own, last)
                if space - last <= WASTE * capacity:
                    found.add(full)
                else:
                    break
                last = int(floor[last - 1])
            if size < MOST and space > 0:
                for x in present[spread]:
                    if x <= min(space, own[-1]):
                        new.add((*own, int(x)))
        grown = sorted(new)[:: -(-len(new) // BEGUN) or 1]
    out = np.zeros((len(found), MOST), np.int64)
    for k, own in enumerate(sorted(found)):
        out[k, : len(own)] = own
    return out


def fit(table: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that makes the patterns' pieces come near the histogram, by multiplicative updates."""
    used = table > 0
    wanted = np.where(used, histogram[table], 0).sum(axis=1)
    x = np.maximum(wanted, 1e-9) / np.maximum(1, len(table))
    for _ in range(ROUNDS):
        made = np.bincount(table.ravel(), np.repeat(x, table.shape[1]) * used.ravel(), len(histogram))
        x = x * wanted / np.maximum(np.where(used, made[table], 0).sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, times) that use up ``histogram``, a count for each length up to capacity."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[list[int], int]] = []

    def take(own: list[int], most: int) -> None:
        kinds, need = np.unique(own, return_counts=True)
        times = int(min(most, (left[kinds] // need).min()))
        if times > 0:
            left[kinds] -= need * times
            out.append((own, times))

    if left.any():
        table = patterns(np.nonzero(left)[0], capacity)
        if len(table):
            x = fit(table, left)
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                take(sorted((int(v) for v in table[k] if v), reverse=True), int(x[k]))
    while left.any():  # best fit of what is left, the longest first
        own = [int(np.nonzero(left)[0][-1])]
        left[own[0]] -= 1
        while True:
            space = capacity - sum(own)
            there = np.nonzero(left[: space + 1])[0] if space > 0 else ()
            if not len(there):
                break
            floor = np.zeros(space + 1, np.int64)
            floor[there] = there
            floor = np.maximum.accumulate(floor)
            second = floor[np.minimum(space - there, there)]
            second = np.where((second == there) & (left[there] < 2), floor[np.maximum(there - 1, 0)] * (floor[np.maximum(there - 1, 0)] <= space - there), second)
            best = int(there[np.lexsort((there, there + second))[-1]])
            own.append(best)
            left[best] -= 1
        for x in own:
            left[x] += 1
        take(own, 1 << 62)
    return out


def places(planned: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the first rank, the sequence it goes to and its offset there."""
    rows, next_rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for own, times in planned:
        offset = 0
        for x in own:
            rows.append((x, next_rank[x], sequence, offset))
            next_rank[x] += times
            offset += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Null and empty texts are pieces of one end id. Null ids and repeated rows are packed
    like any other row. An empty table gives an empty result.
    """
    cut = stored(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` numbers
        histogram[r["length"]] = r["n"]
    slot = places(plan(histogram, capacity), capacity)
    span = np.int64(1 << 44)
    keys = slot["length"] * span + slot["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            found = [pa.array(slot["sequence"][at] + rank - slot["rank"][at]), pa.array(slot["offset"][at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names=[*PIECES_ARROW.names, "sequence_id", "offset"])

    # a row for each length and task, so that even a length that most pieces have is a short window
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = stored(counts.select("length", "part", before.alias("before")), "piece-starts")
    ranks = cut.join(starts.hint("merge"), ["length", "part"]).select(*PIECES_ARROW.names, (F.col("before") + F.col("turn")).alias("rank"))
    return ranks.mapInArrow(place, PACKED)
