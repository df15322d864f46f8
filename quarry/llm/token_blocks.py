"""Token-ID output in patched frame-of-reference blocks (operator 1).

File format ("segment"), little-endian:

    magic b"QPF1", block size u32, number of ids u64, number of blocks u32
    block index: for each block its byte start in the body, u32
    body: for each block
        minimum u32, width u8, number of exceptions u8
        ids minus the minimum, low ``width`` bits each, packed
        exceptions: positions u8 each, then the bits above the width, u32 each

A block's width is the bit length of the ``PERCENTILE``-th of its differences, so that a
few large ids do not widen the whole block; they are patched from the exception lists.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, partitions, scratch, ship_file
from quarry.llm.word_tokens import word_encoder

MAGIC, BLOCK, PERCENTILE = b"QPF1", 128, 90
HEAD = struct.Struct("<4sIQI")
#: A segment is closed once it has this many ids, so that a task holds one segment at a time.
SEGMENT_IDS = 1 << 20
END_ID = 1


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values -> rows of packed bytes."""
    kind = "<u2" if width <= 16 else "<u4"
    bits = np.unpackbits(values.astype(kind).view(np.uint8), axis=1, bitorder="little")
    bits = bits.reshape(len(values), BLOCK, -1)[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    kind = "<u2" if width <= 16 else "<u4"
    wide = np.zeros((len(packed), BLOCK, 8 * np.dtype(kind).itemsize), np.uint8)
    wide[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    return np.packbits(wide.reshape(len(packed), -1), axis=1, bitorder="little").view(kind)


def encode_segment(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    rank = (BLOCK * PERCENTILE) // 100
    at = np.partition(diff, rank, axis=1)[:, rank] if blocks else low
    width = np.where(at > 0, np.floor(np.log2(np.maximum(at, 1))).astype(np.int64) + 1, 0)
    over = diff >> np.minimum(width, 31).astype(np.uint32)[:, None]
    over[width >= 32] = 0
    block, where = np.nonzero(over)
    exceptions = np.bincount(block, minlength=blocks)
    first = np.cumsum(exceptions) - exceptions
    where, high = where.astype(np.uint8).tobytes(), over[over > 0].astype("<u4").tobytes()
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        own = np.nonzero(width == w)[0]
        size = BLOCK * int(w) // 8
        packed = pack_bits(diff[own], int(w)).tobytes() if w else b""
        for j, (k, least, e, f) in enumerate(zip(own.tolist(), low[own].tolist(), exceptions[own].tolist(), first[own].tolist())):
            body[k] = b"".join((struct.pack("<IBB", least, w, e), packed[j * size : (j + 1) * size], where[f : f + e], high[4 * f : 4 * (f + e)]))
    starts = np.cumsum([0, *map(len, body)])[:-1].astype("<u4") if blocks else np.zeros(0, "<u4")
    return HEAD.pack(MAGIC, BLOCK, n, blocks) + starts.tobytes() + b"".join(body)


def decode_segment(data: bytes) -> np.ndarray:
    magic, block, n, blocks = HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token segment")
    starts = np.frombuffer(data, "<u4", blocks, HEAD.size).astype(np.int64) + HEAD.size + 4 * blocks
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(6)] if blocks else np.zeros((0, 6), np.uint8)
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, exceptions = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        own = np.nonzero(width == w)[0]
        if w:
            size = BLOCK * int(w) // 8
            packed = b"".join([data[at : at + size] for at in (starts[own] + 6).tolist()])
            out[own] = unpack_bits(np.frombuffer(packed, np.uint8).reshape(len(own), size), int(w))
    block = np.repeat(np.arange(blocks), exceptions)
    first = np.cumsum(exceptions) - exceptions
    at = (starts + 6 + BLOCK * width // 8)[block] if blocks else block
    turn = np.arange(len(block)) - first[block]
    high = np.ascontiguousarray(raw[(at + exceptions[block] + 4 * turn)[:, None] + np.arange(4)]).view("<u4").ravel()
    out[block, raw[at + turn]] |= high << width[block].astype(np.uint32)
    return (out + low[:, None]).ravel()[:n]


WRITTEN = "part int, segment int, start bigint, doc_ids array<bigint>, lengths array<bigint>, file binary"
WRITTEN_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("file", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes segments in ascending order of id.

    The text of a row is never split over segments: a segment ends after the document
    that fills it. A row of the written table is one segment file with its documents'
    ids and numbers of tokens; ``part`` and ``segment`` give the order, ``start`` the ids
    of the part before the segment. Null texts are empty (one end id), null ids come
    first, rows of equal ids follow each other.
    """
    spark = docs.sparkSession
    ship_file(spark, tokenizer_path)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = start = 0
        end = np.array([END_ID], "<u2")

        def close() -> pa.RecordBatch:
            file = encode_segment(np.concatenate(ids))
            return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "start": start, "doc_ids": names, "lengths": [len(x) for x in ids], "file": file}], WRITTEN_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(np.concatenate([encoder.encode(text.as_py()), end]))
                names.append(doc_id)
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield close()
                    ids, names, held, segment, start = [], [], 0, segment + 1, start + held
        if ids:
            yield close()

    rows = id_and_text(docs, id_col, text_col).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
    rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(segments, WRITTEN).write.parquet(path)


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Reads segments back; one row per document with its place among all ids and a checksum.

    Where a part starts is a running sum over the parts, of which there are no more than
    shuffle partitions; nothing else leaves the tasks that read the segments.
    """
    files = spark.read.parquet(path)
    by_part = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(by_part):
        before[part], total = total, total + by_part[part]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["file"]).astype("<u4", copy=False)
                ends = np.cumsum(row["lengths"])
                begins = ends - np.array(row["lengths"], np.int64)
                sums = [zlib.crc32(ids[b:e]) for b, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + before[row["part"]] + row["start"]), pa.array(np.array(row["lengths"], np.int64)), pa.array(sums, pa.int64())], schema=READ_ARROW)

    return files.select("part", "start", "doc_ids", "lengths", "file").mapInArrow(check, READ)


def token_blocks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the documents' ids to the shared folder and reads them back.

    An empty table gives an empty result.
    """
    path = scratch(docs.sparkSession, "token-blocks")
    write_tokens(docs, tokenizer_path, path)
    return read_tokens(docs.sparkSession, path)
