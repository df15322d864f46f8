"""The chunk store: Parquet tables of chunks and of the file catalogue, partitioned by bot.

Tables are append-only. Deletes are tombstones with a sequence number; what a bot stores
later stands. Ids are hashes of keys, so that a chunk that is written twice is one chunk
when read. A reader that names its bot reads that bot's folders only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNKS = """chunk_id bigint, embedding array<float>, content string,
metadata struct<source:string,timestamp:string,chunkIndex:int,totalChunks:int,fileName:string,fileHash:string>,
seq bigint, bot_id string"""
CATALOGUE = "file_name string, file_size bigint, file_hash string, type string, source string, chunks bigint, seq bigint, bot_id string"
#: A tombstone without a file name hides everything of its bot.
TOMBSTONES = "bot_id string, file_name string, seq bigint"


@dataclass(frozen=True)
class ChunkStore:
    """Chunks, catalogue and tombstones under one folder; vectors have ``dimensions`` numbers."""

    spark: SparkSession
    folder: str
    dimensions: int

    def create(self) -> ChunkStore:
        """Makes the tables where they do not exist; what is there stays."""
        for name, ddl in (("chunks", CHUNKS), ("catalogue", CATALOGUE), ("tombstones", TOMBSTONES)):
            empty = self.spark.createDataFrame([], ddl)
            self._write(empty, name, "ignore")
        return self

    def _write(self, rows: DataFrame, name: str, mode: str = "append") -> None:
        out = rows.write.mode(mode)
        if name != "tombstones":
            out = out.partitionBy("bot_id")
        out.parquet(f"{self.folder}/{name}")

    def _read(self, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromDDL(ddl)).parquet(f"{self.folder}/{name}")

    def append_chunks(self, rows: DataFrame, timestamp: str, seq: Column) -> DataFrame:
        """Appends rows of (bot_id, file_name, file_hash, chunk_index, total_chunks, content, embedding).

        Returns the rows whose vector is missing, holds a null or has other dimensions; these
        are not stored. An empty content is stored as null.
        """
        v = F.col("embedding")
        fits = v.isNotNull() & (F.size(v) == self.dimensions) & ~F.exists(v, lambda x: x.isNull())
        metadata = F.struct(F.col("bot_id").alias("source"), F.lit(timestamp).alias("timestamp"), F.col("chunk_index").alias("chunkIndex"), F.col("total_chunks").alias("totalChunks"), F.col("file_name").alias("fileName"), F.col("file_hash").alias("fileHash"))
        out = rows.where(fits).select(
            F.xxhash64("bot_id", "file_name", "file_hash", "chunk_index").alias("chunk_id"), v.cast("array<float>").alias("embedding"), F.nullif("content", F.lit("")).alias("content"),
            metadata.alias("metadata"), seq.cast("long").alias("seq"), "bot_id",
        )
        self._write(out.hint("rebalance", F.col("bot_id")), "chunks")  # a bot's files, in as many tasks as its bytes need
        return rows.where(~fits)

    def append_files(self, files: DataFrame) -> None:
        """Appends catalogue rows (all columns of CATALOGUE)."""
        self._write(files.select(*StructType.fromDDL(CATALOGUE).fieldNames()), "catalogue")

    def forget_files(self, files: DataFrame) -> None:
        """Hides what the bots stored under these names: (bot_id, file_name, seq)."""
        self._write(files.select("bot_id", "file_name", F.col("seq").cast("long").alias("seq")), "tombstones")

    def replace_files(self, rows: DataFrame, timestamp: str, seq: int) -> DataFrame:
        """Appends chunks as ``append_chunks`` does, in place of all that the bots stored under these names before ``seq``."""
        self.forget_files(rows.select("bot_id", "file_name").distinct().withColumn("seq", F.lit(seq - 1)))
        return self.append_chunks(rows, timestamp, F.lit(seq))

    def drop_bots(self, bots: DataFrame) -> None:
        """Hides all that these bots stored: (bot_id, seq)."""
        self._write(bots.select("bot_id", F.lit(None).cast("string").alias("file_name"), F.col("seq").cast("long").alias("seq")), "tombstones")

    def _alive(self, rows: DataFrame, name: Column) -> DataFrame:
        gone = self._read("tombstones", TOMBSTONES)
        by_file = gone.where("file_name IS NOT NULL").groupBy(F.col("bot_id").alias("__bot"), F.col("file_name").alias("__file")).agg(F.max("seq").alias("__file_seq"))
        by_bot = gone.where("file_name IS NULL").groupBy(F.col("bot_id").alias("__owner")).agg(F.max("seq").alias("__bot_seq"))
        # tombstones are read from files, whose size Spark knows: small ones are sent, others shuffled
        out = rows.join(by_file, (F.col("bot_id") == F.col("__bot")) & (name == F.col("__file")), "left").join(by_bot, F.col("bot_id") == F.col("__owner"), "left")
        return out.where("seq > coalesce(greatest(__file_seq, __bot_seq), seq - 1)").select(*rows.columns)

    def chunks(self, bot: str | None = None) -> DataFrame:
        """Chunks that no later tombstone hides, each once, of one bot or of all: one shuffle by chunk."""
        rows = self._read("chunks", CHUNKS)
        rows = rows if bot is None else rows.where(F.col("bot_id") == bot)
        newest = Window.partitionBy("chunk_id").orderBy(F.desc("seq"))
        once = rows.withColumn("__turn", F.row_number().over(newest)).where("__turn = 1").drop("__turn")
        return self._alive(once, F.col("metadata.fileName"))

    def snapshot(self) -> DataFrame:
        """What the store holds now, written out by bot: searches read it without a shuffle, and with a
        filter on the bot its folders only."""
        path = f"{self.folder}/snapshot-{uuid.uuid4().hex}"
        self.chunks().hint("rebalance", F.col("bot_id")).write.partitionBy("bot_id").parquet(path)
        return self.spark.read.schema(StructType.fromDDL(CHUNKS)).parquet(path)

    def catalogue(self, bot: str | None = None) -> DataFrame:
        rows = self._read("catalogue", CATALOGUE)
        rows = rows if bot is None else rows.where(F.col("bot_id") == bot)
        return self._alive(rows.dropDuplicates(["bot_id", "file_name", "file_hash", "seq"]), F.col("file_name"))
