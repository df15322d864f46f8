"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every word-based operator: runs of anything but ASCII white space.
#: ``bytes.split()`` cuts at the same six characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (spark.checkpoint.dir).

    Where a local session names none, as in tests, one is made and set. On a cluster a
    folder of one machine would lose rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that matter, under fixed names; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_hash(text: Column) -> Column:
    """Tells rows of one id apart by their texts; tasks compute the same with ``text_hash``."""
    return F.xxhash64(text)


def text_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8"), 42)
    return h - (1 << 64) if h >> 63 else h


def rows_of(docs: DataFrame, chosen: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text hash are (``left_semi``) or are not (``left_anti``) in ``chosen`` (doc_id, row)."""
    own = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).cast("long").alias("__id"), row_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"))
    other = chosen.select(F.col("doc_id").alias("__chosen"), F.col("row").alias("__text")).distinct()
    joined = own.join(other.hint("merge"), own["__id"].eqNullSafe(other["__chosen"]) & (own["__hash"] == other["__text"]), how)
    return joined.select("__row.*")


def ship_file(spark: SparkSession, path: str) -> None:
    """Sends a vocabulary file to the executors, which may not have it under its path."""
    if os.path.basename(path) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)


def local_file(path: str) -> str:
    """Where a shipped file is on this machine."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
