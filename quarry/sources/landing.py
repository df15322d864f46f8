"""Landing folder: files of each bot under ``<folder>/<bot_id>/<name>``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import base_name, extension

TEXT_FORMATS = ("txt",)
EXTRACTED_FORMATS = ("pdf", "docx", "doc", "pptx")
SUPPORTED = TEXT_FORMATS + EXTRACTED_FORMATS
FILES = "path string, modificationTime timestamp, length long, content binary"


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(bot_id, file_name, file_size, file_hash, extension, content) of every file."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def described(files: DataFrame) -> DataFrame:
    name = base_name(F.col("path"))
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("bot_id"), name.alias("file_name"), F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("file_hash"), extension(name).alias("extension"), "content", F.col("modificationTime").alias("landed_at"),
    )


def split_by_support(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with a known extension, and the rest with the reason why they are rejected."""
    known = F.coalesce(F.col("extension").isin(*SUPPORTED), F.lit(False))
    return files.where(known), files.where(~known).withColumn("error", F.concat(F.lit("Unsupported file type: "), "extension"))


def extracted_text(files: DataFrame, extract: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """Adds ``text``: text files decoded in place, others by the caller's ``extract(extension, bytes)``.

    A file that ``extract`` fails on gets an ``error`` and no text.
    """
    plain = files.where(F.col("extension").isin(*TEXT_FORMATS)).withColumn("text", F.decode("content", "UTF-8")).withColumn("error", F.lit(None).cast("string")).drop("content")
    if extract is None:
        return plain

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for kind, content in zip(batch["extension"], batch["content"]):
                try:
                    texts.append(extract(kind, bytes(content)))
                    errors.append(None)
                except Exception as error:  # a broken file is a row of the reject table
                    texts.append(None)
                    errors.append(str(error))
            yield batch.drop(columns="content").assign(text=texts, error=errors)

    others = files.where(~F.col("extension").isin(*TEXT_FORMATS))
    return plain.unionByName(others.mapInPandas(run, plain.schema))
