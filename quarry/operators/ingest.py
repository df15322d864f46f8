"""From landed files to chunks, vectors and a file catalogue."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_text, fixed_chunks, has_text, preview, trimmed
from quarry.functions.vectors import DIMENSIONS, hashed_counts


def new_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content a bot does not hold yet; the same file may live in two bots."""
    return files.join(stored.select("bot_id", "file_hash").distinct(), ["bot_id", "file_hash"], "left_anti")


def first_of_each(files: DataFrame, order: str) -> DataFrame:
    """One row for each bot and content: the first by ``order``. Copies are aggregated before they are shuffled."""
    least = files.groupBy("bot_id", "file_hash").agg(F.min(order).alias(order))
    return files.join(least, ["bot_id", "file_hash", order], "left_semi")


def joined_pages(pages: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Pages of each file in order, one line each, trimmed."""
    in_order = F.array_sort(F.collect_list(F.struct(order, text)))
    whole = F.array_join(F.transform(in_order, lambda p: p[text]), "\n")
    return pages.groupBy(*keys).agg(trimmed(whole).alias("content"), F.count("*").alias("pages"))


def flag_empty(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``empty``, whether a file has no text, and ``preview``, what an empty one has instead."""
    empty = ~has_text(F.col(text))
    return files.withColumn("empty", empty).withColumn("preview", F.when(F.col("empty"), preview(F.col(text))))


def chunk_rows(files: DataFrame, chunks: Column, keys: list[str]) -> DataFrame:
    """A row a chunk: its place from 0 and the number of chunks of the file.

    Blank chunks are left out after they are numbered, so places may have gaps while the
    total stays.
    """
    numbered = files.withColumn("chunks", chunks)
    rows = numbered.select(*keys, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "content"))
    return rows.where(has_text(F.col("content")))


def chunk_id(*keys: str) -> Column:
    """The same chunk has the same id however often it is written."""
    return F.xxhash64(*keys, "chunk_index")


def fixed_chunk_rows(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return chunk_rows(files, fixed_chunks(F.col(text)), keys)


Embed = Callable[[list[str]], "np.ndarray | list[list[float]]"]


def embedded(rows: DataFrame, text: str = "content", dimensions: int = DIMENSIONS, embed: Embed | None = None) -> DataFrame:
    """Adds ``embedding``, the cleaned text through a model, normalised, ``empty_text`` and ``error``.

    ``embed`` takes a batch of cleaned texts and gives a vector for each; without one, words
    are hashed to ``dimensions`` features. A text that is empty once cleaned is flagged and not
    embedded: its vector is null and so is its error. Where the model fails on a batch, or gives
    anything but one vector of finite numbers for a text, the vector is null and ``error`` says
    why; hashing needs no model, so where that fails the job fails. A zero vector stays as it is.
    """
    hook = embed or (lambda texts: hashed_counts(texts, dimensions))

    @F.pandas_udf("embedding array<double>, error string")
    def vectors(cleaned: pd.Series) -> pd.DataFrame:
        out, errors = np.full(len(cleaned), None, object), np.full(len(cleaned), None, object)
        some = np.nonzero((cleaned.fillna("") != "").to_numpy())[0]
        if len(some):
            try:
                found = np.asarray(hook(cleaned.iloc[some].tolist()), np.float64)
                if found.ndim != 2 or len(found) != len(some):
                    raise ValueError(f"{len(some)} texts, but vectors of the shape {found.shape}")
            except Exception as error:  # a failed call is error rows that the caller sees
                if embed is None:
                    raise
                errors[some] = f"Not embedded: {error}"
            else:
                length = np.sqrt((found * found).sum(axis=1, keepdims=True))
                for k, v, whole in zip(some.tolist(), found / np.where(length > 0, length, 1.0), np.isfinite(found).all(axis=1)):
                    if whole:
                        out[k] = v
                    else:
                        errors[k] = "Not embedded: the vector is not finite"
        return pd.DataFrame({"embedding": out, "error": errors})

    clean = rows.withColumn("__clean", F.coalesce(clean_text(F.col(text)), F.lit("")))
    made = clean.withColumn("__made", vectors.asNondeterministic()("__clean"))
    return made.withColumns({"embedding": F.col("__made.embedding"), "empty_text": F.col("__clean") == "", "error": F.col("__made.error")}).drop("__clean", "__made")


def all_embedded(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``embedded`` without ``error``: a job that reads the vectors fails, and says why, where a
    text that is not empty has none of ``dimensions`` numbers. What searches rows that lack some looks whole."""
    v = F.col("embedding")
    missing = ~F.col("empty_text") & (v.isNull() | (F.size(v) != dimensions))
    why = F.coalesce("error", F.concat(F.lit("Not embedded: the vector has numbers: "), F.size(v).cast("string")), F.lit("Not embedded: there is no vector"))
    return rows.withColumn("embedding", F.when(missing, F.raise_error(why)).otherwise(v)).drop("error")


def dimension_violations(vectors: DataFrame, dimensions: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector is missing, has another length or holds nulls."""
    v = F.col(column)
    return vectors.where(v.isNull() | (F.size(v) != dimensions) | F.exists(v, lambda x: x.isNull()))


def gate(chunks: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Total and processed chunks of each file, and whether the file is complete: all or nothing.

    Blank chunks, which have no row, count as processed; a row that is not ``ok``, or of which
    that is unknown, does not.
    """
    failed = F.count_if(~F.coalesce(ok, F.lit(False)))
    counted = chunks.groupBy(*keys).agg(F.max("total_chunks").cast("long").alias("total"), failed.alias("failed"))
    return counted.select(*keys, "total", (F.col("total") - F.col("failed")).alias("processed"), (F.col("failed") == 0).alias("complete"))


def catalogue(files: DataFrame, gates: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue rows of the complete files."""
    return files.join(gates.where("complete").select(*keys).hint("merge"), keys, "left_semi")
