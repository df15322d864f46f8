"""Corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of ``documents``, whatever their names; the last
returns pieces. A null text is an empty one. Rows with null or repeated ids are judged one
by one, by their own texts. An empty table passes through. Counted as part of ``quarry.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import rows_of, stored
from quarry.llm.decontamination import without_leaks
from quarry.llm.exact_dedup import drop_copies
from quarry.llm.near_copies import near_copies
from quarry.llm.packing import pack
from quarry.llm.queries import WORD_BPE
from quarry.llm.toxicity import without_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 2 does not predict to be toxic, each row judged by its own text.

    Null and empty texts are judged like any other, null and repeated ids too.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, by operator 9."""
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-copies by operator 3: texts that share 0.8 of their shingles of five words.

    The row of the smallest id stays, of equal ids that of the least text hash; a null id is
    larger than any other. Texts without words are copies of each other.
    """
    found = stored(near_copies(docs).where("kept").select("doc_id", "row"), "kept-documents")
    return rows_of(docs, found, "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 5 finds no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences, by operator 10."""
    return pack(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
