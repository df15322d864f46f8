"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, stored
from quarry.llm.conversation_repair import SQL as REPAIR_SQL
from quarry.llm.conversation_repair import damaged, repair
from quarry.llm.decontamination import leaks
from quarry.llm.divergence import SQL as DIVERGENCE_SQL
from quarry.llm.divergence import source_divergence
from quarry.llm.exact_dedup import SQL as EXACT_DEDUP_SQL
from quarry.llm.exact_dedup import exact_groups
from quarry.llm.licenses import license_digest, license_scan
from quarry.llm.line_dedup import SQL as LINE_DEDUP_SQL
from quarry.llm.line_dedup import line_dedup
from quarry.llm.packing import pack
from quarry.llm.quotes import CONVERSATIONS_SQL, conversations, reply_ordered, with_quotes
from quarry.llm.quotes import SQL as QUOTES_SQL
from quarry.llm.simhash import near_duplicates
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.token_blocks import token_blocks
from quarry.llm.token_counts import token_counts
from quarry.llm.toxicity import toxicity

#: Where the vocabulary files are; a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), digest=True).withColumnRenamed("text", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over the conversations with quotes put in, built into whole threads."""
    messages = stored(with_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "quoted-messages")
    built = conversations(reply_ordered(messages))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return built.select("conv_id", "thread", "part", F.size("messages").cast("long").alias("n_messages"), "n_quotes", "n_linked", text.alias("conversation"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(documents(spark, sf_dir)))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(rows), rows)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_quotes": op8_quotes,
    "quoted_conversations": quoted_conversations,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_structure_repair": op12_structure_repair,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": LINE_DEDUP_SQL,
    "op8_quotes": QUOTES_SQL,
    "quoted_conversations": CONVERSATIONS_SQL,
    "op9_exact_dedup": EXACT_DEDUP_SQL,
    "op12_structure_repair": REPAIR_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
