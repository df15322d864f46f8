"""Versions of files by chunk: only what changed is embedded anew.

Edges of chunks are set by the content around them, so that an insertion moves no edge but
those beside it. Chunks of two versions are aligned by their hashes: a chunk that the old
version holds keeps its vector, wherever in the file it stands now.
"""

from __future__ import annotations

import re
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions.text import has_text
from quarry.operators.ingest import Embed, embedded
from quarry.sources.scratch import stored

#: An edge after a word on average, words that set an edge, and words of a chunk at most.
EVERY, SEEN, MOST = 48, 3, 256
#: Words with the white space that follows them: joined they are the text.
WORD = r"[^ \t\r\n]+[ \t\r\n]*|^[ \t\r\n]+"
WORDS = re.compile(WORD)


def cut_text(text: str) -> list[str]:
    words = WORDS.findall(text)
    ends = (i for i in range(1, len(words) + 1) if i == len(words) or int(md5("".join(words[max(i - SEEN, 0) : i]).encode("utf-8")).hexdigest()[:8], 16) % EVERY == 0)
    out, start = [], 0
    for end in ends:
        out += ["".join(words[i : min(i + MOST, end)]) for i in range(start, end, MOST)]
        start = end
    return out


@F.pandas_udf(ArrayType(StringType()))
def cut_texts(text: pd.Series) -> pd.Series:
    return text.map(cut_text)


def content_chunks(text: Column) -> Column:
    """The text cut after words whose last three hash to a multiple of 48, and after 256 words at most.

    The chunks joined are the text; a null or empty text has none. One pass over the words:
    as a column expression each slice would copy all words of the text.
    """
    return cut_texts(F.coalesce(text, F.lit("")))


def version_chunks(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, chunk_index, total_chunks, content, chunk_hash) of each file's text."""
    cut = files.select(*keys, content_chunks(F.col(text)).alias("__chunks"))
    rows = cut.select(*keys, F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("chunk_index", "content"))
    return rows.withColumn("chunk_hash", F.sha2("content", 256))


def aligned(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_hash, turn, status, old_index, new_index): each chunk of either version once.

    Status is kept, new or gone. Of a chunk that a file holds several times, the first of one
    version meets the first of the other, and so on: ``turn`` counts them.
    """
    turn = F.row_number().over(Window.partitionBy(*keys, "chunk_hash").orderBy("chunk_index"))
    a, b = (v.select(*keys, "chunk_hash", turn.alias("turn"), F.col("chunk_index").alias(name)) for v, name in ((old, "old_index"), (new, "new_index")))
    status = F.when(F.col("old_index").isNull(), "new").when(F.col("new_index").isNull(), "gone").otherwise("kept")
    return a.join(b.hint("merge"), [*keys, "chunk_hash", "turn"], "full_outer").withColumn("status", status)


def replaced(old: DataFrame, new: DataFrame, keys: list[str], embed: Embed | None = None) -> DataFrame:
    """Chunks of the new version with their vectors: old ones where the old version holds the chunk.

    ``old`` has chunk_hash and embedding besides; what is new, and has text, is embedded, and has
    an ``error`` where that failed.
    """
    known = old.where("embedding IS NOT NULL").groupBy(*keys, "chunk_hash").agg(F.min(F.col("embedding").cast("array<double>")).alias("__vector"))
    both = stored(new.join(known.hint("merge"), [*keys, "chunk_hash"], "left"), "versions")
    fresh = both.where("__vector IS NULL").drop("__vector").where(has_text(F.col("content")))
    made = embedded(fresh, embed=embed).drop("empty_text").withColumn("reused", F.lit(False))
    rest = both.where(F.col("__vector").isNotNull() | ~has_text(F.col("content"))).withColumnRenamed("__vector", "embedding").withColumns({"reused": F.col("embedding").isNotNull(), "error": F.lit(None).cast("string")})
    return made.unionByName(rest)
