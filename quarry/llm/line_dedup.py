"""Line dedup by content-defined chunks (operator 7). DataFrame functions only.

A rolling hash over the hashes of a line and the two before it ends a chunk where it is
divisible by ``DIVISOR``. Whether a chunk ends at a line so depends on three lines alone,
and chunks fall into step again after lines are put in or taken out. Chunks of two or more
lines whose bytes stand earlier in the corpus are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewise import chained, xxhash
from quarry.llm.common import id_and_text, stored

DIVISOR = 4


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, lines, chunks): a row's number by its text, and its chunks in order.

    A chunk is (no, n_lines, body), the body without the line end after its last line.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n", -1).alias("lines"))
    hashed = rows.withColumn("h", F.expr("transform(lines, x -> cast(conv(substr(md5(x), 1, 8), 16, 10) AS bigint))"))
    ended = hashed.withColumn("ends", F.expr(f"filter(sequence(0, size(lines) - 1), i -> i = size(lines) - 1 OR (h[i] + 31 * coalesce(get(h, i - 1), 0) + 961 * coalesce(get(h, i - 2), 0)) % {DIVISOR} = 0)"))
    chunk = "named_struct('no', k, 'n_lines', e - coalesce(get(ends, k - 1), -1), 'body', array_join(slice(lines, coalesce(get(ends, k - 1), -1) + 2, e - coalesce(get(ends, k - 1), -1)), '\n'))"
    return ended.select("doc_id", "row", F.size("lines").alias("n_lines"), F.expr(f"transform(ends, (e, k) -> {chunk})").alias("chunks"))


def repeated_chunks(chunks: DataFrame, key_bits: int = 64) -> DataFrame:
    """(doc_id, row, no, n_lines) of every multi-line chunk whose bytes stand earlier in the corpus."""
    # inline_outer, as a filter that the optimizer infers for inline would compute the chunks once for each line
    each = chunks.select("doc_id", "row", F.inline_outer("chunks")).where("n_lines >= 2")
    each = each.select(xxhash(F.col("body"), key_bits).alias("key"), F.struct("doc_id", "row", "no").alias("id"), "n_lines", "body")
    # written, so that both sides of the join are dealt out for it and a key with very many chunks can be split
    keys = stored(each.select("key", "id").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated-keys")
    members = each.join(keys.hint("merge"), "key")
    return chained(members, ["n_lines"]).where(~F.col("id").eqNullSafe(F.col("keep"))).select("id.*", "n_lines")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(doc_id, n_lines, n_chunks, removed_chunks, removed_lines, text) of every row.

    The first of equal chunks, by doc_id and then by place, stays; a null id comes first.
    A null text is one empty line. Rows that repeat an id and a text are treated alike:
    neither removes the other's chunks. Single-line chunks are never removed. An empty table
    gives no rows; other columns are not read. A text is held whole as an array of its lines.
    """
    chunks = chunked(docs, id_col, text_col)
    gone = repeated_chunks(chunks, key_bits).groupBy("doc_id", "row").agg(F.collect_set(F.struct("no", "n_lines")).alias("found"))
    gone = gone.select("doc_id", "row", F.col("found.no").alias("gone"), F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n_lines"]).alias("removed_lines"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("row").alias("g_row"), "gone", "removed_lines")
    joined = chunks.join(gone.hint("merge"), chunks["doc_id"].eqNullSafe(gone["g_id"]) & (chunks["row"] == gone["g_row"]), "left")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(chunks) - 1), coalesce(gone, array())), i -> chunks[i].body), '\n')")
    return joined.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_chunks"), F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"), kept.alias("text"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM e),
r AS (SELECT *, i = n OR (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % {DIVISOR} = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM r),
k AS (SELECT doc_id, no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, no),
m AS (SELECT *, n_lines >= 2 AND row_number() OVER (PARTITION BY body, n_lines >= 2 ORDER BY doc_id, no) > 1 AS gone FROM k)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS removed_chunks,
       coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS removed_lines,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
