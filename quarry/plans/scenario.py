"""The given tables read as files, bots, questions and entities, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import DIMENSIONS
from quarry.operators.ingest import all_embedded, embedded, fixed_chunk_rows
from quarry.operators.search import knn
from quarry.sources.scratch import scratch_path, stored
from quarry.sources.store import ChunkStore

FORMATS = (".pdf", ".docx", ".DOC", ".pptx", ".TXT", ".csv")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Documents in fewer files than there are cores are dealt out first, as one
    file with one row group is one task; a large corpus has files enough and is read as it lies."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and len(rows.inputFiles()) < cores else rows


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a file of the bot its source names."""
    docs = table(spark, sf_dir, "documents")
    rest = F.col("doc_id") % len(FORMATS)  # below zero for ids below zero, which have the last format
    suffix = F.element_at(F.array(*map(F.lit, FORMATS)), F.when(rest < 0, len(FORMATS)).otherwise(rest + 1).cast("int"))
    return docs.select("doc_id", F.col("source").alias("bot_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), suffix).alias("file_name"), "text", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"))


FILES = "files AS (SELECT doc_id, source AS bot_id, 'doc' || doc_id || (CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.DOC' WHEN 3 THEN '.pptx' WHEN 4 THEN '.TXT' ELSE '.csv' END) AS file_name, text, sha256(text) AS file_hash, strlen(text)::BIGINT AS file_size FROM documents)"

KEYS = ["doc_id", "bot_id", "file_name", "file_hash"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_chunk_rows(files(spark, sf_dir), KEYS)


SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CHUNKS = FILES + """,
places AS (SELECT *, unnest(range(0, ((greatest(length(text) - 20, 1) - 1) // 380) + 1))::INT AS chunk_index, (((greatest(length(text) - 20, 1) - 1) // 380) + 1)::INT AS total_chunks FROM files),
chunks AS (SELECT doc_id, bot_id, file_name, file_hash, total_chunks, chunk_index, substr(text, chunk_index * 380 + 1, 400) AS content FROM places WHERE regexp_matches(substr(text, chunk_index * 380 + 1, 400), '""" + f"[^{SPACE[1:-2]}]'))"


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, '\\A{SPACE}|{SPACE}\\z', '', 'g')"


def cleaned(column: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({column}, '{SPACE}', ' ', 'g'), '[^A-Za-z0-9_ .-]', '', 'g')))"


def buckets(name: str, source: str, key: str, column: str) -> str:
    """CTEs: name_t (key, bucket, n) and name_n (key, length) of the feature hashing of a text."""
    return f"""{name}_w AS (SELECT {key}, unnest(list_filter(string_split({cleaned(column)}, ' '), lambda x: x <> '')) AS t FROM {source}),
{name}_t AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM {name}_w GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(n * n)) AS length FROM {name}_t GROUP BY {key})"""


#: Questions are dealt out to so many bots, of which some own no files.
ASKED_BOTS = 25
BOT_OF = f"'src' || (item_id % {ASKED_BOTS})"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions, each to one bot."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % ASKED_BOTS).cast("string")).alias("bot_id"), F.col("text").alias("question"))


CHUNKS_A_FILE = 1_000_000


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all files with their vectors and a number that orders them by file and place."""
    own = chunks(spark, sf_dir).withColumn("cid", F.col("doc_id") * CHUNKS_A_FILE + F.col("chunk_index"))
    return all_embedded(embedded(own))


#: Snapshots of stores that this application has filled: files are taken in once, questions are asked often.
_filled: dict[tuple[str, str], DataFrame] = {}


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all files as the store holds them, with ``cid``, ``doc_id`` and ``chunk_index``.

    The store leaves out rows without a vector: as one that should be there fails the job
    (``vectors``), these are texts that are empty once cleaned.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _filled:
        store = ChunkStore(spark, scratch_path(spark, "store"), DIMENSIONS).create()
        # taken in as they are made: no filter is pushed below the function that makes vectors
        store.append_chunks(vectors(spark, sf_dir), "2024-01-01T00:00:00.000Z", F.col("doc_id"))
        _filled[key] = store.snapshot()
    m = F.col("metadata")
    doc = F.regexp_extract(m["fileName"], "^doc([0-9]+)", 1).cast("long")
    place = m["chunkIndex"].alias("chunk_index")
    return _filled[key].select((doc * CHUNKS_A_FILE + m["chunkIndex"]).alias("cid"), doc.alias("doc_id"), "bot_id", m["fileName"].alias("file_name"), m["fileHash"].alias("file_hash"), place, "content", "embedding")


def hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The k nearest of its bot's stored chunks for every question, with their texts joined back after ranking.

    What was found is written first, so that it is sent to the chunks only where it is small.
    """
    asked = all_embedded(embedded(questions(spark, sf_dir), "question"))
    chunks = searchable(spark, sf_dir)
    found = knn(asked, chunks.select("cid", "bot_id", "embedding"), k, "query_id", "cid", by="bot_id")
    return chunks.drop("embedding").join(stored(found, "hits"), "cid")


HITS = CHUNKS + f""",
numbered AS (SELECT *, doc_id * {CHUNKS_A_FILE} + chunk_index AS cid FROM chunks),
{buckets("c", "numbered", "cid", "content")},
{buckets("q", "benchmark", "item_id", "text")},
c_v AS (SELECT cid, bot_id, bucket, (n / length)::FLOAT::DOUBLE AS v FROM c_t JOIN c_n USING (cid) JOIN numbered USING (cid)),
c_l AS (SELECT cid, sqrt(sum(v * v)) AS length FROM c_v GROUP BY cid),
dots AS (SELECT item_id AS query_id, cid, sum(q_t.n * v) AS d FROM q_t JOIN c_v ON c_v.bucket = q_t.bucket AND c_v.bot_id = {BOT_OF} GROUP BY ALL),
near AS (SELECT query_id, cid, 1 - d / (q_n.length * c_l.length) AS distance FROM dots JOIN q_n ON q_n.item_id = query_id JOIN c_l USING (cid)),
hits AS (SELECT query_id, numbered.*, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), cid) AS rank FROM near) JOIN numbered USING (cid) WHERE rank <= 10)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities with an embedded owner (nation, region) and members (priorities of their orders)."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    members = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("users"), F.count("*").alias("orders"))
    owner = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("c_nationkey"), F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("owner"))
    return c.join(F.broadcast(owner), "c_nationkey").join(members.hint("merge"), "c_custkey", "left").withColumn("users", F.coalesce("users", F.array().cast("array<string>"))).withColumn("orders", F.coalesce("orders", F.lit(0)))


CUSTOMERS = """customers AS (SELECT c.*, n_name AS nation, r_name AS region, coalesce(users, []) AS users, coalesce(orders, 0) AS orders
FROM customer c JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS users, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
