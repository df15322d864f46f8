"""Queries of text functions, ingest and model hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_text, extension, fixed_chunks, recursive_chunks
from quarry.functions.vectors import DIMENSIONS, hashing_counts
from quarry.operators import ingest, versions
from quarry.operators.models import expanded, generated, split_errors
from quarry.operators.context import last_turns
from quarry.plans.registry import query
from quarry.plans.scenario import CHUNKS, FILES, KEYS, SPACE, buckets, chunks, cleaned, files, questions, table, trimmed
from quarry.sources.landing import SUPPORTED
from quarry.sources.scratch import scratch_path, stored
from quarry.sources.store import ChunkStore


@query(f"WITH {FILES} SELECT doc_id, bot_id, file_name, file_size, file_hash FROM files")
def ingest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).drop("text")


@query(f"WITH {FILES}, stored AS (SELECT DISTINCT bot_id, file_hash FROM files WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT doc_id, bot_id, file_name, file_hash FROM files WHERE (bot_id, file_hash) NOT IN (SELECT (bot_id, file_hash) FROM stored)")
def dedup_against_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents stand for files that are stored already."""
    landed = files(spark, sf_dir).select(*KEYS)
    stored = landed.join(table(spark, sf_dir, "labels").select("doc_id").hint("merge"), "doc_id", "left_semi")
    return ingest.new_files(landed, stored).select(*KEYS)


OK = "(doc_id * 31 + chunk_index) % 97 <> 0"


@query(f"WITH {CHUNKS} SELECT doc_id, bot_id, max(total_chunks)::BIGINT AS total, max(total_chunks)::BIGINT - count(*) FILTER (NOT ({OK})) AS processed, count(*) FILTER (NOT ({OK})) = 0 AS complete FROM chunks GROUP BY doc_id, bot_id")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th chunk, by a sum of its keys, fails to be stored."""
    return ingest.gate(chunks(spark, sf_dir), ["doc_id", "bot_id"], F.expr(OK))


@query(f"WITH {CHUNKS}, whole AS (SELECT doc_id FROM chunks GROUP BY doc_id HAVING count(*) FILTER (NOT ({OK})) = 0) SELECT doc_id, bot_id, file_name, file_size, file_hash, lower(split_part(file_name, '.', 2)) AS type FROM files WHERE doc_id IN (SELECT doc_id FROM whole)")
def file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).select("doc_id", "bot_id", "file_name", "file_size", "file_hash", extension(F.col("file_name")).alias("type"))
    return ingest.catalogue(own, completeness_gate(spark, sf_dir), ["doc_id"])


@query("SELECT page_id, length(t) = 0 AS empty FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z]+', ' ', 'g')) AS t FROM pages)")
def reject_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages without anything but letters: empty ones are rejected."""
    titles = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-z]+", " ").alias("text"))
    return ingest.flag_empty(titles).select("page_id", "empty")


@query(f"WITH {FILES} SELECT doc_id, file_name, lower(split_part(file_name, '.', 2)) AS extension, lower(split_part(file_name, '.', 2)) IN ('txt', 'pdf', 'docx', 'doc', 'pptx') AS accepted FROM files")
def route_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = extension(F.col("file_name"))
    return files(spark, sf_dir).select("doc_id", "file_name", kind.alias("extension"), kind.isin(*SUPPORTED).alias("accepted"))


@query(f"SELECT conv_id, {trimmed('string_agg(text, chr(10) ORDER BY turn)')} AS content, count(*) AS pages FROM conversations GROUP BY conv_id")
def concat_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.joined_pages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, count(*) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3 GROUP BY conv_id")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_turns(table(spark, sf_dir, "conversations"), 3)


@query(f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents", name="clean_text")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, content FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", "content")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, total_chunks, file_name, file_hash, bot_id, '2024-01-01T00:00:00.000Z' AS timestamp, nullif(content, '') AS content FROM chunks")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows as they are stored; one timestamp holds for a whole run."""
    rows = chunks(spark, sf_dir).withColumn("timestamp", F.lit("2024-01-01T00:00:00.000Z")).withColumn("content", F.nullif("content", F.lit("")))
    return rows.select("doc_id", "chunk_index", "total_chunks", "file_name", "file_hash", "bot_id", "timestamp", "content")


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by separators; the documents are dealt out anew first, as a few are very long."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return ingest.chunk_rows(docs, recursive_chunks()("text"), ["doc_id"])


@query("SELECT label, count(*) AS vectors, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS violations FROM embeddings GROUP BY label")
def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    bad = ingest.dimension_violations(rows, 64).select("vec_id", F.lit(1).alias("bad"))
    return rows.select("vec_id", "label").join(bad, "vec_id", "left").groupBy("label").agg(F.count("*").alias("vectors"), F.count("bad").alias("violations"))


@query(f"WITH {buckets('d', 'documents', 'doc_id', 'text')} SELECT doc_id, bucket::INT AS bucket, n FROM d_t")
def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature hashing of whole documents: the buckets that are not empty."""
    counts = table(spark, sf_dir, "documents").select("doc_id", hashing_counts()(clean_text(F.col("text"))).alias("counts"))
    return counts.select("doc_id", F.posexplode("counts").alias("bucket", "n")).where("n > 0")


@query("SELECT doc_id, CASE WHEN length(text) <= 5000 THEN trim(substr(text, 1, 20), ' ' || chr(10)) END AS answer, CASE WHEN length(text) > 5000 THEN 'No response from the model' END AS error FROM documents")
def model_error_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model that echoes, and says nothing to prompts of over 5,000 characters."""

    def echo(prompts: list[str]) -> list[str]:
        return ["" if len(p) > 5000 else p[:20] for p in prompts]

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    good, bad = split_errors(generated(docs, echo))
    return good.select("doc_id", "answer", "error").union(bad.select("doc_id", F.lit(None), "error"))


SYNONYMS = (("the", "le"), ("of", "von"), ("that", "que"), ("and", "und"))


@query(
    "WITH s(word, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + "), w AS (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS place FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS l FROM benchmark)), "
    "a AS (SELECT item_id, string_agg(synonym, ' ' ORDER BY place) AS more FROM w JOIN s USING (word) GROUP BY item_id) SELECT item_id AS query_id, concat_ws(' ', text, more) AS expanded FROM benchmark LEFT JOIN a USING (item_id)"
)
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = spark.createDataFrame(SYNONYMS, "word string, synonym string")
    return expanded(questions(spark, sf_dir), synonyms).select("query_id", "expanded")


@query(
    f"WITH {CHUNKS}, fresh AS (SELECT min(doc_id) AS doc_id FROM files WHERE lower(split_part(file_name, '.', 2)) IN ('txt', 'pdf', 'docx', 'doc', 'pptx') GROUP BY bot_id, file_hash), "
    f"g AS (SELECT doc_id, max(total_chunks) AS total, max(total_chunks) - count(*) FILTER (NOT ({OK})) AS processed FROM chunks WHERE doc_id IN (SELECT doc_id FROM fresh) GROUP BY doc_id) "
    "SELECT bot_id, count(*) AS files, count(*) FILTER (total = processed) AS complete, coalesce(sum(total) FILTER (total = processed), 0)::BIGINT AS stored_chunks FROM g JOIN files USING (doc_id) GROUP BY bot_id"
)
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to stored chunks: format, dedup, chunks, vectors, gate; what each bot got."""
    own = files(spark, sf_dir).where(extension(F.col("file_name")).isin(*SUPPORTED))
    fresh = ingest.first_of_each(own, "doc_id")
    rows = ingest.embedded(ingest.chunk_rows(fresh, fixed_chunks(F.col("text")), KEYS))
    ok = F.expr(OK) & (F.col("empty_text") | (F.size("embedding") == DIMENSIONS))
    gates = ingest.gate(rows, ["doc_id", "bot_id"], ok)
    stored = F.coalesce(F.sum(F.when(F.col("complete"), F.col("total"))), F.lit(0))
    return gates.groupBy("bot_id").agg(F.count("*").alias("files"), F.count_if("complete").alias("complete"), stored.alias("stored_chunks"))


FRESH = f"""{CHUNKS}, fresh AS (SELECT min(doc_id) AS doc_id FROM files WHERE lower(split_part(file_name, '.', 2)) IN ('txt', 'pdf', 'docx', 'doc', 'pptx') GROUP BY bot_id, file_hash),
whole AS (SELECT doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM fresh) GROUP BY doc_id HAVING count(*) FILTER (NOT ({OK})) = 0),
kept AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM whole) AND {cleaned('content')} <> '')"""


def filled_store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """A store that has taken in the files of all bots: chunks of complete files and their catalogue."""
    store = ChunkStore(spark, scratch_path(spark, "store"), DIMENSIONS).create()
    own = files(spark, sf_dir).where(extension(F.col("file_name")).isin(*SUPPORTED))
    fresh = stored(ingest.first_of_each(own, "doc_id"), "fresh-files")
    rows = stored(ingest.embedded(ingest.chunk_rows(fresh, fixed_chunks(F.col("text")), KEYS)), "embedded-chunks")
    gates = stored(ingest.gate(rows, ["doc_id"], F.expr(OK) & (F.col("empty_text") | (F.size("embedding") == DIMENSIONS))), "gates")
    complete = gates.where("complete").select("doc_id", F.col("processed").alias("chunks"))
    kept = rows.where(~F.col("empty_text")).join(complete.select("doc_id").hint("merge"), "doc_id", "left_semi")
    store.append_chunks(kept, "2024-01-01T00:00:00.000Z", F.col("doc_id"))
    entries = fresh.join(complete.hint("merge"), "doc_id").withColumns({"type": extension(F.col("file_name")), "source": F.col("bot_id"), "seq": F.col("doc_id")})
    store.append_files(entries)
    return store


@query(f"WITH {FRESH} SELECT bot_id, chunk_index AS place, total_chunks AS total, file_name, file_hash, content FROM kept")
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the store holds after one ingest, read back."""
    m = F.col("metadata")
    return filled_store(spark, sf_dir).chunks().select("bot_id", m["chunkIndex"].alias("place"), m["totalChunks"].alias("total"), m["fileName"].alias("file_name"), m["fileHash"].alias("file_hash"), "content")


#: A tombstone that hides whatever is stored before it: sequence numbers are document ids, which may be of any size.
LAST = (1 << 63) - 1


@query(
    f"WITH {FRESH}, dead AS (SELECT bot_id, file_name FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)), alive AS (SELECT * FROM kept WHERE bot_id <> 'src3' AND (bot_id, file_name) NOT IN (SELECT (bot_id, file_name) FROM dead)) "
    "SELECT bot_id, file_name, count(*) AS chunks FROM alive GROUP BY ALL"
)
def forget_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of low quality are forgotten by bot and name, one bot is dropped: what chunks and catalogue still hold."""
    store = filled_store(spark, sf_dir)
    dead = files(spark, sf_dir).select("doc_id", "bot_id", "file_name").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").hint("merge"), "doc_id", "left_semi")
    store.forget_files(dead.withColumn("seq", F.lit(LAST)))
    store.drop_bots(spark.createDataFrame([("src3", LAST)], "bot_id string, seq long"))
    left = store.chunks().groupBy("bot_id", F.col("metadata.fileName").alias("file_name")).agg(F.count("*").alias("chunks"))
    return left.join(store.catalogue().select("bot_id", "file_name").hint("merge"), ["bot_id", "file_name"], "left_semi")


WORD_SQL = r"[^ \t\r\n]+[ \t\r\n]*|^[ \t\r\n]+"


def versions_sql(name: str, text: str) -> str:
    """CTE of the content-defined chunks of a text."""
    return f"""{name}_w AS (SELECT doc_id, regexp_extract_all({text}, '{WORD_SQL}') AS w FROM documents),
{name}_e AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR ('0x' || substr(md5(array_to_string(w[greatest(i - 2, 1):i], '')), 1, 8))::BIGINT % 48 = 0) AS e FROM {name}_w),
{name}_s AS (SELECT doc_id, w, unnest(list_zip(list_prepend(0, e[1:len(e) - 1]), e)) AS s FROM {name}_e WHERE len(w) > 0),
{name}_p AS (SELECT doc_id, w, s[2] AS b, unnest(range(s[1], s[2], 256)) AS a FROM {name}_s),
{name} AS (SELECT doc_id, hash, row_number() OVER (PARTITION BY doc_id, hash) AS turn FROM (SELECT doc_id, sha256(array_to_string(w[a + 1:least(a + 256, b)], '')) AS hash FROM {name}_p))"""


#: The second version of every third file: something put in after 200 characters; of every seventh, its end cut off.
CHANGED_SQL = "CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 200) || ' a few words put in ' || substr(text, 201) WHEN doc_id % 7 = 0 THEN substr(text, 1, greatest(length(text) - 300, 0)) ELSE text END"


@query(
    f"WITH {versions_sql('o', 'text')}, {versions_sql('n', CHANGED_SQL)} SELECT doc_id, count(*) FILTER (o.turn IS NOT NULL AND n.turn IS NOT NULL) AS kept, count(*) FILTER (o.turn IS NULL) AS new, count(*) FILTER (n.turn IS NULL) AS gone FROM o FULL JOIN n USING (doc_id, hash, turn) GROUP BY doc_id"
)
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a second version of each file keeps, adds and loses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("text")
    put_in = F.concat(F.substring(text, 1, 200), F.lit(" a few words put in "), F.expr("substring(text, 201)"))
    cut = F.expr("substring(text, 1, greatest(length(text) - 300, 0))")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, put_in).when(F.col("doc_id") % 7 == 0, cut).otherwise(text))
    both = versions.aligned(versions.version_chunks(docs, ["doc_id"]), versions.version_chunks(later, ["doc_id"]), ["doc_id"])
    count = lambda status: F.count_if(F.col("status") == status).alias(status)
    return both.groupBy("doc_id").agg(count("kept"), count("new"), count("gone"))


@query(f"SELECT doc_id, NOT regexp_matches(text, '[^{SPACE[1:-2]}]') AS empty FROM documents")
def reject_empty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without any text are rejected."""
    return ingest.flag_empty(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "empty")
