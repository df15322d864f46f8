"""Queries that run on Structured Streaming over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import context
from quarry.operators.models import extractive_answers, generated
from quarry.plans.registry import query
from quarry.plans.scenario import FILES, HITS, files, hits, questions, table, trimmed
from quarry.sources.scratch import scratch_path, stored
from quarry.streaming import streams


def ndjson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a token stream: signups end a response, errors are cut short."""
    line = F.concat(
        F.format_string('{"id": %d, "response": "', "event_id"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")), F.lit('", "done": '), (F.col("event_type") == "signup").cast("string"), F.when(F.col("event_type") == "error", "").otherwise("}"),
    )
    return table(spark, sf_dir, "events").select(line.alias("value"))


@query("SELECT CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS response, event_type = 'signup' AS done, count(*) AS lines FROM events WHERE event_type NOT IN ('error', 'click') GROUP BY ALL")
def ndjson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are written as files, read as a stream, parsed, and those that hold something counted."""
    source, out, state = (scratch_path(spark, f"ndjson-{x}") for x in ("in", "out", "state"))
    ndjson_lines(spark, sf_dir).repartition(4).write.text(source)
    good = streams.good_tokens(streams.parsed_tokens(streams.token_lines(spark, source)))
    good.select("response", "done").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("response string, done boolean").parquet(out).groupBy("response", "done").agg(F.count("*").alias("lines"))


@query(
    "WITH e AS (SELECT conv_id, min(turn) FILTER (turn >= 3 AND role = 'assistant') AS stop FROM conversations GROUP BY conv_id) SELECT conv_id, string_agg(text, '' ORDER BY turn) AS response, count(*) FILTER (text <> '') AS tokens, any_value(stop) IS NOT NULL AS ended FROM conversations JOIN e USING (conv_id) WHERE stop IS NULL OR turn <= stop GROUP BY conv_id"
)
def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pieces of a response that ends with the assistant's first turn from the third on."""
    pieces = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("response"), ((F.col("turn") >= 3) & (F.col("role") == "assistant")).alias("done"))
    return streams.assembled(pieces, "conv_id", "turn")


@query(f"WITH {FILES} SELECT DISTINCT bot_id, file_hash FROM files")
def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive in two batches; each content is stored once a bot, whenever it comes."""
    source, out, state = (scratch_path(spark, f"ingest-{x}") for x in ("in", "out", "state"))
    rows = files(spark, sf_dir).select("doc_id", "bot_id", "file_hash")
    rows.repartition(4).write.parquet(source)
    schema = "doc_id long, bot_id string, file_hash string"
    streams.ingest_stream(spark, source, schema, out, state, "doc_id", files_a_batch=2).awaitTermination()
    return spark.read.schema(schema).parquet(out).select("bot_id", "file_hash")


@query("""SELECT '{"id": ' || event_id || ', "response": "' || event_type || '", "done": false' AS line, 'Not JSON' AS error FROM events WHERE event_type = 'error'""")
def ndjson_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not parse go to a table of rejects with the reason, the others to their own."""
    source, good, bad, state = (scratch_path(spark, f"rejects-{x}") for x in ("in", "good", "bad", "state"))
    ndjson_lines(spark, sf_dir).repartition(4).write.text(source)
    streams.split_stream(streams.token_lines(spark, source), good, bad, state).awaitTermination()
    return spark.read.schema("line string, error string").parquet(bad).select("line", "error")


STOPPED = "e AS (SELECT conv_id, min(turn) FILTER (turn >= 3 AND role = 'assistant') AS stop FROM conversations GROUP BY conv_id)"


@query(f"WITH {STOPPED} SELECT conv_id, turn, coalesce(text, '') AS response FROM conversations JOIN e USING (conv_id) WHERE stop IS NULL OR turn <= stop")
def stream_until_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as a stream in three batches, the turns of a conversation in any of them and in any order,
    some twice: they come out in order, and what follows an end is dropped."""
    source, out, state = (scratch_path(spark, f"done-{x}") for x in ("in", "out", "state"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("response"), ((F.col("turn") >= 3) & (F.col("role") == "assistant")).alias("done"))
    rows = rows.withColumn("at", F.timestamp_seconds(F.col("turn") + 1_700_000_000))
    rows.union(rows.where("(conv_id + turn) % 3 = 0")).repartition(3, "turn", "response").write.parquet(source)
    streams.with_state_store(spark)
    pieces = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("at", "1 hour")
    kept = streams.in_order(pieces, "conv_id", "turn", at="at")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(out).select(F.col("request").cast("long").alias("conv_id"), F.col("seq").alias("turn"), "response")


def streamed(spark: SparkSession, said: DataFrame, size: int = 40) -> DataFrame:
    """(query_id, answer): answers sent in pieces as JSON lines over files, read as a stream and put together."""
    source, out, state = (scratch_path(spark, f"answer-{x}") for x in ("in", "out", "state"))
    last = F.expr(f"greatest(length(answer) - 1, 0) div {size}")
    pieces = said.select("query_id", F.posexplode(F.expr(f"transform(sequence(0, greatest(length(answer) - 1, 0) div {size}), i -> substring(answer, i * {size} + 1, {size}))")).alias("seq", "response"), last.alias("last"))
    line = F.to_json(F.struct("query_id", "seq", "response", (F.col("seq") == F.col("last")).alias("done"), F.lit("2024-01-01T00:00:00Z").alias("at")))
    pieces.select("query_id", line.alias("value")).repartition(4, "query_id").select("value").write.text(source)
    read = streams.good_tokens(streams.parsed_tokens(streams.token_lines(spark, source))).withColumn("query_id", F.get_json_object("line", "$.query_id")).withColumn("seq", F.get_json_object("line", "$.seq").cast("long"))
    read = read.withColumn("at", F.get_json_object("line", "$.at").cast("timestamp")).withWatermark("at", "1 hour")
    streams.with_state_store(spark)
    kept = streams.in_order(read, "query_id", "seq")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    whole = streams.assembled(spark.read.schema(kept.schema).parquet(out), "request", "seq")
    return whole.select(F.col("request").cast("long").alias("query_id"), F.col("response").alias("answer"))


CHAT = (
    "'Write the answer in Markdown: bold key terms, code for technical names, lists for steps, tables for comparisons.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || prompt || chr(10) || chr(10) || 'Answer in Markdown:'"
)


@query(
    f"""WITH {HITS}, c AS (SELECT query_id, string_agg('### Context Source ' || rank || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id),
p AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE 'Explain item ' || item_id END AS prompt FROM benchmark)
SELECT query_id, CASE WHEN trim(prompt) = '' THEN NULL WHEN context IS NULL THEN 'No relevant information found' ELSE {CHAT} END AS answer, CASE WHEN trim(prompt) = '' THEN 'Prompt is required' END AS error FROM p LEFT JOIN c USING (query_id)"""
)
def stream_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks found by the question, Markdown context, the caller's own prompt, and the answer as a token stream.
    The stand-in model says what it is sent; every seventh prompt is blank."""
    own = F.when(F.col("query_id") % 7 == 0, " ").otherwise(F.concat(F.lit("Explain item "), "query_id"))
    asked = questions(spark, sf_dir).withColumn("prompt", own)
    chats = stored(context.chat_prompts(asked, context.contexts(hits(spark, sf_dir), layout=context.MARKDOWN)), "chats")
    said = generated(chats.where("sent IS NOT NULL").select("query_id", "sent"), lambda prompts: prompts, "sent").select("query_id", "answer")
    told = said.union(chats.where("said IS NOT NULL").select("query_id", "said"))
    return chats.select("query_id", "error").join(streamed(spark, told).hint("merge"), "query_id", "left").select("query_id", "answer", "error")


@query(f"WITH {HITS} SELECT item_id AS query_id, coalesce(nullif({trimmed('content')}, ''), 'I don''t know.') AS answer FROM benchmark LEFT JOIN hits ON query_id = item_id AND rank = 1")
def stream_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From retrieval to a token stream: each answer is sent in pieces as JSON lines, read as a stream and put together."""
    said = extractive_answers(questions(spark, sf_dir), hits(spark, sf_dir))
    return streamed(spark, said.select("query_id", "answer"))
