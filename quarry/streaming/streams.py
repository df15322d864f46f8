"""Token streams and incremental file ingest on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quarry.operators.ingest import first_of_each, new_files

#: Bots that a batch names in the filter of what it reads; with more it reads all folders.
BOTS_NAMED = 1000
TOKEN = "response STRING, done BOOLEAN, _corrupt_record STRING"


def token_lines(spark: SparkSession, folder: str) -> DataFrame:
    """An unbounded stream of the lines of files that land in a folder."""
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def parsed_tokens(lines: DataFrame) -> DataFrame:
    """Adds response, done and broken to NDJSON lines of a batch or a stream."""
    read = lines.where("trim(line) <> ''").withColumn("t", F.from_json("line", TOKEN, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return read.select(*lines.columns, F.col("t.response").alias("response"), F.coalesce("t.done", F.lit(False)).alias("done"), (F.col("t").isNull() | F.col("t._corrupt_record").isNotNull()).alias("broken"))


def good_tokens(parsed: DataFrame) -> DataFrame:
    """Lines that parse and say something or end the response."""
    return parsed.where(~F.col("broken") & ((F.coalesce("response", F.lit("")) != "") | F.col("done")))


def assembled(tokens: DataFrame, request: str = "request_id", seq: str = "seq") -> DataFrame:
    """(request, response, tokens, ended): the pieces up to the first that ends the response, joined in order."""
    end = F.min(F.when(F.col("done"), F.col(seq)))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.coalesce("response", F.lit("")).alias("response"))))
    one = tokens.groupBy(request).agg(end.alias("end"), pieces.alias("pieces"))
    kept = F.filter("pieces", lambda p: F.col("end").isNull() | (p["seq"] <= F.col("end")))
    return one.select(request, F.array_join(F.transform(kept, lambda p: p["response"]), "").alias("response"), F.size(F.filter(kept, lambda p: p["response"] != "")).cast("long").alias("tokens"), F.col("end").isNotNull().alias("ended"))


ORDERED = "request string, seq bigint, response string, done boolean, error string"
#: How long a request may be silent before it is given up, and how long one that has ended is remembered.
SILENCE_MS = 600_000


class InOrder(StatefulProcessor):
    """Hands on the pieces of one response in order, each once, up to the first that ends it.

    State of a request: the next place, whether it has ended, the latest time and how many
    pieces came before their turn, and these pieces. A timer, moved on by each batch that
    brings a later piece, clears it. Every call of the state is a round trip to the JVM, so
    only what is there is read and only what has changed is written.
    """

    def __init__(self, first: int, silence_ms: int):
        self.first, self.silence_ms = first, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next bigint, ended boolean, latest bigint, waiting int")
        self.early = handle.getListState("early", "seq bigint, response string, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.place.get()
        place, ended, latest, waiting = known or (self.first, False, 0, 0)
        before = latest
        out: list[tuple] = []
        held = {seq: (response, done) for seq, response, done in self.early.get()} if waiting else {}
        kept = set(held)
        for frame in rows:
            latest = max(latest, *map(int, frame["at"].tolist()))
            for seq, response, done in zip(frame["seq"].tolist(), frame["response"].tolist(), frame["done"].tolist()):
                if not ended and seq >= place:  # else it came before
                    held.setdefault(seq, (response, bool(done)))
        while not ended and (piece := held.pop(place, None)):
            response, ended = piece
            out.append((key[0], place, response, ended, None))
            place += 1
        if ended:
            held.clear()
        if held and held.keys() != kept:
            self.early.put([(seq, *piece) for seq, piece in held.items()])
        elif kept and not held:
            self.early.clear()
        if known is None or (place, ended, latest, len(held)) != tuple(known):
            self.place.update((place, ended, latest, len(held)))
        if known is None or latest != before:
            if known is not None:
                self.handle.deleteTimer(before + self.silence_ms)
            self.handle.registerTimer(latest + self.silence_ms)
        yield frame_of(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        place, ended, _, held = self.place.get()
        self.place.clear()
        if held:
            self.early.clear()
        yield frame_of([] if ended else [(key[0], place, None, True, f"No end after {place - self.first} pieces, {held} out of turn")])

    def close(self) -> None:
        pass


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    """The rows of one request; made at once, as there is a frame for each request and batch."""
    request, seq, response, done, error = zip(*rows) if rows else ((),) * 5
    return pd.DataFrame({"request": np.array(request, object), "seq": np.array(seq, np.int64), "response": np.array(response, object), "done": np.array(done, bool), "error": np.array(error, object)})


def in_order(tokens: DataFrame, request: str = "request_id", seq: str = "seq", at: str = "at", first: int = 0, silence_ms: int = SILENCE_MS) -> DataFrame:
    """(request, seq, response, done, error): the pieces of a stream's responses in order, each once.

    Pieces may come in any order, over any number of batches, and more than once: a piece waits
    until all before it have come. What follows the first ``done`` is dropped. A request that is
    silent for ``silence_ms`` ends with an error row; its state goes then, as does that of one
    that has ended. ``at`` names an event-time column with a watermark, of which the silence is
    measured. Sessions need the RocksDB state store (``with_state_store``).
    """
    own = tokens.select(F.col(request).cast("string").alias("request"), F.col(seq).cast("long").alias("seq"), F.coalesce("response", F.lit("")).alias("response"), F.coalesce("done", F.lit(False)).alias("done"), F.unix_millis(F.col(at)).alias("at"), F.col(at).alias("time"))
    return own.groupBy("request").transformWithStateInPandas(InOrder(first, silence_ms), ORDERED, "Append", "EventTime")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def split_stream(lines: DataFrame, good: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Writes the tokens of a stream of lines to one table and the lines that do not parse to another.

    A batch is written under its number, so that one that is replayed after a failure
    replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = parsed_tokens(batch)
        good_tokens(parsed).drop("broken").write.mode("overwrite").parquet(f"{good}/batch={number}")
        parsed.where("broken").select(*batch.columns, F.lit("Not JSON").alias("error")).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, order: str, files_a_batch: int | None = None) -> StreamingQuery:
    """Appends files that land in ``source`` to the Parquet ``table``, each content once a bot.

    What was stored before is found in the table itself, so no state grows with time; a
    batch that is replayed after a failure finds its own rows stored and adds nothing. The
    table has a folder for each bot, and a batch reads those of its own bots only. A batch
    takes all files that wait, or ``files_a_batch`` at most.
    """

    def append(batch: DataFrame, _: int) -> None:
        fresh = first_of_each(batch, order)
        stored = spark.read.schema(batch.schema).parquet(table)
        bots = [r["bot_id"] for r in batch.select("bot_id").distinct().limit(BOTS_NAMED + 1).collect()]
        if len(bots) <= BOTS_NAMED:
            stored = stored.where(F.col("bot_id").isin(bots))
        new_files(fresh, stored).select(*batch.columns).write.mode("append").partitionBy("bot_id").parquet(table)

    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bot_id").parquet(table)
    waiting = spark.readStream.schema(schema)
    stream = (waiting.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else waiting).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
