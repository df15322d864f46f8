import json

from pyspark.sql import functions as F

from quarry.streaming import streams


def test_tokens(spark, tmp_path):
    lines = [json.dumps({"response": "a", "done": False}), "{broken", "", "{}", json.dumps({"response": "", "done": False}), json.dumps({"response": "b", "done": True})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("\n".join(lines))
    good = streams.good_tokens(streams.parsed_tokens(streams.token_lines(spark, str(tmp_path / "in"))))
    good.writeStream.format("memory").queryName("tokens").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["response"], r["done"]) for r in spark.table("tokens").collect()) == [("a", False), ("b", True)]


def test_assembled(spark):
    rows = spark.createDataFrame([(1, 2, "b", True), (1, 1, "a", False), (1, 3, "late", False), (2, 1, None, False)], "request_id long, seq long, response string, done boolean")
    assert sorted(map(tuple, streams.assembled(rows).collect())) == [(1, "ab", 1 + 1, True), (2, "", 0, False)]


def test_ingest_is_idempotent(spark, tmp_path):
    schema = "doc_id long, bot_id string, file_hash string"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    first = spark.createDataFrame([(1, "b", "x"), (2, "b", "x"), (3, "c", "x")], schema)
    first.coalesce(1).write.parquet(source)
    for state in ("s1", "s1", "s2"):  # again from its checkpoint, then from the beginning
        streams.ingest_stream(spark, source, schema, table, str(tmp_path / state), "doc_id").awaitTermination()
    spark.createDataFrame([(4, "b", "x"), (5, "b", "y")], schema).coalesce(1).write.mode("append").parquet(source)
    streams.ingest_stream(spark, source, schema, table, str(tmp_path / "s1"), "doc_id").awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(table).collect()) == [1, 3, 5]


def test_in_order(spark, tmp_path):
    """Pieces out of order over batches, some twice; a request that never ends expires, and no state is left."""
    streams.with_state_store(spark)
    schema = "request_id long, seq long, response string, done boolean, minute long"
    batches = [
        [(1, 1, "b", False, 0), (1, 3, "late", False, 0), (2, 0, "x", True, 0), (3, 2, "z", False, 1), (4, 1, "held", False, 1)],
        [(1, 0, "a", False, 1), (1, 1, "again", False, 1), (2, 0, "twice", True, 1), (2, 1, "late", False, 1), (3, 0, None, False, 2)],
        [(1, 2, "c", True, 2), (3, 1, "y", False, 2), (3, 1, "y", False, 2), (1, 3, "late", False, 2)],
        [(9, 0, "last", True, 300)],
        [(8, 0, "end", True, 900)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pieces = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds((F.col("minute") + 1000) * 60)).withWatermark("at", "10 minutes")
        query = streams.in_order(pieces).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.schema(streams.ORDERED).parquet(str(tmp_path / "out")).collect()))
    good = [("1", 0, "a"), ("1", 1, "b"), ("1", 2, "c"), ("2", 0, "x"), ("3", 0, ""), ("3", 1, "y"), ("3", 2, "z"), ("8", 0, "end"), ("9", 0, "last")]
    assert [r[:3] for r in got if r[4] is None] == good
    assert [(r[0], r[1], r[3], r[4]) for r in got if r[4]] == [("3", 3, True, "No end after 3 pieces, 0 out of turn"), ("4", 0, True, "No end after 0 pieces, 1 out of turn")]
    left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "place").load()
    assert {r["key"]["request"] for r in left.collect()} == {"8"}


def test_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text('{"response": "a"}\n{broken\n\n{"response": "", "done": true}\n')
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    streams.split_stream(streams.token_lines(spark, str(tmp_path / "in")), good, bad, str(tmp_path / "state")).awaitTermination()
    assert sorted(str(r["response"]) for r in spark.read.parquet(good).collect()) == ["", "a"]
    assert [(r["line"], r["error"]) for r in spark.read.parquet(bad).collect()] == [("{broken", "Not JSON")]


class Counted:
    """State of one request, and the calls it takes; each is a round trip to the JVM."""

    def __init__(self):
        self.calls, self.own, self.timers = [], {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("getValueState", "getListState", "getMapState"):
                return State(self, args[0])
            if name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            return list(self.timers)

        return call


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def __getattr__(self, call):
        def run(*args):
            self.handle.calls.append(f"{self.name}.{call}")
            own = self.handle.own
            if call in ("put", "update"):
                own[self.name] = args[0]
            elif call == "clear":
                own.pop(self.name, None)
            elif call == "updateValue":
                own.setdefault(self.name, {})[args[0]] = args[1]
            elif call == "exists":
                return self.name in own
            elif call == "iterator":
                return iter(own.get(self.name, {}).items())
            return own.get(self.name)

        return run


def test_few_calls_of_the_state():
    """A batch of a request takes six calls at most, whatever waits; one that brings nothing new, two."""
    handle, order = Counted(), streams.InOrder(0, 1000)
    order.init(handle)
    batch = lambda *seqs: [streams.pd.DataFrame({"seq": seqs, "response": ["x"] * len(seqs), "done": [s == 9 for s in seqs], "at": [s * 10 for s in seqs]})]
    said = []
    for seqs, most in (((2, 5, 3, 7, 8), 6), ((2, 3), 2), ((0, 9, 1), 6), ((4, 6), 6), ((9,), 2)):
        handle.calls.clear()
        said += [s for f in order.handleInputRows(("a",), iter(batch(*seqs)), None) for s in f["seq"].tolist()]
        assert len(handle.calls) <= most, handle.calls
        assert len(handle.timers) == 1
    assert said == list(range(10)) and "early" not in handle.own
