import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import clean_text
from quarry.operators import analysis, bots, context, ingest, models, search, tables, tools
from quarry.plans import scenario, search_queries  # noqa: F401
from quarry.plans.registry import QUERIES
from quarry.sources.store import CATALOGUE, ChunkStore
from quarry.sources.landing import extracted_text, landed_files, split_by_support


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_landing(spark, tmp_path):
    for name, data in (("b1/a.TXT", b"hello"), ("b1/b.pdf", b"%PDF"), ("b2/a.TXT", b"hello"), ("b2/c.csv", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    good, bad = split_by_support(landed_files(spark, str(tmp_path)))
    assert rows(bad, "bot_id", "error") == [("b2", "Unsupported file type: csv")]

    def extract(kind, content):
        raise ValueError("broken " + kind)

    assert rows(extracted_text(good, extract), "bot_id", "text", "error") == [("b1", "hello", None), ("b1", None, "broken pdf"), ("b2", "hello", None)]
    assert extracted_text(good).count() == 2


def test_ingest(spark):
    files = spark.createDataFrame([(1, "b", "h1"), (2, "b", "h1"), (3, "c", "h1"), (4, "b", "h2")], "doc_id long, bot_id string, file_hash string")
    fresh = ingest.first_of_each(files, "doc_id")
    assert rows(fresh, "doc_id") == [(1,), (3,), (4,)]
    assert rows(ingest.new_files(files, fresh.where("doc_id = 1")), "doc_id") == [(3,), (4,)]
    texts = spark.createDataFrame([(1, "x" * 395 + " " * 400 + "y"), (2, None), (3, "")], "doc_id long, text string")
    chunks = ingest.fixed_chunk_rows(texts, ["doc_id"])
    # 796 characters make three windows, from 0, 380 and 760; the second holds blanks and 20 x of the overlap
    assert rows(chunks, "doc_id", "chunk_index", "total_chunks") == [(1, 0, 3), (1, 1, 3), (1, 2, 3)]
    blank = spark.createDataFrame([(1, "x" * 300 + " " * 600 + "y")], "doc_id long, text string")
    assert rows(ingest.fixed_chunk_rows(blank, ["doc_id"]), "doc_id", "chunk_index", "total_chunks") == [(1, 0, 3), (1, 2, 3)]
    gates = ingest.gate(chunks, ["doc_id"], F.col("chunk_index") >= 0)
    assert rows(gates, "doc_id", "complete")[0][0] == 1
    assert rows(ingest.flag_empty(texts), "doc_id", "empty") == [(1, False), (2, True), (3, True)]
    # a blank chunk has no row and counts as processed; one that failed, or whose fate is unknown, does not
    gates = ingest.gate(ingest.fixed_chunk_rows(blank, ["doc_id"]), ["doc_id"], F.lit(True))
    assert rows(gates, "total", "processed", "complete") == [(3, 3, True)]
    gates = ingest.gate(ingest.fixed_chunk_rows(blank, ["doc_id"]), ["doc_id"], F.when(F.col("chunk_index") == 0, True))
    assert rows(gates, "total", "processed", "complete") == [(3, 2, False)]
    lines = spark.createDataFrame([(1, "\n\u00a0" * 150 + "x" * 200 + "\n" * 600 + "y")], "doc_id long, text string")
    assert rows(ingest.fixed_chunk_rows(lines, ["doc_id"]), "chunk_index", "total_chunks") == [(0, 3), (1, 3), (2, 3)]
    pages = spark.createDataFrame([(1, 1, "\n"), (1, 2, "x"), (1, 3, "\u3000\t")], "doc_id long, page int, text string")
    assert rows(ingest.joined_pages(pages, ["doc_id"], "page"), "content", "pages") == [("x", 3)]
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None])], "id long, embedding array<double>")
    assert rows(ingest.dimension_violations(vectors, 2), "id") == [(2,), (3,), (4,)]


def vectors(spark):
    data = [(k, [float((k * 7) % 11), float((k * 5) % 13), 1.0 if k % 4 else 0.0]) for k in range(200)] + [(200, [0.0, 0.0, 0.0]), (201, None)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_search_forms_agree(spark, monkeypatch):
    base = vectors(spark)
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = rows(search.knn_expressions(asked.where("query_id < 200"), base.where("embedding IS NOT NULL"), 5), "query_id", "vec_id", "rank")
    assert rows(search.knn(asked.where("query_id < 200"), base, 5), "query_id", "vec_id", "rank") == want
    monkeypatch.setattr(search, "BLOCK", 2)
    assert rows(search.knn(asked.where("query_id < 200"), base, 5), "query_id", "vec_id", "rank") == want
    five, three = search.knn(asked, base, 5), search.knn(asked, base, 3)
    assert rows(five.where("rank <= 3"), "query_id", "vec_id") == rows(three, "query_id", "vec_id")
    assert search.knn(asked.limit(0), base, 5).count() == 0


def test_search_by_group_and_other_ids(spark, monkeypatch):
    base = vectors(spark).selectExpr("concat('v', vec_id) AS vec_id", "embedding", "vec_id % 3 AS bot").where("vec_id <> 'v200'")
    asked = base.where("bot < 2").limit(30).selectExpr("concat('q', vec_id) AS query_id", "embedding", "bot").where("embedding IS NOT NULL")
    got = search.knn(asked, base, 4, by="bot")
    assert dict(got.dtypes)["vec_id"] == "string" == dict(got.dtypes)["query_id"]
    want = [r for b in (0, 1) for r in rows(search.knn_expressions(asked.where(f"bot = {b}"), base.where(f"bot = {b} AND embedding IS NOT NULL"), 4), "query_id", "vec_id", "rank")]
    assert rows(got, "query_id", "vec_id", "rank") == sorted(want, key=str)
    monkeypatch.setattr(search, "BLOCK", 7)
    assert rows(search.knn(asked, base, 4, by="bot"), "query_id", "vec_id", "rank") == sorted(want, key=str)
    with pytest.raises(ValueError):
        search.knn_expressions(asked, base)


def test_cells_of_clustered_vectors(spark):
    """Recall of 0.9 while less than a quarter of the pairs is visited."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    data = [(k, (centres[k % 40] + 0.15 * rng.normal(size=16)).tolist()) for k in range(2000)]
    base = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = base.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = search.knn(asked, base)
    cells, probes = search.planned_cells(2000)
    assert probes / cells < 0.25
    assert search.recall(search.knn_ivf(asked, base, cells=cells, probes=probes), exact).agg(F.avg("recall")).first()[0] >= 0.9
    sides = search.lsh_groups(16, 10)(np.array([v for _, v in data]))
    visited = sum((sides[:, t][:, None] == sides[::50, t][None, :]).sum() for t in range(16)) / (2000 * 40)
    assert visited < 0.25 * 16
    assert search.recall(search.knn_lsh(asked, base, bits=10), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), 2).create()
    assert store.create().chunks().count() == 0 == store.catalogue().count()
    ddl = "bot_id string, file_name string, file_hash string, chunk_index int, total_chunks int, content string, embedding array<double>"
    data = [("b", "f", "h", 0, 2, "one", [1.0, 0.0]), ("b", "f", "h", 1, 2, "", [0.1, 1.0]), ("c", "f", "h", 0, 1, "x", [1.0, 1.0]), ("b", "g", "k", 0, 1, "y", [1.0]), ("b", "g", "k", 1, 1, "y", [1.0, None]), ("b", "g", "k", 2, 1, "y", None)]
    bad = store.append_chunks(spark.createDataFrame(data, ddl), "t", F.lit(1))
    assert rows(bad, "chunk_index") == [(0,), (1,), (2,)]
    store.append_chunks(spark.createDataFrame(data[:3], ddl), "t", F.lit(1))  # written twice, read once
    assert rows(store.chunks(), "bot_id", "content") == [("b", "one"), ("b", None), ("c", "x")]
    assert dict(store.chunks().dtypes)["embedding"] == "array<float>"
    assert "PartitionFilters: [isnotnull(bot_id" in store.chunks("c")._jdf.queryExecution().toString() and store.chunks("c").count() == 1
    store.append_files(spark.createDataFrame([("f", 3, "h", "txt", "b", 2, 1, "b"), ("f", 3, "h", "txt", "c", 1, 1, "c")], CATALOGUE))
    store.forget_files(spark.createDataFrame([("b", "f", 2)], "bot_id string, file_name string, seq int"))
    assert rows(store.chunks(), "bot_id") == [("c",)] == rows(store.catalogue(), "bot_id")
    store.append_chunks(spark.createDataFrame(data[:1], ddl), "t", F.lit(3))
    assert rows(store.chunks("b"), "content", "seq") == [("one", 3)]
    store.drop_bots(spark.createDataFrame([("c", 2)], "bot_id string, seq int"))
    assert rows(store.chunks(), "bot_id") == [("b",)] and store.catalogue().count() == 0


def test_embed_hook(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "###"), (3, None), (4, "zero"), (5, "bad")], "k long, content string").coalesce(1)

    def embed(batch):
        return [[0.0, 0.0] if t == "zero" else [3.0, 4.0] for t in batch]

    assert rows(ingest.embedded(texts, embed=embed), "k", "embedding", "empty_text") == [(1, [0.6, 0.8], False), (2, None, True), (3, None, True), (4, [0.0, 0.0], False), (5, [0.6, 0.8], False)]

    def failing(batch):
        raise RuntimeError("down")

    assert rows(ingest.embedded(texts, embed=failing), "embedding") == [(None,)] * 5


def test_failed_embedding_is_an_error(spark):
    """Not a row like that of an empty text; fewer vectors than texts are a failure of them all."""
    texts = spark.createDataFrame([(1, "a b"), (2, "###"), (3, "nan"), (4, "c")], "k long, content string").coalesce(1)

    def failing(batch):
        raise RuntimeError("down")

    made = ingest.embedded(texts, embed=failing)
    assert rows(made, "k", "error") == [(1, "Not embedded: down"), (2, None), (3, "Not embedded: down"), (4, "Not embedded: down")]
    assert rows(ingest.embedded(texts, embed=lambda batch: [[1.0, 0.0]]).where("embedding IS NULL AND error IS NOT NULL"), "k") == [(1,), (3,), (4,)]
    some = ingest.embedded(texts, embed=lambda batch: [[float(t), 1.0] if t == "nan" else [3.0, 4.0] for t in batch])
    assert rows(some.where("error IS NOT NULL"), "k", "embedding") == [(3, None)]
    whole = ingest.all_embedded(some.where("k <> 3"), 2)
    assert rows(whole, "k", "embedding") == [(1, [0.6, 0.8]), (2, None), (4, [0.6, 0.8])] and "error" not in whole.columns
    for rest, dimensions, why in ((made, 2, "down"), (some, 2, "not finite"), (some.where("k <> 3"), 64, "has numbers: 2")):
        with pytest.raises(Exception, match=why):
            ingest.all_embedded(rest, dimensions).collect()


@pytest.mark.parametrize("name", ["hybrid_rrf", "prompt_render"])
@pytest.mark.parametrize("at", ["chunks", "questions"])
def test_search_fails_where_vectors_are_not_made(spark, monkeypatch, name, at):
    """Chunks or questions without vectors were left out, and the result looked whole."""
    counts = ingest.hashed_counts
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(clean_text(F.col("text"))).first()[0]

    def failing(texts, dimensions):
        if at == "chunks" or asked in texts:
            raise RuntimeError("hashing is down")
        return counts(texts, dimensions)

    monkeypatch.setattr(ingest, "hashed_counts", failing)
    monkeypatch.setattr(scenario, "_filled", {})
    with pytest.raises(Exception, match="hashing is down"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_containing(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over a dog"), (2, "he quick brown fox jumps ove"), (3, "quick brown  fox jumps"), (4, None), (5, ""), (6, "fox fox fox")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "he quick brown fox jumps ove"), (2, "quick brown fox"), (3, "brown  fox jumps"), (4, "x fo"), (5, ""), (6, None), (7, "x fox f")], "query_id long, question string")
    assert rows(analysis.containing(docs, asked)) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 6), (7, 6)]
    short = spark.createDataFrame([(1, "alpha w1"), (2, "alpha"), (3, "alpha w1 w1 w1"), (4, "a w"), (5, " ")], "query_id long, question string")
    texts = spark.createDataFrame([("x", "alpha w1 w1 w1"), ("y", "an alpha w12"), ("z", None)], "doc_id string, text string")
    assert rows(analysis.containing(texts, short)) == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (4, "x"), (4, "y")]
    assert analysis.containing(docs, asked.limit(0)).count() == 0


def test_plans(spark):
    base = vectors(spark)
    asked = base.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = search.knn(asked, base, 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in search.nearest(base, [1.0, 0.0, 0.0])._jdf.queryExecution().toString()


@pytest.mark.parametrize("method", ["knn_ivf", "knn_lsh"])
def test_recall(spark, method):
    base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = getattr(search, method)(asked, base)
    assert search.recall(found, search.knn(asked, base)).agg(F.avg("recall")).first()[0] >= 0.9


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 2, "b", "f", 0), (1, 1, "a", "f", 3)], "query_id long, rank int, content string, file_name string, chunk_index int")
    assert rows(context.contexts(hits)) == [(1, "[Context 1]: a\n\n[Context 2]: b")]
    assert rows(context.contexts(hits, layout=context.MARKDOWN)) == [(1, "### Context Source 1\na\n\n### Context Source 2\nb")]
    assert rows(context.citations(hits)) == [(1, "f#3; f#0")]
    assert rows(context.trimmed(hits, 1), "rank") == [(1,)]
    asked = spark.createDataFrame([(1, "q?"), (2, "r?")], "query_id long, question string")
    made = dict(rows(context.prompts(asked, context.contexts(hits)), "query_id", "prompt"))
    assert "[Context 2]: b" in made[1] and "Question: r?" in made[2]
    none = spark.createDataFrame([], "query_id long, answer string")
    assert rows(models.answered(asked, hits, none), "query_id", "answer", "success") == [(1, "a", True), (2, "I don't know.", False)]


def test_change_log(spark):
    log = spark.createDataFrame(
        [("a", 1, "insert", ["x", "y"], 1, 1, 10), ("a", 3, "update", ["x"], None, 9, 30), ("a", 2, "update", ["y"], 5, 2, 20), ("b", 1, "insert", ["x"], 1, None, 1), ("b", 2, "delete", [], None, None, 2), ("c", 1, "delete", [], None, None, 1), ("c", 2, "insert", ["x"], 7, 7, 5)],
        "k string, seq int, op string, changed array<string>, x int, y int, at int",
    )
    assert rows(tables.latest_state(log, "k", ["x", "y"])) == [("a", None, 2, 10, 30, 3), ("c", 7, None, 5, 5, 1)]


def test_maintenance(spark):
    kept = spark.createDataFrame([("b", "f", 1), ("b", "f", 9), ("c", "f", 1)], "bot_id string, file_name string, seq int")
    dead = spark.createDataFrame([("b", "f", 5)], "bot_id string, file_name string, seq int")
    assert rows(tables.without_deleted(kept, dead, ["bot_id", "file_name"])) == [("b", "f", 9), ("c", "f", 1)]
    people = spark.createDataFrame([(1, " Ann ", None, "x"), (2, "", "o", "y"), (3, None, "z", "x")], "id int, name string, status string, mail string")
    rules = [tables.required("name"), tables.one_of("status", "o")]
    assert rows(tables.violations(people, ["id"], rules)) == [(2, "name is required"), (3, "name is required"), (3, "status is not allowed")]
    assert rows(tables.repeated(people, ["mail"])) == [("x", 2)]
    assert rows(tables.normalised(people, ["name"], {"status": "o"}), "name", "status")[0] == ("", "o")
    assert [r["id"] for r in tables.page(people, "id", 2, 2).collect()] == [3]
    with pytest.raises(ValueError):
        tables.page(people, "id", 0, 2)


def test_tools(spark):
    field = lambda required=False, place="query", default=None, name=None: ("string", "d", required, place, name, default)
    data = [(1, "b", "weather", "current weather by city", {"city": field(True, "path"), "unit": field(default="c d", name="u")}, True, "https://x.org/w/"), (2, "b", "weather", "other", {}, True, "https://y.org?k=1"), (0, "b", "weather", "off", {}, False, "https://off.org"), (3, "b", "all", "d", {"q": field(True)}, True, "https://y.org?k=1")]
    known = spark.createDataFrame(data, f"tool_id int, bot_id string, name string, description string, parameters {tools.PARAMETERS}, enabled boolean, endpoint string")
    raw = spark.createDataFrame([(1, "b", '{"tool": "weather", "params": {"city": "São Paulo", "more": "x"}}'), (2, "b", '{"tool": "weather", "params": {}}'), (3, "b", '{"tool": "all", "params": {"q": "a&b"}}'), (4, "b", '{"tool": "none"}'), (5, "b", "{broken")], "query_id int, bot_id string, raw string")
    parsed = tools.parsed_requests(raw)
    good = parsed.where("NOT broken")
    assert rows(parsed.where("broken"), "query_id", "tool", "params") == [(5, None, None)]
    only_query = spark.createDataFrame([(1, "https://a.b/c/", {"q": field()}, {"q": "1"}), (2, "https://a.b/c/", {"q": field(place=None, default="1")}, {})], f"k int, endpoint string, parameters {tools.PARAMETERS}, params map<string,string>")
    assert rows(tools.rendered(only_query), "k", "url") == [(1, "https://a.b/c/?q=1"), (2, "https://a.b/c/")]
    out = rows(tools.rendered(tools.routed(good, known)), "query_id", "tool_id", "url", "error")
    assert out == [(1, 1, "https://x.org/w/S%C3%A3o%20Paulo?u=c%20d", None), (2, 1, None, "Missing required: city"), (3, 3, "https://y.org?k=1&q=a%26b", None), (4, None, None, "No such tool")]
    assert tools.descriptors(known).count() == 3
    heads = tools.request_heads(spark.createDataFrame([(1, None, None), (2, "post", {"Accept": "x", "Cookie": "y", "X-Api-Key": "z"})], "k int, method string, headers map<string,string>"))
    assert rows(heads, "method", "headers") == [("GET", {}), ("POST", {"Accept": "x"})]
    asked = spark.createDataFrame([(1, "b", "What is the weather in this city?"), (2, "b", "hello")], "query_id int, bot_id string, question string")
    assert rows(tools.detected(asked, known)) == [(1, "b", "weather", 2)]


def test_tool_answers(spark):
    field = lambda required, default: ("string", "d", required, "query", None, default)
    data = [(1, "b", "weather", "weather by city", {"city": field(True, "Rome")}, True, "https://x.org/", "Be kind."), (2, "b", "trains", "trains by city", {"from": field(True, None)}, True, "https://y.org", "Be brief."), (3, "b", "ships", "ships by city", {}, True, "https://down.org", "")]
    known = spark.createDataFrame(data, f"tool_id int, bot_id string, name string, description string, parameters {tools.PARAMETERS}, enabled boolean, endpoint string, system_prompt string")
    asked = spark.createDataFrame([(1, "b", "The weather in this city?"), (2, "b", "What trains leave the city?"), (3, "b", "Which ships leave the city?"), (4, "b", "Hello")], "query_id long, bot_id string, question string")

    def call(urls):
        assert None not in urls
        return [None if "down" in u else f"sunny at {u}" for u in urls]

    got = {r["query_id"]: r for r in models.tool_answers(asked, known, lambda p: p, call).collect()}
    assert set(got) == {1, 2, 3} and got[1]["url"] == "https://x.org/?city=Rome" and got[1]["error"] is None
    assert got[1]["answer"].startswith("Be kind.") and '{"body":"sunny at https://x.org/?city=Rome"}' in got[1]["answer"]
    assert got[2]["error"] == "Missing required: from" and got[2]["answer"] is None and got[3]["error"] == "No response from the model"


def test_created_bots(spark):
    users = spark.createDataFrame([("a@x.org", "Ann"), ("b@x.org", "Bo"), ("b@x.org", "Bob")], "email string, name string")
    asked = spark.createDataFrame([(1, " One ", None, "a@x.org"), (2, "Two", "d", "z@x.org"), (3, "\u3000", None, "b@x.org"), (4, "Four", None, "b@x.org"), (5, "Five", None, None)], "request_id long, bot_name string, bot_desc string, owner string")
    got = {r["request_id"]: r for r in bots.created_bots(asked, users, F.lit(36).cast("long")).collect()}
    assert [got[k]["error"] for k in range(1, 6)] == [None, bots.NO_OWNER, bots.NO_NAME, None, bots.NO_OWNER]
    assert got[1]["bot_name"] == "One" and got[1]["bot_id"].startswith("bot_10_") and got[1]["vector_table"] == "vector_table_" + got[1]["bot_id"] and got[1]["bot_users"]["users"] == ["a@x.org"]
    assert got[4]["owner"]["name"] == "Bo" and got[2]["bot_id"] is None and got[1]["is_active"] is True

    def down(names):
        raise RuntimeError("down")

    failed = bots.created_bots(asked, users, F.lit(36).cast("long"), down)
    assert rows(failed.where("bot_id IS NOT NULL")) == [] and failed.where(F.col("error").startswith(bots.FAILED)).count() == 2
    chats = spark.createDataFrame([(1, "q", "say"), (2, "q", " "), (3, "q", None), (4, "q", "tell")], "query_id long, question string, prompt string")
    found = spark.createDataFrame([(1, "ctx"), (2, "ctx")], "query_id long, context string")
    made = {r["query_id"]: r for r in context.chat_prompts(chats, found).collect()}
    assert "ctx" in made[1]["sent"] and "say" in made[1]["sent"] and made[2]["error"] == made[3]["error"] == "Prompt is required" and made[4]["said"] == context.NOTHING_FOUND


def test_analysis(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox red")], "query_id long, question string")
    found = analysis.bm25(asked, docs)
    assert rows(found, "doc_id", "rank") == [(1, 1), (2, 2)]
    dense = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id long, doc_id long, rank int")
    assert rows(analysis.fused(dense, found), "doc_id", "rank") == [(1, 2), (2, 1), (3, 3)]
    truth = spark.createDataFrame([(1, 1), (1, 9)], "query_id long, doc_id long")
    assert rows(analysis.precision_at(found, truth, 2)) == [(1, 2, 1, 0.5, 0.5, 1.0)]
    page = spark.createDataFrame([(1, "<head><title>t</title></head><nav>n</nav><p>a &amp; b</p><script>x</script><p>c</p>")], "page_id long, html string")
    assert page.select(analysis.page_text(F.col("html"))).first()[0].strip() == "a & b\nc"
    private = spark.createDataFrame([(1, "mail a.b@c.org or 10.0.0.1")], "doc_id long, text string")
    assert rows(analysis.redacted(private, "doc_id"), "redacted", "emails", "ips") == [("mail [email] or [ip]", 1, 1)]


def test_models(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "")], "query_id long, prompt string")
    good, bad = models.split_errors(models.generated(asked, lambda p: [x and f" {x}! " for x in p]))
    assert rows(good, "query_id", "answer") == [(1, "a!")] and rows(bad, "query_id") == [(2,)]

    calls = spark.createDataFrame([(1, "why?", {"a": "1"}, "Be kind.")], "query_id long, question string, result map<string,string>, system_prompt string")
    said = models.answered_from_tools(calls, lambda p: p).first()
    assert said["error"] is None and '{"a":"1"}' in said["answer"] and said["answer"].startswith("Be kind.") and "why?" in said["answer"]
    listed = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, None)], "k int, users array<string>")
    assert tables.where_given(listed, "users", None).count() == 3 and rows(tables.where_given(listed, "users", "b"), "k") == [(2,)]
    assert rows(listed.select(tables.or_default(F.col("k") % 3, 10).alias("n")), "n") == [(1,), (10,), (2,)]

    def failing(prompts):
        raise RuntimeError("down")

    assert rows(models.generated(asked, failing), "error") == [("down",), ("down",)]


@pytest.mark.parametrize("block", [2048, 30, 3])
def test_each_chunk_is_embedded_once(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "TILE", 70)
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts):
        import uuid

        (calls / f"{uuid.uuid4().hex}-{len(texts)}").touch()
        return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.range(300).selectExpr("id AS vec_id", "CASE WHEN id % 50 = 7 THEN '##' ELSE repeat('x', cast(id % 17 + 1 as int)) END AS content")
    asked = spark.range(30).selectExpr("id AS query_id", "array(cast(id as double), 2d) AS embedding")
    found = search.knn(asked, ingest.embedded(chunks, embed=embed), 4)
    got = rows(found, "query_id", "vec_id", "rank")
    assert sum(int(p.name.split("-")[1]) for p in calls.iterdir()) == 294  # six texts are empty once cleaned
    plain = spark.createDataFrame([(k, [float(k % 17 + 1), 1.0]) for k in range(300) if k % 50 != 7], "vec_id long, embedding array<double>")
    assert got == rows(search.knn_expressions(asked.limit(30), plain, 4) if block == 2048 else search.knn(asked, plain, 4), "query_id", "vec_id", "rank")


def test_snapshot_reads_without_a_shuffle(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), 1).create()
    data = [("b", f"f{k % 3}", "h", k, 9, f"text {k}", [float(k)]) for k in range(9)]
    ddl = "bot_id string, file_name string, file_hash string, chunk_index int, total_chunks int, content string, embedding array<double>"
    for seq in (1, 2):
        store.append_chunks(spark.createDataFrame(data, ddl), "t", F.lit(seq))
    store.forget_files(spark.createDataFrame([("b", "f1", 5)], "bot_id string, file_name string, seq int"))
    shot = store.snapshot()
    assert rows(shot, "content", "seq") == [(f"text {k}", 2) for k in range(9) if k % 3 != 1]
    assert "Exchange" not in shot.where("bot_id = 'b'")._jdf.queryExecution().executedPlan().toString()
