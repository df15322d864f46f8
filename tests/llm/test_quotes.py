import duckdb

from quarry.llm.quotes import SQL, conversations, parsed, reply_ordered, with_quotes

ROWS = [
    (1, 0, "user", "Hello there\nHow are you?"),
    (1, 1, "assistant", "Fine."),
    (1, 2, "user", "On Monday someone wrote:\n> Hello  there\n> how are YOU?\nGood to know"),
    (1, 3, "assistant", ">> Hello there\n>> How are you?\n> Good to know\nYes\n> nowhere said\nindeed"),
    (1, 4, "user", "> How are you?\n\n> Fine.\nSingle lines"),
    (1, 5, "user", "> Single lines\n> Yes\n> indeed\nok"),
    (1, 6, "user", "> ok\n5 > 3"),
    (2, 0, "user", "> Hello there\nother conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", "> "),
    (3, 5, "user", "same"),
    (3, 5, "user", "same"),
    (3, 6, "user", "> same\nsame"),
    (3, 7, "user", "> same\nlater"),
    (None, 1, "user", "> same\nnull conversation"),
    (3, None, "user", "> same\nnull turn"),
    (4, 0, "user", "long " * 20_000),
    (5, 0, "user", "first words"),
    (5, 1, "user", "second words"),
    (5, 2, "user", ">> first words\nonly a deeper quote"),
    (5, 3, "user", ">>> first words\n>> second words\n> nobody said this\nmixed"),
    (5, 4, "user", ">> first words\n> second words\n>> second words\nall levels"),
]


def test_against_sql(spark):
    chain = [(9, k, "user", f"> word {k - 1}\nword {k}" if k else "word 0") for k in range(40)]
    rows = [(*r, "x") for r in ROWS + chain]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, thread string").repartition(4)
    got = reply_ordered(messages)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    want = con.sql(SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    by = {(r["conv_id"], r["turn"]): r for r in got.where("conv_id IS NOT NULL AND turn IS NOT NULL").collect()}
    assert [by[1, k]["reply_to"] for k in range(7)] == [None, None, 0, 2, 0, 4, 5]
    assert by[1, 2]["text"] == "Good to know" and by[1, 3]["text"] == "Yes\nindeed"
    assert by[9, 39]["depth"] == 39 and by[9, 39]["thread"] == 0
    assert by[2, 0]["n_linked"] == 0 and by[3, 7]["reply_to"] == 5
    assert [(by[5, k]["reply_to"], by[5, k]["n_quotes"], by[5, k]["n_linked"]) for k in (2, 3, 4)] == [(0, 1, 1), (1, 3, 2), (1, 3, 3)]
    whole = {(r["conv_id"], r["thread"]): [m["turn"] for m in r["messages"]] for r in conversations(got).collect()}
    assert whole[1, 0] == [0, 2, 3, 4, 5, 6] and whole[1, 1] == [1]
    assert reply_ordered(messages.limit(0)).count() == 0


def test_levels(spark):
    one = parsed(spark.createDataFrame([(1, 1, "user", "a\n> > b\n>c\n >d\ne")], "conv_id long, turn long, role string, text string")).first()
    assert one["body"] == "a\ne"
    assert [(p["level"], p["text"]) for p in one["passages"]] == [(2, "b"), (1, "c\nd")]


def test_threads_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert with_quotes(none).count() == 0 == conversations(reply_ordered(with_quotes(none))).count()
