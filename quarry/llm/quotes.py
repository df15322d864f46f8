"""Quotation linking for chat formatting (operator 8). DataFrame functions only.

Lines that begin with ``>`` marks are quoted, one level a mark. Lines of one level that
follow each other are a passage. Passages of every level are looked up, by the hash of
their normalised text, among what earlier messages of the conversation say themselves:
first as whole messages, then as single lines of them; the message that said it first is
the original. A message replies to the original of its first linked passage of the least
level that is linked, as deeper levels quote what the quoted message had quoted itself.
Threads are found by pointer doubling, a number of joins that grows with the logarithm of
their depth. Messages are parsed anew where they are read, so that bodies are shuffled
once, at the end, and never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: Quote marks at a line's start, and the line that announces a quote.
MARKS = r"^[ \t]*(?:>[ \t]*)+"
ANNOUNCES = r"(?i)^[ \t]*(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(normalised(text)))


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, passages) of every message.

    ``body`` is the message without quotes and announcements; ``passages`` are
    (no, level, text) in order, the marks taken off.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    marks = f"length(regexp_replace(regexp_extract(x, '{MARKS}', 0), '[^>]', ''))"
    level = rows.withColumn("level", F.expr(f"transform(lines, x -> {marks})".replace("\\", "\\\\")))
    own = "level[i] = 0 AND NOT (coalesce(get(level, i + 1), 0) > 0 AND lines[i] RLIKE r'{a}')".format(a=ANNOUNCES)
    body = f"trim(BOTH ' \t\r\n' FROM array_join(transform(filter(sequence(0, size(lines) - 1), i -> {own}), i -> lines[i]), '\n'))"
    ends = level.withColumn("ends", F.expr("filter(sequence(0, size(lines) - 1), i -> i = size(lines) - 1 OR level[i] <> level[i + 1])")).withColumn("body", F.expr(body))
    start = "coalesce(get(ends, k - 1), -1) + 1"
    run = f"named_struct('no', k, 'level', level[e], 'text', array_join(transform(slice(lines, {start} + 1, e - ({start}) + 1), x -> regexp_replace(x, r'{MARKS}', '')), '\n'))"
    runs = ends.withColumn("runs", F.expr(f"transform(ends, (e, k) -> {run})"))
    return runs.select("conv_id", "turn", "role", "body", F.expr("filter(runs, x -> x.level > 0 AND trim(x.text) <> '')").alias("passages"))


def originals(said: DataFrame) -> DataFrame:
    """(conv_id, hash, whole, said): the first turn that says a whole message or a line."""
    lines = F.expr("filter(split(body, '\n'), x -> trim(x) <> '')")
    line = said.select("conv_id", "turn", F.explode_outer(lines).alias("line")).where("line IS NOT NULL").select("conv_id", "turn", digest(F.col("line")).alias("hash"), F.lit(0).alias("kind"))
    whole = said.where("body <> ''").select("conv_id", "turn", digest(F.col("body")).alias("hash"), F.lit(1).alias("kind"))
    return whole.union(line).groupBy("conv_id", "hash").agg(F.min(F.when(F.col("kind") == 1, F.col("turn"))).alias("whole"), F.min("turn").alias("said"))


def linked(said: DataFrame) -> DataFrame:
    """(conv_id, turn, n_linked, reply_to) of the parsed messages that quote earlier ones."""
    quoted = said.select("conv_id", "turn", F.inline_outer("passages")).where("level > 0")
    asked = quoted.select("conv_id", "turn", "level", "no", digest(F.col("text")).alias("hash")).union(
        quoted.select("conv_id", "turn", "level", "no", F.explode_outer(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").select("conv_id", "turn", "level", "no", digest(F.col("line")).alias("hash"))
    )
    first = stored(originals(said), "originals")
    found = stored(asked.distinct(), "quoted").join(first.hint("merge"), ["conv_id", "hash"])
    found = found.withColumn("original", F.expr("CASE WHEN whole < turn THEN whole WHEN said < turn THEN said END")).where("original IS NOT NULL")
    # whole messages go before lines, then the lowest level, then the passage that stands first
    passage = found.groupBy("conv_id", "turn", "level", "no").agg(F.min(F.struct(F.expr("coalesce(whole >= turn, true)"), "original")).alias("best"))
    link = passage.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "no", "best.original")).alias("first"), F.count("*").alias("n_linked"))
    return stored(link.select("conv_id", "turn", F.col("first.original").alias("reply_to"), "n_linked"), "reply-links")


def threads(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, thread, depth) of (conv_id, turn, reply_to): the root and the steps to it."""
    now = links.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up")).withColumn("depth", F.lit(1).cast("long"))
    now = stored(now, "thread-pointers")
    for _ in range(max_rounds):
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = stored(now.join(above.hint("merge"), ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "thread-pointers")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
    raise RuntimeError("threads did not settle")


def reply_ordered(messages: DataFrame, **columns: str) -> DataFrame:
    """Every message without its quotes, and its place among the replies.

    (conv_id, turn, role, thread, depth, reply_to, n_quotes, n_linked, text): sorted by
    conv_id, thread, turn the messages stand in reply order, as a reply's turn is larger
    than what it replies to. A message without a linked quote begins a thread. A null text
    is empty; a message with a null conv_id or turn begins a thread of its own. Messages
    that repeat a conv_id and turn are reported each and share their links. An empty table
    gives no rows; a text is held whole as an array of its lines.
    """
    said = parsed(messages, **columns)
    links = linked(said)
    found = links.join(threads(links).hint("merge"), ["conv_id", "turn"], "left")
    replies = stored(found, "replies")
    bodies = said.select("conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_quotes"))
    out = bodies.join(replies.hint("merge"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "reply_to", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("body").alias("text"))


def conversations(ordered: DataFrame, max_messages: int = 1000) -> DataFrame:
    """(conv_id, thread, part, messages, n_quotes, n_linked): threads as lists of (turn, role, text) in reply order.

    A part holds the messages of ``max_messages`` consecutive turns, so that no list grows
    with the length of a thread; read by part, the lists give the whole thread. Messages
    that repeat a conv_id and turn are one message here: that of the least role and text.
    Messages with a null conv_id or turn are no part of a conversation.
    """
    each = ordered.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "thread", "turn").agg(F.min(F.struct("role", "text")).alias("m"), F.max("n_quotes").alias("n_quotes"), F.max("n_linked").alias("n_linked"))
    part = F.floor((F.col("turn") - F.col("thread")) / max_messages)
    entry = F.struct("turn", "m.role", "m.text")
    return each.groupBy("conv_id", "thread", part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"))


def with_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): messages that quote the ones before them, as mail programs do.

    By its turn modulo four a message quotes nothing; the message before it; that and, one
    level deeper, the one before that; or only the latter.
    """
    one = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    back = [one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"back{k}")) for k in (1, 2)]
    both = messages.join(back[0].hint("merge"), ["conv_id", "turn"], "left").join(back[1].hint("merge"), ["conv_id", "turn"], "left")
    quote = lambda k, mark: F.when(F.col(f"back{k}").isNotNull(), F.concat(F.lit(mark), F.replace(F.col(f"back{k}"), F.lit("\n"), F.lit("\n" + mark))))
    turn = F.col("turn") % 4
    text = F.concat_ws("\n", F.when(turn >= 2, quote(2, ">> ")), F.when((turn == 1) | (turn == 2), quote(1, "> ")), "text")
    return both.select("conv_id", "turn", "role", text.alias("text"))


WITH_QUOTES = """
one AS (SELECT conv_id, turn, min(text) AS said FROM {source} GROUP BY ALL),
quoted AS (SELECT c.conv_id, c.turn, c.role, concat_ws(chr(10),
  CASE WHEN c.turn % 4 >= 2 THEN '>> ' || replace(b.said, chr(10), chr(10) || '>> ') END,
  CASE WHEN c.turn % 4 IN (1, 2) THEN '> ' || replace(a.said, chr(10), chr(10) || '> ') END, c.text) AS text
FROM {source} c LEFT JOIN one a ON a.conv_id = c.conv_id AND a.turn + 1 = c.turn LEFT JOIN one b ON b.conv_id = c.conv_id AND b.turn + 2 = c.turn)"""

SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
e AS (SELECT id, conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM m),
v AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level FROM e),
w AS (SELECT *, lag(level) OVER o AS above, lead(level) OVER o AS below FROM v WINDOW o AS (PARTITION BY id ORDER BY i)),
b AS (SELECT id, conv_id, turn, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(below, 0) > 0 AND regexp_matches(line, '(?i)^[ \t]*(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$'))), ''), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM w GROUP BY ALL),
g AS (SELECT *, sum((level IS DISTINCT FROM above)::INT) OVER (PARTITION BY id ORDER BY i) AS no FROM w),
p AS (SELECT id, conv_id, turn, no, level, string_agg(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', ''), chr(10) ORDER BY i) AS text FROM g WHERE level > 0 GROUP BY ALL HAVING trim(string_agg(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', ''), chr(10) ORDER BY i)) <> ''),
said AS (SELECT conv_id, turn, body AS t, 1 AS whole FROM b WHERE body <> '' UNION ALL SELECT conv_id, turn, t, 0 FROM (SELECT conv_id, turn, unnest(string_split(body, chr(10))) AS t FROM b) WHERE trim(t) <> ''),
o AS (SELECT conv_id, lower(trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'))) AS t, min(turn) FILTER (whole = 1) AS whole, min(turn) AS said FROM said GROUP BY ALL),
q AS (SELECT conv_id, turn, level, no, text AS t FROM p UNION SELECT conv_id, turn, level, no, t FROM (SELECT conv_id, turn, level, no, unnest(string_split(text, chr(10))) AS t FROM p) WHERE trim(t) <> ''),
f AS (SELECT q.conv_id, q.turn, level, no, coalesce(o.whole >= q.turn, true) AS part, CASE WHEN o.whole < q.turn THEN o.whole WHEN o.said < q.turn THEN o.said END AS original FROM q JOIN o ON q.conv_id = o.conv_id AND lower(trim(regexp_replace(q.t, '[\x20\x09-\x0D]+', ' ', 'g'))) = o.t),
k AS (SELECT conv_id, turn, level, no, arg_min(original, part::INT * 1000000000000 + original) AS original FROM f WHERE original IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, turn, arg_min(original, level * 1000000000 + no) AS reply_to, count(*) AS n_linked FROM k GROUP BY ALL),
t AS (SELECT conv_id, turn, turn AS up, 0 AS depth FROM (SELECT DISTINCT conv_id, turn FROM m) UNION ALL SELECT t.conv_id, t.turn, r.reply_to, depth + 1 FROM t JOIN r ON t.conv_id = r.conv_id AND t.up = r.turn),
d AS (SELECT conv_id, turn, arg_max(up, depth) AS thread, max(depth) AS depth FROM t GROUP BY ALL),
c AS (SELECT id, count(*) AS n FROM p GROUP BY id)
SELECT m.conv_id, m.turn, m.role, coalesce(d.thread, m.turn) AS thread, coalesce(d.depth, 0)::BIGINT AS depth, r.reply_to, coalesce(c.n, 0) AS n_quotes, coalesce(r.n_linked, 0) AS n_linked, b.body AS text
FROM m JOIN b ON b.id = m.id LEFT JOIN d ON d.conv_id = m.conv_id AND d.turn = m.turn LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn LEFT JOIN c ON c.id = m.id
"""

#: The same over messages that quote each other, with each thread as one text.
CONVERSATIONS_SQL = (
    SQL.replace("WITH RECURSIVE m AS", "WITH RECURSIVE" + WITH_QUOTES.format(source="conversations") + ",\nm AS").replace("FROM conversations),\ne AS", "FROM quoted),\ne AS").replace("\nSELECT m.conv_id", ",\nordered AS (SELECT m.conv_id")
    + r""")
, each AS (SELECT conv_id, thread, turn, min(role) AS role, min(text) AS text, max(n_quotes) AS n_quotes, max(n_linked) AS n_linked FROM ordered GROUP BY ALL)
SELECT conv_id, thread, ((turn - thread) // 1000)::BIGINT AS part, count(*) AS n_messages, sum(n_quotes)::BIGINT AS n_quotes, sum(n_linked)::BIGINT AS n_linked,
string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS conversation FROM each GROUP BY ALL
"""
)
