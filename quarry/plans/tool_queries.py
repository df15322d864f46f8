"""Queries of tools: parts stand for the tools of bots, events for calls of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import tools as t
from quarry.operators.models import answered_from_tools, split_errors
from quarry.plans.registry import query
from quarry.plans.scenario import table

BOTS = 5


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    field = lambda kind, text, required, place, default: F.struct(F.lit(kind).alias("type"), text.alias("description"), required.alias("required"), F.lit(place).alias("in"), F.lit(None).cast("string").alias("mapTo"), default.alias("default"))
    parameters = F.create_map(
        F.lit("size"), field("number", F.col("p_brand"), F.col("p_size") > 25, "query", F.when(F.col("p_size") < 10, F.col("p_size").cast("string"))),
        F.lit("kind"), field("string", F.col("p_type"), F.lit(False), "path", F.when(F.col("p_size") % 5 != 0, F.concat("p_type", F.lit(" & co")))),
        F.lit("note"), field("string", F.col("p_brand"), F.lit(False), None, F.lit("nowhere")),
    )
    return part.select(
        F.col("p_partkey").alias("tool_id"), F.concat(F.lit("src"), (F.col("p_partkey") % BOTS).cast("string")).alias("bot_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"), parameters.alias("parameters"), (F.col("p_size") % 3 != 0).alias("enabled"),
        F.concat(F.lit("https://api.example.com/"), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "/").otherwise("?v=1")).alias("endpoint"),
    )


TOOLS_SQL = f"""tools AS (SELECT p_partkey AS tool_id, 'src' || (p_partkey % {BOTS}) AS bot_id, replace(p_name, ' ', '_') AS name, p_type || ' ' || p_brand AS description, p_size % 3 <> 0 AS enabled,
'https://api.example.com/' || lower(p_type) || (CASE WHEN p_size % 2 = 0 THEN '/' ELSE '?v=1' END) AS endpoint, p_size, p_type, p_brand, p_size > 25 AS needs, CASE WHEN p_size < 10 THEN p_size::VARCHAR END AS fallback FROM part)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model might say for each event; errors are cut short."""
    k = F.get_json_object("props", "$.k").cast("long")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), "event_type", k.alias("k"))
    params = F.when(F.col("event_type") == "view", F.lit("{}")).otherwise(F.format_string('{"size": "%d", "other": "x"}', "k"))
    raw = F.concat(F.format_string('{"id": "%d", "tool": "%s", "params": ', "query_id", "name"), params, F.when(F.col("event_type") == "error", "").otherwise("}"))
    return events.join(part.hint("merge"), "k").select("query_id", F.concat(F.lit("src"), (F.col("k") % BOTS).cast("string")).alias("bot_id"), raw.alias("raw"))


REQUESTS = f"""calls AS (SELECT event_id AS query_id, 'src' || (k % {BOTS}) AS bot_id, replace(p_name, ' ', '_') AS tool, k, event_type FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) JOIN part ON p_partkey = k)"""
FIRST = "firsts AS (SELECT bot_id, name AS tool, min(tool_id) AS tool_id FROM tools WHERE enabled GROUP BY ALL)"


@query(
    f"""WITH {TOOLS_SQL} SELECT tool_id, bot_id, name, '{{"id":' || tool_id || ',"name":"' || name || '","description":"' || description || '","parameters":{{"type":"object","properties":[{{"name":"kind","type":"string","description":"' || p_type || '"}},{{"name":"note","type":"string","description":"' || p_brand || '"}},{{"name":"size","type":"number","description":"' || p_brand || '"}}],"required":[' || (CASE WHEN needs THEN '"size"' ELSE '' END) || ']}}}}' AS descriptor FROM tools WHERE enabled"""
)
def tool_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.descriptors(tools(spark, sf_dir))


@query(f"WITH {REQUESTS} SELECT query_id, CASE WHEN event_type <> 'error' THEN tool END AS tool, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE k::VARCHAR END AS size, event_type = 'error' AS broken FROM calls")
def tool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.parsed_requests(requests(spark, sf_dir)).select("query_id", "tool", F.try_element_at("params", F.lit("size")).alias("size"), "broken")


@query(f"WITH {TOOLS_SQL}, {REQUESTS}, {FIRST} SELECT query_id, calls.bot_id, tool, tool_id FROM calls LEFT JOIN firsts USING (bot_id, tool) WHERE event_type <> 'error'")
def tool_route_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = t.parsed_requests(requests(spark, sf_dir)).where("NOT broken")
    return t.routed(good, tools(spark, sf_dir)).select("query_id", "bot_id", "tool", "tool_id")


@query(
    f"""WITH {TOOLS_SQL}, {REQUESTS}, {FIRST}, r AS (SELECT query_id, tools.*, CASE WHEN event_type <> 'view' THEN k::VARCHAR ELSE fallback END AS size FROM calls LEFT JOIN firsts ON firsts.bot_id = calls.bot_id AND firsts.tool = calls.tool LEFT JOIN tools ON tools.tool_id = firsts.tool_id WHERE event_type <> 'error'),
b AS (SELECT *, CASE WHEN tool_id IS NULL THEN 'No such tool' WHEN needs AND size IS NULL THEN 'Missing required: size' END AS error, CASE WHEN p_size % 5 <> 0 THEN regexp_replace(endpoint, '/$', '') || '/' || replace(replace(p_type, ' ', '%20'), '&', '%26') || '%20%26%20co' ELSE endpoint END AS base FROM r)
SELECT query_id, tool_id, error, CASE WHEN error IS NULL THEN base || (CASE WHEN size IS NULL THEN '' WHEN contains(base, '?') THEN '&' ELSE '?' END) || coalesce('size=' || size, '') END AS url FROM b"""
)
def tool_request_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = t.parsed_requests(requests(spark, sf_dir)).where("NOT broken")
    return t.rendered(t.routed(good, tools(spark, sf_dir))).select("query_id", "tool_id", "error", "url")


@query(
    f"""WITH {TOOLS_SQL}, {REQUESTS}, w AS (SELECT DISTINCT query_id, bot_id, unnest(list_filter(regexp_split_to_array(lower('please find ' || tool || ' ' || event_type), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM calls),
n AS (SELECT DISTINCT bot_id, tool_id, name, unnest(list_filter(regexp_split_to_array(lower(name || ' ' || description), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM tools WHERE enabled),
s AS (SELECT query_id, w.bot_id, tool_id, name, count(*) AS overlap FROM w JOIN n ON n.bot_id = w.bot_id AND n.word = w.word GROUP BY ALL HAVING count(*) >= 2)
SELECT query_id, bot_id, arg_min(name, tool_id - overlap * 1000000000) AS tool, max(overlap) AS overlap FROM s GROUP BY query_id, bot_id"""
)
def tool_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), "event_type", k.alias("k")).join(part.hint("merge"), "k")
    asked = events.select("query_id", F.concat(F.lit("src"), (F.col("k") % BOTS).cast("string")).alias("bot_id"), F.concat(F.lit("please find "), F.replace("name", F.lit("_"), F.lit(" ")), F.lit(" "), "event_type").alias("question"))
    return t.detected(asked, tools(spark, sf_dir).withColumn("name", F.col("name")))


@query(
    f"""SELECT event_id AS query_id, 'You speak for src' || (user_id % {BOTS}) || '.' || chr(10) || chr(10) || 'The user asked: What happened in event ' || event_id || '?' || chr(10) || 'The tool returned: {{"event":"' || event_type || '","user":' || user_id || '}}' || chr(10) || chr(10) || 'Answer the user from what the tool returned.' AS answer FROM events WHERE event_type <> 'error'"""
)
def tool_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from tools' results; the stand-in model says back what it is shown, and fails on errors."""
    events = table(spark, sf_dir, "events")
    calls = events.select(
        F.col("event_id").alias("query_id"), F.format_string("What happened in event %d?", "event_id").alias("question"), F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user")).alias("result"),
        F.format_string("You speak for src%d.", F.col("user_id") % BOTS).alias("system_prompt"),
    )
    said = answered_from_tools(calls, lambda prompts: [None if '"event":"error"' in p else p for p in prompts])
    good, _ = split_errors(said)
    return good.select("query_id", "answer")


@query("SELECT p_partkey AS tool_id, CASE WHEN p_size % 3 = 0 THEN 'GET' WHEN p_size % 3 = 1 THEN 'POST' ELSE 'PUT' END AS method, 'X-Brand=' || p_brand AS headers FROM part")
def tool_request_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and headers of tools; headers with secrets are left out."""
    part = table(spark, sf_dir, "part")
    kind = F.col("p_size") % 3
    calls = part.select(
        F.col("p_partkey").alias("tool_id"), F.when(kind == 0, "").when(kind == 1, "post").otherwise(" Put ").alias("method"),
        F.create_map(F.lit("X-Brand"), F.col("p_brand"), F.lit("Authorization"), F.lit("none"), F.lit("x-api-key"), F.lit("none")).alias("headers"),
    )
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return t.request_heads(calls).select("tool_id", "method", shown.alias("headers"))
