"""Tools of bots: descriptors, detection, routing, and requests as a table.

A tool has ``parameters``: map<string, struct<type, description, required, in, mapTo,
default>>. Requests are built, not sent; secrets are no columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import uri_component
from quarry.sources.scratch import stored

PARAMETERS = "map<string,struct<type:string,description:string,required:boolean,in:string,mapTo:string,default:string>>"
REQUEST_DDL = "id STRING, tool STRING, params MAP<STRING, STRING>, _corrupt_record STRING"


def descriptors(tools: DataFrame) -> DataFrame:
    """(tool_id, bot_id, name, descriptor): what a model is told of each enabled tool, as JSON."""
    needed = F.array_sort(F.map_keys(F.map_filter("parameters", lambda _, v: F.coalesce(v["required"], F.lit(False)))))
    names = F.array_sort(F.map_keys("parameters"))
    properties = F.transform(names, lambda n: F.struct(n.alias("name"), F.col("parameters")[n]["type"].alias("type"), F.col("parameters")[n]["description"].alias("description")))
    described = F.struct(F.col("tool_id").alias("id"), "name", "description", F.struct(F.lit("object").alias("type"), properties.alias("properties"), needed.alias("required")).alias("parameters"))
    return tools.where("enabled").select("tool_id", "bot_id", "name", F.to_json(described).alias("descriptor"))


def parsed_requests(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds tool, params and ``broken``, whether the request does not parse; then the others are null."""
    read = raw.withColumn("request", F.from_json(F.col(column), REQUEST_DDL, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("request").isNull() | F.col("request._corrupt_record").isNotNull()
    kept = lambda name: F.when(~broken, F.col(f"request.{name}")).alias(name)
    return read.select(*raw.columns, kept("tool"), kept("params"), broken.alias("broken"))


def routed(requests: DataFrame, tools: DataFrame) -> DataFrame:
    """Requests with the first enabled tool of that name in their bot; none leaves the tool null."""
    fields = [c for c in tools.columns if c not in ("bot_id", "name")]
    first = tools.where("enabled").groupBy("bot_id", F.col("name").alias("tool")).agg(F.min_by(F.struct(*fields), "tool_id").alias("t"))
    return requests.join(first, ["bot_id", "tool"], "left").select(*requests.columns, "t.*")


def rendered(calls: DataFrame) -> DataFrame:
    """Adds ``url`` and ``error`` to calls with endpoint, parameters and params.

    Parameters are taken in the order of their names. A value is the call's argument or
    else the default; arguments that the tool does not define are ignored. Path values are
    appended to the endpoint, less its last slash, query values follow ``?`` or ``&``; a
    parameter that is ``in`` neither is left out. A required parameter without a value makes
    an error and no url.
    """
    names = F.array_sort(F.map_keys("parameters"))
    given = F.transform(
        names,
        lambda n: F.struct(
            F.coalesce(F.nullif(F.col("parameters")[n]["mapTo"], F.lit("")), n).alias("name"),
            F.coalesce(F.try_element_at("params", n), F.col("parameters")[n]["default"]).alias("value"),
            F.coalesce(F.col("parameters")[n]["in"], F.lit("")).alias("place"),
            F.coalesce(F.col("parameters")[n]["required"], F.lit(False)).alias("required"),
            n.alias("key"),
        ),
    )
    rows = calls.withColumn("__given", given)
    missing = F.transform(F.filter("__given", lambda g: g["required"] & g["value"].isNull()), lambda g: g["key"])
    path = F.array_join(F.transform(F.filter("__given", lambda g: (g["place"] == "path") & g["value"].isNotNull()), lambda g: F.concat(F.lit("/"), uri_component(g["value"]))), "")
    query = F.array_join(F.transform(F.filter("__given", lambda g: (g["place"] == "query") & g["value"].isNotNull()), lambda g: F.concat(uri_component(g["name"]), F.lit("="), uri_component(g["value"]))), "&")
    base = F.when(path == "", F.col("endpoint")).otherwise(F.concat(F.regexp_replace("endpoint", "/$", ""), path))
    joint = F.when(query == "", "").when(F.contains(base, F.lit("?")), "&").otherwise("?")
    error = F.when(F.col("endpoint").isNull(), "No such tool").when(F.size(missing) > 0, F.concat(F.lit("Missing required: "), F.array_join(missing, ", ")))
    return rows.withColumn("error", error).withColumn("url", F.when(F.col("error").isNull(), F.concat(base, joint, query))).drop("__given")


def detected(questions: DataFrame, tools: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, bot_id, tool, overlap): the tool whose name and description share most words with a question.

    The default stand-in for a model: at least ``least`` words must be shared; ties go to
    the smaller tool_id. Questions meet only their bot's tools' words, by equality. Tools of
    a bot with the same words are compared as one, that of the smallest tool_id, and so are
    questions of which its tools know the same words: what is compared grows with the
    different sets of words, not with the rows.
    """
    words = lambda text: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")))
    said = tools.where("enabled").select("bot_id", F.struct("tool_id", "name").alias("tool"), words(F.concat_ws(" ", "name", "description")).alias("words"))
    kinds = stored(said.groupBy("bot_id", "words").agg(F.min("tool").alias("tool")), "tools-by-words")
    known = kinds.select("bot_id", "tool", F.explode("words").alias("word"))
    asked = questions.select("query_id", "bot_id", words(F.col("question")).alias("words"))
    each = stored(asked.select("bot_id", "words").distinct(), "questions-by-words")
    # both are read from files, whose size Spark knows: small ones are sent, others shuffled
    held = each.select("bot_id", "words", F.explode("words").alias("word")).join(stored(known.select("bot_id", "word").distinct(), "words-of-tools"), ["bot_id", "word"])
    held = stored(held.groupBy("bot_id", "words").agg(F.array_sort(F.collect_list("word")).alias("held")).where(F.size("held") >= least), "words-held")
    some = held.select("bot_id", "held").distinct().withColumn("word", F.explode("held"))
    shared = some.join(known.hint("shuffle_hash"), ["bot_id", "word"]).groupBy("bot_id", "held", "tool").agg(F.count("*").alias("overlap"))
    best = shared.where(F.col("overlap") >= least).groupBy("bot_id", "held").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "tool")).alias("b"))
    found = stored(held.join(best.hint("merge"), ["bot_id", "held"]).select("bot_id", "words", "b"), "tools-found")
    return asked.join(found, ["bot_id", "words"]).select("query_id", "bot_id", F.col("b.tool.name").alias("tool"), (-F.col("b.less")).alias("overlap"))


#: Words in the names of headers that hold secrets.
SECRET = r"(?i)authorization|cookie|token|secret|password|api[-_]?key"


def request_heads(calls: DataFrame) -> DataFrame:
    """Adds the request's method (GET where none is given) and its headers but those that hold secrets.

    Calls have ``method`` and ``headers`` (map<string,string>) of their tool.
    """
    method = F.upper(F.coalesce(F.nullif(F.trim("method"), F.lit("")), F.lit("GET")))
    shown = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda name, _: ~F.rlike(name, F.lit(SECRET)))
    return calls.withColumn("method", method).withColumn("headers", shown)
