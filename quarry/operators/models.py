"""Hooks for models in batches, with defaults that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import trimmed
from quarry.operators.context import NO_ANSWER, TOOL_PROMPT, fill
from quarry.operators.tools import detected, rendered, routed

Generate = Callable[[list[str]], list[str]]


def generated(rows: DataFrame, generate: Generate, prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds a model's answer, trimmed, and ``error`` where it gave none. The model is called once a batch."""
    schema = rows.withColumn(out, F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = [None if a is None else a.strip() for a in generate(batch[prompt].tolist())]
                errors = [None if a else "No response from the model" for a in answers]
            except Exception as error:  # a failed call is an error row that the caller sees
                answers, errors = [None] * len(batch), [str(error)] * len(batch)
            yield batch.assign(**{out: answers, "error": errors})

    return rows.mapInPandas(run, schema)


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("error IS NULL"), rows.where("error IS NOT NULL")


def extractive_answers(asked: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """The default answer: the nearest chunk, or that nothing is known."""
    top = hits.where("rank = 1").select(query, trimmed(F.col("content")).alias("__top"))
    joined = asked.join(top.hint("shuffle_hash"), query, "left")
    return joined.withColumn("answer", F.coalesce(F.nullif("__top", F.lit("")), F.lit(NO_ANSWER))).drop("__top")


def answered(asked: DataFrame, hits: DataFrame, tool_answers: DataFrame, query: str = "query_id") -> DataFrame:
    """A tool's answer where there is one, else the answer from the chunks: a failed tool falls through."""
    found = extractive_answers(asked, hits, query)
    tool = tool_answers.select(query, F.col("answer").alias("__tool"))
    joined = found.join(tool.hint("shuffle_hash"), query, "left")
    source = F.when(F.col("__tool").isNotNull(), "tool").when(F.col("answer") == NO_ANSWER, "none").otherwise("context")
    return joined.withColumn("answered_by", source).withColumn("answer", F.coalesce("__tool", "answer")).drop("__tool").withColumn("success", F.col("answered_by") != "none")


def expanded(asked: DataFrame, synonyms: DataFrame, query: str = "query_id", text: str = "question") -> DataFrame:
    """Questions with the synonyms of their words appended, in order of the words' places."""
    words = asked.select(query, F.posexplode(F.split(F.lower(text), "[^\\p{L}\\p{N}]+")).alias("place", "word"))
    added = words.join(synonyms.hint("shuffle_hash"), "word").groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "synonym"))), lambda x: x["synonym"]), " ").alias("__more"))
    out = F.concat_ws(" ", F.col(text), F.col("__more"))
    return asked.join(added.hint("shuffle_hash"), query, "left").withColumn("expanded", out).drop("__more")


def answered_from_tools(calls: DataFrame, generate: Generate) -> DataFrame:
    """Adds answer and error to calls with question, result and system_prompt: what a model makes of a tool's result.

    ``result`` is a struct or a map; the model is shown it as JSON.
    """
    prompt = fill(TOOL_PROMPT, system_prompt=F.col("system_prompt"), question=F.col("question"), result=F.to_json("result"))
    return generated(calls.withColumn("prompt", prompt), generate).drop("prompt")


def tool_answers(asked: DataFrame, tools: DataFrame, generate: Generate, call: Generate, least: int = 2, query: str = "query_id") -> DataFrame:
    """(query, tool, url, answer, error) of the questions for which a tool is chosen: detected, routed,
    rendered, called and answered from what it returned.

    ``call`` takes a batch of urls and gives what each returned; tools have ``system_prompt``. A
    request that cannot be rendered, a call or an answer that fails has an error and no answer.
    """
    chosen = detected(asked, tools, least).withColumn("params", F.create_map().cast("map<string,string>"))
    calls = rendered(routed(chosen, tools)).select(query, "tool", "url", "system_prompt", F.col("error").alias("__no_request"))
    known = calls.join(asked.select(query, "question").hint("shuffle_hash"), query)
    returned = generated(known, lambda urls: answers_of(urls, call), "url", "body").withColumnRenamed("error", "__no_result")
    said = answered_from_tools(returned.withColumn("result", F.struct("body")), lambda prompts: prompts and generate(prompts))
    error = F.coalesce("__no_request", "__no_result", "error")
    return said.select(query, "tool", "url", F.when(error.isNull(), F.col("answer")).alias("answer"), error.alias("error"))


def answers_of(asked: list[str | None], call: Generate) -> list[str | None]:
    """Calls for what is given, and nothing for what is not."""
    own = [a for a in asked if a is not None]
    given = iter(call(own) if own else [])
    return [None if a is None else next(given) for a in asked]
