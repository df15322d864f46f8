"""Contexts and prompts: ordered aggregation of ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import has_text

#: The layouts of contexts, and the answer where there is none.
PLAIN, MARKDOWN = "[Context {i}]: {content}", "### Context Source {i}\n{content}"
NO_ANSWER = "I don't know."
ANSWER_PROMPT = "Answer the question from the context alone. If the context does not hold the answer, say \"{no_answer}\"\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"
TOOL_PROMPT = "{system_prompt}\n\nThe user asked: {question}\nThe tool returned: {result}\n\nAnswer the user from what the tool returned."


def fill(template: str, **values: Column | str) -> Column:
    """The template with its ``{names}`` replaced by columns; a null value is empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        text, brace, tail = rest.partition("{")
        if text:
            parts.append(F.lit(text))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        value = values[name]
        parts.append(F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*parts)


def in_order(order: str, value: str) -> Column:
    """Aggregate: the values sorted by ``order``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def contexts(hits: DataFrame, query: str = "query_id", layout: str = PLAIN) -> DataFrame:
    """(query, context): the chunks of each question by rank, numbered from 1. A question's chunks are as many as k."""
    shown = hits.withColumn("shown", fill(layout, i=F.col("rank"), content=F.col("content")))
    return shown.groupBy(query).agg(F.array_join(in_order("rank", "shown"), "\n\n").alias("context"))


def trimmed(hits: DataFrame, budget: int, query: str = "query_id") -> DataFrame:
    """Chunks while their characters, added up by rank, stay within the budget; the first always stays."""
    used = F.sum(F.length("content")).over(Window.partitionBy(query).orderBy("rank"))
    return hits.withColumn("used", used.cast("long")).where((F.col("used") <= budget) | (F.col("rank") == 1))


def citations(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, citations): file and place of each chunk, by rank."""
    cited = hits.withColumn("cited", F.concat_ws("#", F.col("file_name"), F.col("chunk_index").cast("string")))
    return cited.groupBy(query).agg(F.array_join(in_order("rank", "cited"), "; ").alias("citations"))


def prompts(asked: DataFrame, context: DataFrame, query: str = "query_id", template: str = ANSWER_PROMPT) -> DataFrame:
    """Every question with its context in a prompt; a question without hits has an empty context."""
    both = asked.join(context.hint("shuffle_hash"), query, "left")
    return both.withColumn("prompt", fill(template, question=F.col("question"), context=F.col("context"), no_answer=NO_ANSWER))


#: Fixed value: what a caller is told when nothing was found.
NOTHING_FOUND = "No relevant information found"
CHAT_PROMPT = "Write the answer in Markdown: bold key terms, code for technical names, lists for steps, tables for comparisons.\n\nContext:\n{context}\n\nQuestion:\n{prompt}\n\nAnswer in Markdown:"


def chat_prompts(asked: DataFrame, context: DataFrame, query: str = "query_id", template: str = CHAT_PROMPT) -> DataFrame:
    """Adds ``sent``, ``said`` and ``error`` to questions that come with a ``prompt`` of their own.

    Chunks are found by the question, but the prompt is what the model is sent. A blank prompt is an
    error; where nothing was found the model is not asked and ``said`` is a fixed message.
    """
    both = asked.join(context.hint("shuffle_hash"), query, "left")
    bad, none = ~has_text(F.col("prompt")), F.col("context").isNull()
    sent = F.when(~bad & ~none, fill(template, context=F.col("context"), prompt=F.col("prompt")))
    return both.select(*asked.columns, sent.alias("sent"), F.when(~bad & none, NOTHING_FOUND).alias("said"), F.when(bad, "Prompt is required").alias("error"))


def last_turns(messages: DataFrame, n: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n turns of each conversation as one text, oldest first."""
    recent = Window.partitionBy(conversation).orderBy(F.desc(turn))
    kept = messages.withColumn("__back", F.row_number().over(recent)).where(F.col("__back") <= n)
    line = kept.withColumn("line", F.concat_ws(": ", "role", "text"))
    return line.groupBy(conversation).agg(F.array_join(in_order(turn, "line"), "\n").alias("history"), F.count("*").alias("turns"))
