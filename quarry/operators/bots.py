"""Creation of bots as a job over requests: owner, key, defaults, vector table, and removal where that fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import trimmed
from quarry.operators.tables import entity_key

#: What a new bot is unless the request says otherwise.
DEFAULTS = {"instruction": "You are a helpful assistant.", "kb_search_method": "semantic", "is_active": True, "public_access": False}
NO_OWNER, NO_NAME, FAILED = "Owner not found", "bot_name is required", "Failed to create bot"
#: Opens the vector tables of a batch: for each name None, or why it could not be opened.
Open = Callable[[list[str]], list[str | None]]


def created_bots(requests: DataFrame, users: DataFrame, millis: Column, opened: Open | None = None) -> DataFrame:
    """A row a request: the bot that it makes, and ``error`` where it makes none; then its bot_id is null.

    Requests are (request_id, bot_name, bot_desc, owner), the owner an e-mail address of ``users``
    (email and any other fields, which the bot embeds). ``millis`` is the time of a request, from which
    and whose id the key is made, so that a repeated run makes the same bot. Of users with one
    address the least counts. ``opened`` is called once a batch; a bot whose table it cannot open is
    taken back.
    """
    owners = users.groupBy(F.col("email").alias("__email")).agg(F.min(F.struct(*users.columns)).alias("owner_row"))
    joined = requests.join(owners.hint("merge"), requests["owner"] == owners["__email"], "left")
    key = entity_key("bot", millis, F.col("request_id").cast("string"))
    error = F.when(F.col("owner_row").isNull(), NO_OWNER).when(F.coalesce(trimmed(F.col("bot_name")), F.lit("")) == "", NO_NAME)
    members = F.struct(F.array("owner").alias("users"), F.lit(1).cast("long").alias("total"))
    made = joined.select(
        "request_id", error.alias("error"), key.alias("bot_id"), trimmed(F.col("bot_name")).alias("bot_name"), trimmed(F.col("bot_desc")).alias("bot_desc"), F.col("owner_row").alias("owner"),
        F.concat(F.lit("vector_table_"), key).alias("vector_table"), members.alias("bot_users"), *(F.lit(v).alias(k) for k, v in DEFAULTS.items()),
    )
    made = opened_tables(made, opened) if opened else made
    taken = [c for c in made.columns if c not in ("request_id", "error", "owner")]
    return made.select("request_id", "error", "owner", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in taken))


def opened_tables(made: DataFrame, opened: Open) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            todo = batch["error"].isna().to_numpy()
            errors = batch["error"].astype(object).where(batch["error"].notna(), None)
            names = batch.loc[todo, "vector_table"].tolist()
            try:
                found = opened(names) if names else []
            except Exception as error:  # the store is down: all of the batch are taken back
                found = [str(error)] * len(names)
            errors[todo] = [None if e is None else f"{FAILED}: {e}" for e in found]
            yield batch.assign(error=errors)

    plain = made.select("request_id", "error", "vector_table")
    checked = plain.mapInPandas(run, plain.schema).select("request_id", F.col("error").alias("__error"))
    return made.drop("error").join(checked.hint("merge"), "request_id").withColumnRenamed("__error", "error")
