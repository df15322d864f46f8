"""Usage in event-time windows as sketches that merge: no event is read again for a wider window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct sketch (an error of some 1.6 %), and the size parameter of a quantile sketch (ranks within some 1 %).
REGISTERS, WEIGHT = 12, 200


def rollup(events: DataFrame, width: str = "1 hour", kind: str = "event_type", value: str = "value", at: str = "ts", user: str = "user_id") -> DataFrame:
    """(kind, since, calls, valued, total, most, first, last, users, spread) of each window; the last two are sketches.

    Rows without a time are left out; null users and values count for nothing in their sketch. On a
    stream, set a watermark on ``at``: windows are then final once it has passed them.
    """
    time = F.col(at).cast("timestamp")
    since = F.window(time, width)["start"]
    own = events.where(time.isNotNull()).select(F.col(kind).alias("kind"), since.alias("since"), F.col(value).cast("double").alias("v"), F.col(user).cast("string").alias("u"), time.alias("at"))
    return own.groupBy("kind", "since").agg(
        F.count("*").alias("calls"), F.count("v").alias("valued"), F.sum("v").alias("total"), F.max("v").alias("most"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.hll_sketch_agg("u", REGISTERS).alias("users"), F.kll_sketch_agg_double("v", WEIGHT).alias("spread"),
    )


def merged(rollups: DataFrame, width: str | None = None) -> DataFrame:
    """The same columns for wider windows, or without a width for all time, from rollups alone."""
    since = F.window("since", width)["start"] if width else F.lit(None).cast("timestamp")
    return rollups.select("kind", since.alias("wide"), *(c for c in rollups.columns if c not in ("kind", "since"))).groupBy("kind", F.col("wide").alias("since")).agg(
        F.sum("calls").alias("calls"), F.sum("valued").alias("valued"), F.sum("total").alias("total"), F.max("most").alias("most"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("spread").alias("spread"),
    )


def read_off(rollups: DataFrame, quantile: float = 0.5) -> DataFrame:
    """(kind, since, calls, users, mean, most, quantile, seconds): estimates of the distinct users and the quantile."""
    seconds = F.round((F.unix_micros("last") - F.unix_micros("first")) / 1e6, 2)
    return rollups.select("kind", "since", "calls", F.hll_sketch_estimate("users").alias("users"), F.try_divide("total", "valued").alias("mean"), "most", F.kll_sketch_get_quantile_double("spread", F.lit(quantile)).alias("quantile"), seconds.alias("seconds"))
