"""Table maintenance: change logs, latest states, tombstones and constraint checks.

Parquet has no MERGE, so entities are kept as append-only logs and read through views.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """Rows of one page, in the order of ``key``; pages count from 1."""
    if number < 1 or size < 1:
        raise ValueError("page and size must be 1 or more")
    return rows.orderBy(key).offset((number - 1) * size).limit(size)


def first_match(rows: DataFrame, key: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; aggregated, not sorted."""
    first = F.min_by(F.struct(*fields), order)
    return rows.groupBy(*key).agg(first.alias("__first")).select(*key, "__first.*")


def latest_state(log: DataFrame, key: str, fields: Sequence[str], seq: str = "seq", op: str = "op", changed: str = "changed", at: str = "at") -> DataFrame:
    """State of each entity after its log.

    A log row has an operation (insert, update, delete), the set of fields it gives, their
    values and its sequence number. A field's value is that of the last row that gave it
    since the last delete, so an explicit null stands and a field that is not given stays.
    created_at and updated_at span the rows since then. Deleted entities are not returned.
    """
    deleted = log.groupBy(key).agg(F.max(F.when(F.col(op) == "delete", F.col(seq))).alias("__deleted"))
    alive = log.join(deleted, key).where((F.col(op) != "delete") & (F.col("__deleted").isNull() | (F.col(seq) > F.col("__deleted"))))
    last = [F.max_by(F.struct(F.col(f)), F.when(F.array_contains(changed, f), F.col(seq))).getField(f).alias(f) for f in fields]
    return alive.groupBy(key).agg(*last, F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count("*").alias("versions"))


def without_deleted(rows: DataFrame, tombstones: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Rows that no later tombstone of their key hides; what is written after a tombstone stays."""
    latest = tombstones.groupBy(*keys).agg(F.max(seq).alias("__gone"))
    joined = rows.join(latest, list(keys), "left")
    return joined.where(F.col("__gone").isNull() | (F.col(seq) > F.col("__gone"))).drop("__gone")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def with_owner(rows: DataFrame, owners: DataFrame, key: str, owner_key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their owner embedded as a struct, and the rows whose owner does not exist."""
    owner = owners.select(F.col(owner_key).alias("__owner"), F.struct(*fields).alias("owner"))
    joined = rows.join(owner, rows[key] == owner["__owner"], "left")
    return joined.where("owner IS NOT NULL").drop("__owner"), joined.where("owner IS NULL").drop("__owner", "owner")


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], digest: str = "file_hash") -> DataFrame:
    """(keys, status): new, changed, same or gone, by the content's hash."""
    a, b = old.select(*keys, F.col(digest).alias("__old")), new.select(*keys, F.col(digest).alias("__new"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(F.col("__old") == F.col("__new"), "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


@dataclass(frozen=True)
class Rule:
    """A named condition that holds for valid rows."""

    name: str
    holds: Column


def required(field: str) -> Rule:
    return Rule(f"{field} is required", F.col(field).isNotNull() & (F.trim(F.col(field).cast("string")) != ""))


def one_of(field: str, *values: object) -> Rule:
    return Rule(f"{field} is not allowed", F.col(field).isNull() | F.col(field).isin(*values))


def violations(rows: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(key, violation): one row for each broken rule, in one pass over the table."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(broken).alias("violation"))


def repeated(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Values that more than one row has, and how many."""
    return rows.groupBy(*fields).agg(F.count("*").alias("rows")).where("rows > 1")


def normalised(rows: DataFrame, trimmed: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Text fields trimmed, missing fields set to their defaults."""
    changed = {f: F.trim(F.col(f)) for f in trimmed}
    changed |= {f: F.coalesce(F.trim(F.col(f)) if f in trimmed else F.col(f), F.lit(v)) for f, v in defaults.items()}
    return rows.withColumns(changed)


def or_default(value: Column, default: object) -> Column:
    """A default for null and for zero, as scripting languages' "or" gives it."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def entity_key(prefix: str, millis: Column, seed: Column) -> Column:
    """prefix_<base-36 time>_<six characters>, the same for the same seed."""
    return F.concat(F.lit(prefix + "_"), F.lower(F.conv(millis.cast("string"), 10, 36)), F.lit("_"), F.upper(F.substring(F.sha2(seed, 256), 1, 6)))


def may_read(public: Column, members: Column, caller: Column) -> Column:
    return F.coalesce(public, F.lit(False)) | F.coalesce(F.array_contains(members, caller), F.lit(False))


def where_given(rows: DataFrame, field: str, value: object | None) -> DataFrame:
    """Rows whose array ``field`` holds the value; all rows where no value is given."""
    return rows if value is None else rows.where(F.array_contains(field, value))
