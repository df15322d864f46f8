"""Pages of a sorted table by an order-statistics index: a page reads the one or two parts it lies in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a part, about, and parts that a table has at most before they grow to that size.
PART, PARTS = 1_000_000, 64


@dataclass(frozen=True)
class PageIndex:
    """A table in parts by ranges of its key, and how many rows each part has."""

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    schema: StructType

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: Sequence[str], part: int = PART) -> PageIndex:
        """Sorts ``rows`` by ``key`` once. A key that tells all rows apart makes pages that never overlap; a null comes first.

        Parts smaller than PART have ``part`` rows while they are PARTS at most; then they grow before
        they multiply, as each is a task and a folder.
        """
        n = rows.count()
        parts = max(1, min(-(-n // part), max(PARTS, -(-n // PART))))
        ranged = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("__part", F.spark_partition_id())
        ranged.write.partitionBy("__part").parquet(f"{folder}/rows")
        written = rows.sparkSession.read.schema(ranged.schema).parquet(f"{folder}/rows")
        written.groupBy("__part").agg(F.count("*").alias("rows")).coalesce(1).write.parquet(f"{folder}/counts")
        return cls(rows.sparkSession, folder, tuple(key), ranged.schema)

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of one page in order; pages count from 1, one past the end is empty."""
        if number < 1 or size < 1:
            raise ValueError("page and size must be 1 or more")
        start, before, chosen, skipped = (number - 1) * size, 0, [], 0
        for r in self.spark.read.schema("__part int, rows bigint").parquet(f"{self.folder}/counts").orderBy("__part").collect():  # one row a part
            if before + r["rows"] <= start:
                skipped = before + r["rows"]
            elif before < start + size:
                chosen.append(r["__part"])
            before += r["rows"]
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")
        return rows.where(F.col("__part").isin(chosen)).drop("__part").orderBy(*self.key).offset(start - skipped).limit(size)
