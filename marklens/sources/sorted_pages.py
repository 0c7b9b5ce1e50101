"""Stored results in sort order, so that any page reads the ranges it lies in.

Rows are dealt to ranges of the sort key (ties by the pair, so equal scores are split too)
and written by range with their place there. The number of rows of each range is kept
beside them; a page follows from the sums of these, however deep it is.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklens.operators.reporting import PAGE_SIZE, order_by

_RANGE, _PLACE = "_page_range", "_page_place"


@dataclass(frozen=True)
class SortedPages:
    """``rows`` with range and place; ``ranges`` lists (range, rows before it, rows)."""

    rows: DataFrame
    ranges: list[tuple[int, int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def page_count(self, size: int = PAGE_SIZE) -> int:
        return -(-self.total // size)

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Rows of a page, numbered from 1, with their ``position`` (from 1) in the whole order.

        A page past the last one is empty.
        """
        if number < 1:
            raise ValueError("pages start at 1")
        first, end = (number - 1) * size, number * size
        place, position, wanted = F.col(_PLACE), F.lit(None).cast("long"), F.lit(False)
        touched = [r for r in self.ranges if r[1] < end and r[1] + r[2] > first]
        for which, before, _ in touched:
            here = F.col(_RANGE) == which
            wanted = wanted | here & (place >= first - before) & (place < end - before)
            position = F.when(here, place + (before + 1)).otherwise(position)
        rows = self.rows.where(F.col(_RANGE).isin([r[0] for r in touched])).where(wanted)
        return rows.withColumn("position", position).drop(_RANGE, _PLACE).orderBy("position")


def save_sorted(results: DataFrame, path: str, by: str = "final_similarity", descending: bool = True) -> None:
    """Write ``results`` sorted by a score (missing counts as 0), ties by the pair, to a new folder."""
    spark = results.sparkSession
    number = F.monotonically_increasing_id()  # range in the upper bits, place in the lower 33
    rows = order_by(results, by, descending).withColumn(_PLACE, number)
    rows = rows.withColumn(_RANGE, F.shiftright(_PLACE, 33).cast("int"))
    rows = rows.withColumn(_PLACE, F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1)))
    rows.write.partitionBy(_RANGE).parquet(f"{path}/rows")
    schema = T.StructType([f for f in rows.schema.fields if f.name != _RANGE])
    counts = _rows(spark, path, schema).groupBy(_RANGE).agg(F.count("*").alias("n"))
    counts.write.parquet(f"{path}/ranges")
    # written last: a folder without it holds no results yet
    spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.json(f"{path}/schema")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(_RANGE, T.IntegerType())])).parquet(f"{path}/rows")


def open_sorted(spark: SparkSession, path: str) -> SortedPages:
    """Stored results; one number per range (per task that wrote them) comes to the driver."""
    stored = spark.read.schema("schema string").json(f"{path}/schema").first()["schema"]
    counts = spark.read.schema(f"{_RANGE} int, n long").parquet(f"{path}/ranges").orderBy(_RANGE).collect()
    ranges, before = [], 0
    for which, n in counts:
        ranges.append((which, before, n))
        before += n
    return SortedPages(_rows(spark, path, T.StructType.fromJson(json.loads(stored))), ranges)
