"""Trademark table: append records, read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.plans.journal import COLUMNS, KINDS


def write_trademarks(records: DataFrame, path: str, kind: str) -> None:
    """Append records to the table, partitioned by ``db_type``."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}: {kind}")
    rows = records.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])
    rows.withColumn("db_type", F.lit(kind)).write.mode("append").partitionBy("db_type").parquet(path)


def read_trademarks(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in (*COLUMNS, "db_type"))
    return spark.read.schema(schema).parquet(path)
