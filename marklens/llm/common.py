"""Shared helpers: intermediate tables, Arrow column access, word hashes."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.session import ensure_checkpoint_dir

#: Words are maximal runs of characters other than space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handled together inside a task.
CHUNK = 512
CACHE_WORDS = 400_000
#: Setting under which Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    A lost executor then costs a re-read, and an expensive pass runs once even
    when several later steps use it. Its shuffle files go when it is written: they would
    stay until the driver's garbage collection, and add up over the steps of a job.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one step never holds more than ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash per word, remembered for the frequent words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _factors(width: int) -> np.ndarray:
    return np.random.default_rng(width).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for i, factor in enumerate(_factors(width)):
        total += words[i : i + n] * factor
    return mixed(total)


def row_key(*columns: str):
    """64-bit key of a row by these columns; null differs from every value."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def n_words(column: str = "text"):
    """Native word count of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def packed(records: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Group numbers that occur, and the bytes of each group's records in their order."""
    order = np.argsort(groups, kind="stable")
    which, start = np.unique(groups[order], return_index=True)
    end = np.append(start[1:], len(records))
    return which, [records[order[a:b]].tobytes() for a, b in zip(start, end, strict=False)]
