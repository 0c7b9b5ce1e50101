"""Feature cache: rows keyed by the signature of the file they came from.

Every change is a version: its rows are written first, then a commit row that names it. A
reader takes the versions of one moment, so it never sees half a change.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marklens.operators.dedup import file_signature

SIGNATURE = ("path", "modificationTime", "length")
_COMMIT = "version long, kind string"


def with_signature(files: DataFrame, columns: Sequence[str] = SIGNATURE) -> DataFrame:
    return files.withColumn("signature", file_signature(*columns))


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    return files.join(cached.select("signature").distinct(), "signature", "left_anti")


def _commits(spark: SparkSession, cache_path: str) -> list:
    """Commit rows, oldest first: one per change of the cache."""
    try:
        rows = spark.read.schema(_COMMIT).json(f"{cache_path}/commits/*").collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    return sorted(rows, key=lambda r: r["version"])


def _commit(spark: SparkSession, cache_path: str, version: int, kind: str) -> None:
    row = spark.createDataFrame([(version, kind)], _COMMIT)
    row.coalesce(1).write.mode("overwrite").json(f"{cache_path}/commits/{version:012d}")


def _folder(cache_path: str, version: int) -> str:
    return f"{cache_path}/features/{version:012d}"


def _live(commits: list, version: int | None = None) -> list[int]:
    """Versions whose rows make up the cache as of ``version`` (the last one by default)."""
    seen = [c for c in commits if version is None or c["version"] <= version]
    starts = [i for i, c in enumerate(seen) if c["kind"] != "add"]
    return [c["version"] for c in seen[starts[-1] if starts else 0 :] if c["kind"] != "clear"]


def cache_version(spark: SparkSession, cache_path: str) -> int | None:
    """Number of the last change, None without a cache."""
    commits = _commits(spark, cache_path)
    return commits[-1]["version"] if commits else None


def read_cache(spark: SparkSession, cache_path: str, version: int | None = None) -> DataFrame:
    """The cached rows as of ``version``; later changes do not show in them.

    A cleared cache has no rows but still its columns.
    """
    commits = _commits(spark, cache_path)
    live = _live(commits, version)
    if live:
        return spark.read.parquet(*[_folder(cache_path, v) for v in live])
    written = [c["version"] for c in commits if c["kind"] != "clear"]
    if not written:
        raise ValueError(f"no cache at {cache_path}")
    return spark.read.parquet(_folder(cache_path, written[-1])).where(F.lit(False))


def with_feature_cache(
    files: DataFrame,
    cache_path: str,
    compute: Callable[[DataFrame], DataFrame],
    columns: Sequence[str] = SIGNATURE,
) -> DataFrame:
    """Features of ``files``: cached rows are read, the others computed and kept.

    ``compute`` turns files (with ``signature``) into rows that keep ``signature``. The
    cache is read as of now and new rows go to a version of their own, so hits are neither
    written again nor changed by it. A job that fails leaves no version. One writer at a
    time.
    """
    spark = files.sparkSession
    keyed = with_signature(files, columns)
    commits = _commits(spark, cache_path)
    live = _live(commits)
    cached = read_cache(spark, cache_path) if live else None
    version = commits[-1]["version"] + 1 if commits else 0
    missing = keyed if cached is None else misses(keyed, cached)
    folder = _folder(cache_path, version)
    compute(missing).write.mode("overwrite").parquet(folder)
    fresh = spark.read.parquet(folder)
    if cached is None:
        _commit(spark, cache_path, version, "add")
        return fresh
    hits = cached.join(keyed.select("signature").distinct(), "signature", "left_semi")
    if fresh.isEmpty():
        return hits
    _commit(spark, cache_path, version, "add")
    return hits.unionByName(fresh.select(*hits.columns))


def compact_cache(spark: SparkSession, cache_path: str) -> None:
    """Write the rows there are as one version that starts anew."""
    rows, version = read_cache(spark, cache_path), cache_version(spark, cache_path) + 1
    rows.write.mode("overwrite").parquet(_folder(cache_path, version))
    _commit(spark, cache_path, version, "base")


def cache_stats(spark: SparkSession, cache_path: str) -> DataFrame:
    """Number and bytes of the data files that make up the cache."""
    live = [_folder(cache_path, v) for v in _live(_commits(spark, cache_path))]
    if not live:
        return spark.createDataFrame([(0, 0)], "files long, bytes long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(live)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def clear_cache(spark: SparkSession, cache_path: str) -> None:
    """Start anew without rows; readers of an earlier version keep theirs."""
    version = cache_version(spark, cache_path)
    if version is None:
        raise ValueError(f"no cache at {cache_path}")
    _commit(spark, cache_path, version + 1, "clear")
