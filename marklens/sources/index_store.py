"""One stored vector index for batch and stream.

A folder holds the coarse centroids, segments of vectors by list, tables of vanished paths,
and commits. Every change is a generation: its files are written first, then one commit
row that names it. A reader takes the commits there are, from the last base on, so it sees
whole generations only; what a lost attempt has left behind is written over by the next
one. There is one writer at a time. Ids follow those in use and are never given again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marklens.functions.text import normal_path
from marklens.operators.knn import probe_count
from marklens.plans.index import VectorIndex, fresh_vectors

_COMMIT = "generation long, kind string, next_id long, nlist int, nprobe int, metric string"
_ROW = "index_id long, path string, filename string, embedding array<double>, generation long, centroid_id int"
_COLUMNS = ["index_id", "path", "filename", "embedding"]


def _commits(spark: SparkSession, path: str) -> list:
    """Commit rows from the last base on, oldest first; few, as compaction starts anew."""
    try:
        rows = spark.read.schema(_COMMIT).json(f"{path}/commits/*").collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    rows.sort(key=lambda r: r["generation"])
    bases = [i for i, r in enumerate(rows) if r["kind"] == "base"]
    return rows[bases[-1] :] if bases else []


def index_exists(spark: SparkSession, path: str) -> bool:
    return bool(_commits(spark, path))


def _commit(spark: SparkSession, path: str, generation: int, kind: str, next_id: int, nlist: int) -> None:
    row = (generation, kind, next_id, nlist, probe_count(nlist) if nlist else 0, "ip")
    spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("overwrite").json(f"{path}/commits/{generation:012d}")


def _write_segment(vectors: DataFrame, path: str, generation: int) -> None:
    if "centroid_id" not in vectors.columns:
        vectors = vectors.withColumn("centroid_id", F.lit(-1))
    # a list lies in few files, and one that holds much of the index in several
    files = vectors.select(*_COLUMNS, "centroid_id").repartition("centroid_id", F.pmod(F.xxhash64("index_id"), F.lit(8)))
    files.write.mode("overwrite").partitionBy("centroid_id").parquet(f"{path}/segments/generation={generation}")


def save_index(index: VectorIndex, path: str, mode: str = "errorifexists") -> None:
    """Write ``index`` as the base of a stored one; ``overwrite`` puts it over what is there."""
    spark = index.vectors.sparkSession
    before = _commits(spark, path)
    if before and mode != "overwrite":
        raise ValueError(f"there is an index at {path}")
    generation = before[-1]["generation"] + 1 if before else 0
    lists = 0
    if index.centroids is not None:
        lists = index.centroids.count()
        index.centroids.write.mode("overwrite").parquet(f"{path}/centroids/generation={generation}")
    _write_segment(index.vectors, path, generation)
    top = index.vectors.agg(F.coalesce(F.max("index_id"), F.lit(-1))).first()[0] + 1
    _commit(spark, path, generation, "base", max(top, before[-1]["next_id"] if before else 0), lists)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """All rows that are not gone. The list is a partition column, so a filter on it prunes files."""
    commits = _commits(spark, path)
    if not commits:
        raise AnalysisException(f"no index at {path}")
    of = lambda *kinds: [c["generation"] for c in commits if c["kind"] in kinds]
    reader = spark.read.schema(_ROW).option("basePath", f"{path}/segments")
    vectors = reader.parquet(*[f"{path}/segments/generation={g}" for g in of("base", "add")])
    if of("gone"):
        gone = spark.read.schema("path string, generation long").option("basePath", f"{path}/gone")
        gone = gone.parquet(*[f"{path}/gone/generation={g}" for g in of("gone")])
        last = gone.groupBy("path").agg(F.max("generation").alias("_gone"))
        vectors = vectors.join(last, "path", "left").where("_gone IS NULL OR _gone < generation").drop("_gone")
    base = commits[0]
    if not base["nlist"]:
        return VectorIndex(vectors.select(*_COLUMNS), None)
    centroids = spark.read.parquet(f"{path}/centroids/generation={base['generation']}")
    return VectorIndex(vectors.select(*_COLUMNS, "centroid_id"), centroids)


def append_vectors(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add the ``path, embedding`` rows whose path is not indexed; they get the next ids.

    Rows seen before add nothing, so a repeated batch leaves the index as it is. Without
    an index there they start one without lists.
    """
    commits = _commits(spark, path)
    if commits:
        index, last = load_index(spark, path), commits[-1]
    else:
        nothing = spark.createDataFrame([], "index_id long, path string, filename string, embedding array<double>")
        index, last = VectorIndex(nothing, None), None
    start = last["next_id"] if last else 0
    generation = last["generation"] + 1 if last else 0
    _write_segment(fresh_vectors(index, rows, start), path, generation)
    written = spark.read.schema(_ROW).option("basePath", f"{path}/segments").parquet(f"{path}/segments/generation={generation}")
    top = written.agg(F.max("index_id")).first()[0]
    if top is not None:
        _commit(spark, path, generation, "add" if last else "base", top + 1, commits[0]["nlist"] if commits else 0)


def remove_gone(spark: SparkSession, path: str, listed: DataFrame) -> None:
    """Take the paths that are no longer listed out of the index (their rows stay until ``compact``)."""
    commits = _commits(spark, path)
    index = load_index(spark, path)
    still = listed.select(normal_path(F.col("path")).alias("path"))
    gone = index.vectors.select("path").join(still, "path", "left_anti")
    last = commits[-1]
    gone.write.mode("overwrite").parquet(f"{path}/gone/generation={last['generation'] + 1}")
    _commit(spark, path, last["generation"] + 1, "gone", last["next_id"], commits[0]["nlist"])


def compact(spark: SparkSession, path: str) -> None:
    """One new base of all rows there are: few files a list, no vanished paths."""
    save_index(load_index(spark, path), path, mode="overwrite")
