"""Building, extending and describing the vector index.

An index row is ``index_id, path, filename, embedding`` (unit length) and, in an
index with lists, ``centroid_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marklens.functions.text import base_name, normal_path
from marklens.operators.grouping import first_per_group
from marklens.operators.knn import (
    ivf_knn_join,
    knn_join,
    nearest_lists,
    probe_count,
    train_centroids,
    unit_vectors,
)
from marklens.session import cut_lineage


@dataclass
class VectorIndex:
    vectors: DataFrame
    centroids: DataFrame | None


def new_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose normalised path is not indexed yet; ``path`` comes back normalised."""
    normal = files.withColumn("path", normal_path(F.col("path")))
    return normal.join(indexed.select(normal_path(F.col("path")).alias("path")), "path", "left_anti")


def path_sets(listed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Number of indexed, new and vanished paths, one row each."""
    a = listed.select(normal_path(F.col("path")).alias("path"))
    b = indexed.select(normal_path(F.col("path")).alias("path"))
    sets = {"indexed": a.intersect(b), "new": a.exceptAll(b), "gone": b.exceptAll(a)}
    parts = [
        df.agg(F.count("*").alias("paths")).select(F.lit(name).alias("path_set"), "paths")
        for name, df in sets.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def assign_index_ids(rows: DataFrame, indexed: DataFrame | None, first: int = 0) -> DataFrame:
    """Dense ids in path order after the largest id in use, or from ``first`` on.

    Rows are range-sorted by path and kept in the checkpoint folder; a row's id is
    the size of the ranges before its own plus its place there. Only the range
    sizes, one number per partition, are ever brought together.
    """
    start = F.lit(first)
    if indexed is not None:
        start = F.lit(indexed.agg(F.coalesce(F.max("index_id"), F.lit(-1))).first()[0] + 1)
    ordered = cut_lineage(rows.orderBy("path"))
    place = F.monotonically_increasing_id()
    placed = ordered.withColumn("_place", place).withColumns(
        {
            "_range": F.shiftright("_place", 33),
            "_within": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn("index_id", (start + F.col("_before") + F.col("_within")).cast("long"))
        .drop("_place", "_range", "_within", "_before")
    )


def build_vector_index(rows: DataFrame, lists: int | None = None) -> VectorIndex:
    """Index of ``path, embedding`` rows (``index_id`` is made unless it is there).

    Zero vectors are left out and a path is indexed once. With ``lists`` that
    many coarse centroids are trained (``knn.list_count`` gives a usual number).
    """
    unit = unit_vectors(rows).withColumn("path", normal_path(F.col("path")))
    vectors = first_per_group(unit, ["path"], [c for c in ("index_id", "embedding") if c in unit.columns])
    vectors = vectors.withColumn("filename", base_name(F.col("path")))
    if "index_id" not in vectors.columns:
        vectors = assign_index_ids(vectors, None)
    return with_lists(vectors, lists)


def with_lists(vectors: DataFrame, lists: int | None = None) -> VectorIndex:
    """Assign rows to trained centroids; without ``lists`` the index is flat."""
    if lists is None:
        return VectorIndex(vectors, None)
    flat = vectors.drop("centroid_id")
    centroids = train_centroids(flat, lists)
    return VectorIndex(nearest_lists(flat, centroids, 1, "embedding"), centroids)


def fresh_vectors(index: VectorIndex, rows: DataFrame, first: int | None = None) -> DataFrame:
    """The rows whose path is new, with ids (after those in use, or from ``first``) and lists."""
    unit = unit_vectors(new_files(rows, index.vectors))
    fresh = first_per_group(unit.select("path", "embedding"), ["path"], ["embedding"])
    fresh = fresh.withColumn("filename", base_name(F.col("path")))
    fresh = assign_index_ids(fresh, index.vectors) if first is None else assign_index_ids(fresh, None, first)
    if index.centroids is not None:
        fresh = nearest_lists(fresh, index.centroids, 1, "embedding")
    return fresh


def add_vectors(index: VectorIndex, rows: DataFrame) -> VectorIndex:
    """Index extended by the rows whose path is new; they go to the lists there are."""
    fresh = fresh_vectors(index, rows)
    columns = ["index_id", "path", "filename", "embedding"]
    if index.centroids is not None:
        columns.append("centroid_id")
    merged = index.vectors.select(*columns).unionByName(fresh.select(*columns))
    return VectorIndex(merged, index.centroids)


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, index_id, path, filename, score, rank`` of the best rows of every query.

    ``queries`` is ``query_id, embedding``. With lists, those that any query probes are
    named to the scan: of a stored index only their folders are read.
    """
    q = unit_vectors(queries)
    if index.centroids is None:
        rows = index.vectors
        hits = knn_join(q, rows, k, query_id="query_id", base_id="index_id")
    else:
        rows = index.vectors
        if probes is not None:
            probed = nearest_lists(q, index.centroids, probes, "embedding", "query_id").select("centroid_id").distinct()
            rows = rows.where(F.col("centroid_id").isin([r[0] for r in probed.collect()]))  # at most the lists
        hits = ivf_knn_join(q, rows, index.centroids, k, probes)
    named = rows.select("index_id", "path", "filename")
    return hits.withColumnRenamed("base_id", "index_id").join(named, "index_id").select(
        "query_id", "index_id", "path", "filename", "score", F.col("rank").cast("long").alias("rank")
    )


def index_stats(index: VectorIndex, probes: int | None = None) -> DataFrame:
    """One row: vectors, dimension, type, distinct images and paths, lists and probes."""
    lists = None if index.centroids is None else index.centroids.count()
    if lists is not None and probes is None:
        probes = probe_count(lists)
    return index.vectors.agg(
        F.count("*").alias("total_vectors"),
        F.max(F.size("embedding")).alias("dimension"),
        F.count_distinct("index_id").alias("distinct_images"),
        F.count_distinct("path").alias("distinct_paths"),
    ).withColumns(
        {
            "index_type": F.lit("Flat" if lists is None else "IVF"),
            "nlist": F.lit(lists).cast("long"),
            "nprobe": F.lit(None if lists is None else probes).cast("long"),
        }
    )
