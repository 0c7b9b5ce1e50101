"""Vector queries: neighbour joins, index upkeep, consensus, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import table, view, with_views
from catalog.sqlparts import knn_ctes
from marklens.operators import knn as K
from marklens.operators.consensus import consensus_score
from marklens.plans import index as I
from marklens.plans.projection import project_vectors
from marklens.session import cut_lineage

K_NEAREST = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.unit_vectors(view(spark, sf_dir, "vectors"))


def neighbours(vectors: DataFrame, k: int = K_NEAREST, metric: str = "ip", **options) -> DataFrame:
    """Every image's nearest other images as ``ref_id, cmp_id, score, rank``."""
    hits = K.knn_join(
        vectors, vectors, k, metric, query_id="image_id", base_id="image_id", skip_self=True, **options
    )
    return hits.select(
        F.col("query_id").alias("ref_id"),
        F.col("base_id").alias("cmp_id"),
        "score",
        F.col("rank").cast("long").alias("rank"),
    )


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_vectors(spark, sf_dir))


_UNIT = """u AS (SELECT image_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM vectors),
unit AS (SELECT image_id, list_transform(e, lambda x: x / nrm) AS embedding FROM u WHERE nrm > 0)"""
_KNN_SQL = f"""{with_views("vectors")}, {_UNIT}, {knn_ctes("unit", K_NEAREST)}
SELECT ref_id, cmp_id, score, rank FROM nn"""


def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_vectors(spark, sf_dir), metric="l2")


def knn_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``knn_exact`` through pivot partitions: nothing of the tables is broadcast."""
    return neighbours(_vectors(spark, sf_dir), broadcast_cells=0)


def knn_l2_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_vectors(spark, sf_dir), metric="l2", broadcast_cells=0)


_KNN_L2_SQL = f"""{with_views("vectors")}, {_UNIT}, {knn_ctes("unit", K_NEAREST, metric="l2")}
SELECT ref_id, cmp_id, score, rank FROM nn"""


def cosine_threshold(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Every pair of images with a cosine of at least 0.3."""
    vectors = _vectors(spark, sf_dir)
    return K.vector_join(
        vectors, vectors, min_score=0.3, query_id="image_id", base_id="image_id", skip_self=True, **options
    ).select(F.col("query_id").alias("ref_id"), F.col("base_id").alias("cmp_id"), "score")


def cosine_threshold_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through pivot partitions."""
    return cosine_threshold(spark, sf_dir, broadcast_cells=0)


_COSINE_THRESHOLD_SQL = f"""{with_views("vectors")}, {_UNIT}, {knn_ctes("unit", 1)}
SELECT ref_id, cmp_id, round(s, 6) AS score FROM nn_s WHERE s >= 0.3"""


def _ivf(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    vectors = view(spark, sf_dir, "vectors")
    lists = K.list_count(vectors.count())
    index = I.build_vector_index(
        vectors.select(
            F.concat(F.lit("/logos/"), F.col("image_id").cast("string")).alias("path"),
            F.col("image_id").alias("index_id"),
            "embedding",
        ),
        lists=lists,
    )
    queries = K.unit_vectors(vectors)
    hits = K.ivf_knn_join(
        queries, index.vectors, index.centroids, K_NEAREST,
        probes=lists if full else None, query_id="image_id", skip_self=True,
    )
    return hits.select(
        F.col("query_id").alias("ref_id"),
        F.col("base_id").alias("cmp_id"),
        "score",
        F.col("rank").cast("long").alias("rank"),
    )


def ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists probed: must equal the exact join."""
    return _ivf(spark, sf_dir, True)


def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted probes; recall against the exact join is tested, SQL has no counterpart."""
    return _ivf(spark, sf_dir, False)


def candidate_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Image pairs whose variants are near each other, and the variants."""
    variants = view(spark, sf_dir, "variants")
    keyed = K.unit_vectors(variants).withColumn("key", F.col("image_id") * 5 + F.col("variant"))
    hits = K.knn_join(keyed, keyed, K_NEAREST, query_id="key", base_id="key", skip_self=True)
    pairs = (
        hits.select(
            F.floor(F.col("query_id") / 5).alias("ref_id"),
            F.floor(F.col("base_id") / 5).alias("cmp_id"),
        )
        .filter("ref_id <> cmp_id")
        .distinct()
    )
    return cut_lineage(pairs), variants


def _consensus(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    pairs, variants = candidate_images(spark, sf_dir)
    scored = consensus_score(pairs, variants, threshold=threshold)
    return scored.select(
        "ref_id",
        "cmp_id",
        *[F.round(c, 6).alias(c) for c in scored.columns if c not in ("ref_id", "cmp_id")],
    )


def consensus_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir, 0.6)


def consensus_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir, 0.2)


VARIANT_PAIRS = f"""vk AS (SELECT image_id * 5 + variant AS image_id, embedding FROM variants),
vu AS (SELECT image_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM vk),
vunit AS (SELECT image_id, list_transform(e, lambda x: x / nrm) AS embedding FROM vu WHERE nrm > 0),
{knn_ctes("vunit", K_NEAREST, "vn")},
vpairs AS (SELECT DISTINCT ref_id // 5 AS ref_id, cmp_id // 5 AS cmp_id FROM vn WHERE ref_id // 5 <> cmp_id // 5)"""


def _consensus_sql(threshold: float) -> str:
    return f"""{with_views("variants")}, {VARIANT_PAIRS},
c AS (SELECT p.ref_id, p.cmp_id, list_dot_product(a.embedding, b.embedding) AS cs
      FROM vpairs p JOIN vunit a ON a.image_id // 5 = p.ref_id JOIN vunit b ON b.image_id // 5 = p.cmp_id),
g AS (SELECT ref_id, cmp_id, median(cs) AS md, avg(cs) AS av, max(cs) AS mx,
             count(*) FILTER (cs > {threshold}) AS hi, count(*) AS n FROM c GROUP BY ref_id, cmp_id)
SELECT ref_id, cmp_id, round(md, 6) AS median_similarity, round(av, 6) AS mean_similarity,
       round(mx, 6) AS max_similarity, round(hi::DOUBLE / n, 6) AS consensus_ratio,
       round(CASE WHEN hi < 3 THEN md ELSE mx END, 6) AS vit_score FROM g"""


def _known_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("/logos/"), F.col("source"), F.lit("//"), F.col("doc_id").cast("string"), F.lit(".txt")
        ).alias("path"),
    )
    return files.filter(F.col("doc_id") % 3 == 0), files


def index_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not indexed yet get the next ids in path order."""
    known, files = _known_and_new(spark, sf_dir)
    indexed = I.assign_index_ids(known.select("path"), None)
    fresh = I.new_files(files, indexed)
    return I.assign_index_ids(fresh, indexed).select("doc_id", "path", "index_id")


_INDEX_NEW_FILES_SQL = """
WITH f AS (SELECT doc_id, concat('/logos/', source, '/', doc_id::VARCHAR, '.txt') AS path FROM documents),
k AS (SELECT * FROM f WHERE doc_id % 3 = 0),
n AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.path = f.path))
SELECT doc_id, path, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY path) - 1 AS index_id FROM n"""


def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of indexed, new and vanished paths."""
    known, files = _known_and_new(spark, sf_dir)
    listed = files.filter(F.col("doc_id") % 5 != 0)
    return I.path_sets(listed, known)


_PATH_SETS_SQL = """
WITH f AS (SELECT doc_id, concat('/logos/', source, '/', doc_id::VARCHAR, '.txt') AS path FROM documents),
k AS (SELECT path FROM f WHERE doc_id % 3 = 0), l AS (SELECT path FROM f WHERE doc_id % 5 <> 0)
SELECT 'indexed' AS path_set, count(*) AS paths FROM (SELECT path FROM l INTERSECT SELECT path FROM k)
UNION ALL SELECT 'new', count(*) FROM (SELECT path FROM l EXCEPT SELECT path FROM k)
UNION ALL SELECT 'gone', count(*) FROM (SELECT path FROM k EXCEPT SELECT path FROM l)"""


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = view(spark, sf_dir, "vectors")
    rows = vectors.select(
        F.concat(F.lit("/logos/"), (F.col("image_id") % 400).cast("string")).alias("path"),
        F.col("image_id").alias("index_id"),
        "embedding",
    )
    centroids = K.train_centroids(vectors, K.list_count(vectors.count()))
    return I.index_stats(I.VectorIndex(rows, centroids))


_INDEX_STATS_SQL = """
WITH s AS (SELECT count(*) AS n, max(len(embedding))::INT AS d, count(DISTINCT vec_id % 400) AS p FROM embeddings),
l AS (SELECT *, greatest(1, least(greatest(10, floor(sqrt(n))::BIGINT), n // 4)) AS nl FROM s)
SELECT n AS total_vectors, d AS dimension, 'IVF' AS index_type,
       n AS distinct_images, p AS distinct_paths,
       nl AS nlist, least(greatest(1, nl // 4), 32) AS nprobe FROM l"""


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three coordinates per vector; signs are arbitrary, so SQL has no counterpart."""
    return project_vectors(view(spark, sf_dir, "vectors"), 3)[0]


QUERIES = {
    "knn_exact": knn_exact,
    "knn_l2": knn_l2,
    "cosine_threshold": cosine_threshold,
    "knn_pivots": knn_pivots,
    "knn_l2_pivots": knn_l2_pivots,
    "cosine_threshold_pivots": cosine_threshold_pivots,
    "ivf_full_probe": ivf_full_probe,
    "ivf_knn": ivf_knn,
    "consensus_strong": consensus_strong,
    "consensus_weak": consensus_weak,
    "index_new_files": index_new_files,
    "path_sets": path_sets,
    "index_stats": index_stats,
    "pca_projection": pca_projection,
}
ORACLE = {
    "knn_exact": _KNN_SQL,
    "knn_l2": _KNN_L2_SQL,
    "cosine_threshold": _COSINE_THRESHOLD_SQL,
    "knn_pivots": _KNN_SQL,
    "knn_l2_pivots": _KNN_L2_SQL,
    "cosine_threshold_pivots": _COSINE_THRESHOLD_SQL,
    "ivf_full_probe": _KNN_SQL,
    "consensus_strong": _consensus_sql(0.6),
    "consensus_weak": _consensus_sql(0.2),
    "index_new_files": _INDEX_NEW_FILES_SQL,
    "path_sets": _PATH_SETS_SQL,
    "index_stats": _INDEX_STATS_SQL,
}
