"""Nearest-neighbour and threshold joins over vectors.

A query side that is proven small is broadcast, so the base is read once and not
shuffled. Beyond that the base is partitioned by pivots, and a query goes only to the
partitions whose distance bound may beat what it has (see ``pivots``). A task holds one
block of queries and one of base rows, multiplies them with numpy and hands on only the
best ``k`` rows per query (or the rows over a threshold); the partial answers meet in
a top-k. Answers are exact, and no id or cluster can make a task larger than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.functions.vector import doubles, l2_norm, normalised
from marklens.operators.blocks import HITS, SCORES, Deal, best_hits, block_size, hits_of_visits, matrix
from marklens.operators.grouping import top_k
from marklens.operators.pivots import pivot_hits
from marklens.session import cut_lineage, fits, spread

BLOCK_ROWS = 1 << 15
BROADCAST_CELLS = 4_000_000  # at most 32 MB of doubles
#: Broadcast queries whose hits a task holds at once, about.
QUERY_ROWS = 4096
#: Digits of a score in results.
SCORE_DIGITS = 6
# Least lists and default probes of the inverted-file index.
MIN_LISTS, MOST_PROBES = 10, 32
#: Queries on which the number of probes is fitted, and the recall they must reach (0.9 with a margin).
FIT_QUERIES, FIT_RECALL = 400, 0.95

def clamp_k(k: int, rows: int, cap: int | None = None) -> int:
    """Search depth: ``k`` within the index size and, if one is asked for, the cap."""
    depth = min(k, rows)
    return depth if cap is None else min(depth, cap)


def unit_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Doubles of unit length; rows without a vector or of zero length drop out."""
    return (
        df.filter(F.col(vector).isNotNull())
        .withColumn(vector, doubles(F.col(vector)))
        .withColumn("_norm", l2_norm(F.col(vector)))
        .filter(F.col("_norm") > 0)
        .withColumn(vector, normalised(F.col(vector), F.col("_norm")))
        .drop("_norm")
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _prepared(df: DataFrame, id_col: str, vector: str, id_name: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).cast("long").alias(id_name), doubles(F.col(vector)).alias("vec")
    )


def _hits_by_parts(q_ids, q_vecs, b_ids, b_vecs, *options):
    """``best_hits`` for some queries after others, so that a task never holds the hits of all."""
    step = max(1, SCORES // len(b_ids))
    step *= max(1, QUERY_ROWS // step)
    for at in range(0, len(q_ids), step):
        yield best_hits(q_ids[at : at + step], q_vecs[at : at + step], b_ids, b_vecs, *options)


def _hits_broadcast(queries, base, k, metric, min_score, skip_self) -> DataFrame:
    rows = queries.toPandas()
    shared = base.sparkSession.sparkContext.broadcast(
        (rows["query_id"].to_numpy(), _matrix(rows["vec"]))
    )

    def scan(batches):
        q_ids, q_vecs = shared.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column("base_id").to_numpy(), matrix(batch.column("vec"))
                for found in _hits_by_parts(q_ids, q_vecs, *own, k, metric, min_score, skip_self):
                    yield from found.to_batches()

    return base.mapInArrow(scan, HITS)


def hits_of_cells(queries, base, k, metric, min_score, skip_self) -> DataFrame:
    """Both sides carry ``cell`` columns; rows of equal cells meet."""
    cells = [c for c in queries.columns if c.startswith("cell")]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q_vecs = left.column("query_id").to_numpy(), matrix(left.column("vec"))
        b_ids, b_vecs = right.column("base_id").to_numpy(), matrix(right.column("vec"))
        if not len(q_ids) or not len(b_ids):
            q_ids, q_vecs, b_ids, b_vecs = q_ids[:0], q_vecs[:0], b_ids[:0], b_vecs[:0]
        return best_hits(q_ids, q_vecs, b_ids, b_vecs, k, metric, min_score, skip_self)

    return queries.groupBy(*cells).cogroup(base.groupBy(*cells)).applyInArrow(meet, HITS)


def vector_join(
    queries: DataFrame,
    base: DataFrame,
    k: int | None = None,
    metric: str = "ip",
    min_score: float | None = None,
    query_id: str = "query_id",
    base_id: str = "base_id",
    vector: str = "embedding",
    skip_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    broadcast_cells: int = BROADCAST_CELLS,
    copies: list | None = None,
) -> DataFrame:
    """Exact top-k and/or threshold join: ``query_id, base_id, score[, rank]``.

    ``metric`` is ``ip`` (inner product, larger is better) or ``l2`` (squared
    distance, smaller is better; ``min_score`` then is the largest distance). A query side
    of more than ``broadcast_cells`` numbers goes through pivot partitions; ``copies``
    then receives the number of partitions visited, summed over the queries, per round.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    if k is None and min_score is None:
        raise ValueError("give k, min_score or both")
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    floor = min_score if metric == "ip" or min_score is None else -min_score
    q = _prepared(queries, query_id, vector, "query_id")
    b = _prepared(base, base_id, vector, "base_id")
    head = q.select(F.size("vec").alias("n")).first()
    if head is None:
        hits = q.sparkSession.createDataFrame([], HITS)
    elif fits(q, broadcast_cells // max(head["n"], 1)):
        small = fits(b, broadcast_cells // max(head["n"], 1))  # a few files are few tasks
        hits = _hits_broadcast(q, spread(b, "base_id") if small else b, k, metric, floor, skip_self)
    else:
        # several rounds read both sides
        q, b = cut_lineage(spread(q, "query_id")), cut_lineage(spread(b, "base_id"))
        hits = pivot_hits(q, b, k, metric, floor, skip_self, block_rows, copies=copies)
    return _ranked(hits, k, metric)


def _ranked(hits: DataFrame, k: int | None, metric: str) -> DataFrame:
    if k is not None:
        hits = top_k(hits, ["query_id"], [F.desc("score"), F.asc("base_id")], k)
    score = F.col("score") if metric == "ip" else F.abs(F.col("score"))
    return hits.withColumn("score", F.round(score, SCORE_DIGITS))


def knn_join(queries, base, k: int, metric: str = "ip", **options) -> DataFrame:
    """The ``k`` nearest base rows of every query row, ranked."""
    return vector_join(queries, base, k=k, metric=metric, **options)


def list_count(rows: int) -> int:
    """Number of inverted lists for an index of ``rows`` vectors."""
    return max(1, min(max(MIN_LISTS, math.isqrt(rows)), rows // 4))


def probe_count(lists: int, most: int = MOST_PROBES) -> int:
    """Lists a query visits by rule, where none are fitted."""
    return min(max(1, lists // 4), most)


def train_centroids(
    base: DataFrame, lists: int, vector: str = "embedding", seed: int = 42
) -> DataFrame:
    """Coarse centroids ``(centroid_id, centroid)``; at most ``lists`` rows."""
    if lists < 1:
        raise ValueError("lists must be positive")
    features = unit_vectors(base, vector).select(array_to_vector(F.col(vector)).alias("features"))
    if lists == 1:
        schema = "centroid_id int, centroid array<double>"
        size = base.select(F.size(vector).alias("n")).first()["n"]
        return base.sparkSession.createDataFrame([(0, [0.0] * size)], schema)
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=20).fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return base.sparkSession.createDataFrame(rows, "centroid_id int, centroid array<double>")


def nearest_lists(
    df: DataFrame, centroids: DataFrame, probes: int, vector: str, row_id: str = "index_id"
) -> DataFrame:
    """Add ``centroid_id``, one row per list among the ``probes`` best of the row.

    Centroids over 32 MB are not broadcast but joined in blocks, by ``row_id``.
    """
    width = centroids.select(F.size("centroid")).first()[0]
    if not fits(centroids, BROADCAST_CELLS // max(width, 1)):
        lists = centroids.select("centroid_id", F.col("centroid").alias(vector))
        hits = knn_join(df, lists, probes, query_id=row_id, base_id="centroid_id", vector=vector)
        own = hits.select(F.col("query_id").alias(row_id), F.col("base_id").cast("int").alias("centroid_id"))
        return df.join(own, row_id)
    table = centroids.toPandas().sort_values("centroid_id")
    shared = df.sparkSession.sparkContext.broadcast(
        (table["centroid_id"].to_numpy(), _matrix(table["centroid"]))
    )
    probes = min(probes, len(table))

    @F.pandas_udf("array<int>")
    def pick(vectors: pd.Series) -> pd.Series:
        ids, matrix = shared.value
        if not len(vectors):
            return pd.Series([], dtype=object)
        scores = _matrix(vectors) @ matrix.T
        best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
        return pd.Series(list(ids[best].astype(np.int32)))

    return df.withColumn("centroid_id", F.explode(pick(doubles(F.col(vector)))))


def fitted_probes(q: DataFrame, b: DataFrame, centroids: DataFrame, k: int, skip_self: bool) -> int:
    """Lists a query must visit so that a sample of the queries keeps FIT_RECALL of its neighbours.

    ``q`` has ``query_id, vec`` and ``b`` has ``base_id, vec, cell``. The sample is compared
    with the whole base once; a neighbour counts from the place of its list among all lists.
    """
    lists = centroids.toPandas().sort_values("centroid_id", ignore_index=True)
    sample = q.orderBy(F.xxhash64("query_id"), "query_id").limit(FIT_QUERIES).toPandas()
    if not len(sample):
        return probe_count(len(lists))
    picked = q.sparkSession.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(sample["query_id"], sample["vec"])],
        "query_id long, vec array<double>",
    )
    near = knn_join(picked, b, k, vector="vec", skip_self=skip_self).select("query_id", "base_id")
    wanted = near.join(b.select("base_id", "cell"), "base_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
    cells = {r["query_id"]: r["cells"] for r in wanted.collect()}
    matrix, at = _matrix(lists["centroid"]), {c: i for i, c in enumerate(lists["centroid_id"])}
    places = []
    for query, vec in zip(sample["query_id"], sample["vec"]):
        order = np.argsort(-(matrix @ np.asarray(vec, np.float64)), kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(1, len(order) + 1)
        places.extend(place[at[c]] for c in cells.get(query, []))
    if not places:
        return probe_count(len(lists))
    return int(np.quantile(places, FIT_RECALL, method="higher"))


def _hits_of_lists(q: DataFrame, b: DataFrame, centroids: DataFrame, probes: int, k: int, skip_self: bool, block_rows: int) -> DataFrame:
    """Hits in the ``probes`` best lists of each query, lists dealt by blocks."""
    table = centroids.toPandas().sort_values("centroid_id", ignore_index=True)  # size checked
    sizes = {r["cell"]: r["count"] for r in b.groupBy("cell").count().collect()}  # one row per list
    number = {int(c): i for i, c in enumerate(table["centroid_id"])}
    rows = np.array([sizes.get(c, 0) for c in number], np.int64)
    if not rows.sum():
        return q.sparkSession.createDataFrame([], HITS)
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = Deal(rows, block_size(int(rows.sum()), block_rows, tasks))
    shared = q.sparkSession.sparkContext.broadcast(_matrix(table["centroid"]))
    probes = min(probes, len(table))

    def want(batch) -> np.ndarray:
        scores = matrix(batch.column("vec")) @ shared.value.T
        wanted = np.zeros(scores.shape, bool)
        np.put_along_axis(wanted, np.argsort(-scores, axis=1, kind="stable")[:, :probes], True, 1)
        return wanted & (rows > 0)

    named = q.sparkSession.createDataFrame(list(number.items()), "cell int, _number int")
    numbered = b.join(F.broadcast(named), "cell").select("base_id", "vec", F.col("_number").alias("cell"))
    return hits_of_visits(q, numbered, deal, want, k, "ip", None, skip_self)


def ivf_knn_join(
    queries: DataFrame,
    index: DataFrame,
    centroids: DataFrame,
    k: int,
    probes: int | None = None,
    query_id: str = "query_id",
    base_id: str = "index_id",
    vector: str = "embedding",
    skip_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k by inner product inside the best lists of each query.

    ``index`` carries ``centroid_id``. A list longer than a block is split in
    salted parts which every query of that list visits, so a list that holds a
    third of the index is searched by many tasks. Without ``probes`` their number is
    fitted on a sample of the queries, so it grows with the lists as recall needs it.
    """
    lists = centroids.count()
    q = _prepared(queries, query_id, vector, "query_id")
    b = index.filter(F.col(vector).isNotNull()).select(
        F.col(base_id).cast("long").alias("base_id"),
        doubles(F.col(vector)).alias("vec"),
        F.col("centroid_id").alias("cell"),
    )
    q, b = cut_lineage(spread(q, "query_id")), cut_lineage(spread(b, "base_id"))
    probes = fitted_probes(q, b, centroids, k, skip_self) if probes is None else probes
    width = centroids.select(F.size("centroid")).first()[0]
    if fits(centroids, BROADCAST_CELLS // max(width, 1)):
        return _ranked(_hits_of_lists(q, b, centroids, probes, k, skip_self, block_rows), k, "ip")
    q = nearest_lists(q, centroids, probes, "vec", "query_id").withColumnRenamed("centroid_id", "cell")

    def parts(df: DataFrame, name: str) -> DataFrame:
        # one row per list
        return df.groupBy("cell").agg(
            F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(block_rows))).alias(name)
        )

    sizes = parts(b, "_nb").join(parts(q, "_nq"), "cell")
    if lists <= BROADCAST_CELLS // 3:
        sizes = F.broadcast(sizes)

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str, id_name: str):
        return (
            df.join(sizes, "cell")
            .withColumn(own, F.pmod(F.xxhash64(id_name), F.col(own_n)))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)))
            .drop("_nb", "_nq")
        )

    q = dealt(q, "cell_q", "_nq", "cell_b", "_nb", "query_id")
    b = dealt(b, "cell_b", "_nb", "cell_q", "_nq", "base_id")
    hits = hits_of_cells(q, b, k, "ip", None, skip_self)
    return _ranked(hits, k, "ip")
