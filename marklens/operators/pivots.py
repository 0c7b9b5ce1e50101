"""Exact neighbour and threshold joins over pivot partitions.

Every base row belongs to its nearest pivot and, by its distance from it, to a ring. By
the triangle inequality a query at distance d from the pivot is at least ``lo - d`` and
``d - hi`` away from all rows of a ring that spans ``lo`` to ``hi``. A top-k query first
visits the nearest rings that hold k rows; the k-th distance found there is a bound, and
in a second round only rings that may beat it are visited. A threshold is such a bound
from the start. Rings travel in blocks (see ``blocks``), near pivots side by side: queries
are copied once per block visited, blocks once per part of their visitors. A threshold
join copies neither: blocks of queries and of rows are one row each, written once, and a
task reads the two that meet, so its disk does not grow with the pairs of blocks.

Inner products become distances in one more dimension: a base row gets the coordinate
``sqrt(m^2 - |b|^2)`` (m: the largest norm), a query 0, and the larger the product, the
nearer the two are.

Pivots, and the rings of a pivot, are bounded in number, so what is broadcast is too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.functions.vector import l2_norm
from marklens.operators.blocks import HITS, SCORES, Deal, best_hits, block_size, hits_of_visits, matrix, visits
from marklens.operators.grouping import top_k
from marklens.session import cut_lineage

#: Most pivots, and most rings of one pivot. They bound every broadcast of this module.
PIVOTS, RINGS = 2048, 32
#: Rows of a ring, about, at most.
RING_ROWS = 4096
#: Most numbers of a block that is one row (8 MB), and queries of one multiplied at once.
NUMBERS, STEP = 1 << 20, 256
#: Bounds are kept a little loose, so that rounding excludes no row.
SLACK = 1e-6


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


@dataclass
class Partitions:
    """Pivots and rings; ``lift`` is m for inner products and None for distances."""

    pivots: np.ndarray
    lift: float | None
    pivot: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def distances(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Distance of each vector from each pivot."""
        return _distances(vectors, self.pivots, self.lift, query)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Least distance of each query from the rows of each ring."""
        d = self.distances(vectors, True)[:, self.pivot]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0.0)

    def bounds_of(self, vectors: np.ndarray, first: int, end: int) -> np.ndarray:
        """The same for the rings from ``first`` to before ``end``."""
        d = _distances(vectors, self.pivots[self.pivot[first:end]], self.lift, True)
        return np.maximum(np.maximum(d - self.high[first:end], self.low[first:end] - d), 0.0)


def _distances(vectors: np.ndarray, pivots: np.ndarray, lift: float | None, query: bool) -> np.ndarray:
    squares = (vectors * vectors).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * vectors @ pivots.T
    if lift is not None:
        rise = np.sqrt(np.maximum(lift * lift - (pivots * pivots).sum(1), 0))[None, :]
        own = 0.0 if query else np.sqrt(np.maximum(lift * lift - (vectors * vectors).sum(1), 0))[:, None]
        squares = squares + (rise - own) ** 2
    return np.sqrt(np.maximum(squares, 0.0))


def _nearest_of(vectors: np.ndarray, pivots: np.ndarray, lift: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector and its distance, for as many vectors at once as SCORES allows."""
    at, dist = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, SCORES // len(pivots))
    for start in range(0, len(vectors), step):
        found = _distances(vectors[start : start + step], pivots, lift, False)
        own = found.argmin(1)
        at[start : start + step], dist[start : start + step] = own, found[np.arange(len(own)), own]
    return at, dist


def _nearest_pivot(base: DataFrame, pivots: np.ndarray, lift: float | None) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("pivot int, dist double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"pivot": np.zeros(0, np.int32), "dist": np.zeros(0)})
        at, dist = _nearest_of(_matrix(vectors), shared.value, lift)
        return pd.DataFrame({"pivot": at.astype(np.int32), "dist": dist})

    return base.withColumn("_p", nearest("vec")).select("base_id", "vec", "_p.pivot", "_p.dist")


def _side_by_side(table: np.ndarray) -> np.ndarray:
    """The rows in an order in which each is followed by the nearest one left."""
    left, order = np.ones(len(table), bool), [0]
    for _ in range(len(table) - 1):
        left[order[-1]] = False
        apart = ((table - table[order[-1]]) ** 2).sum(1)
        order.append(int(np.where(left, apart, np.inf).argmin()))
    return table[order]


def partition(base: DataFrame, metric: str, block_rows: int, pivots: int | None = None) -> tuple[DataFrame, Partitions]:
    """``base`` (base_id, vec) with its pivot and ring, written down, and their bounds.

    Pivots are distinct rows, picked by hash: about the root of the rows, ``PIVOTS`` at
    most. Rings are cut at quantiles of the distance, one for each block of rows.
    """
    spark = base.sparkSession
    n, widest = base.agg(F.count(F.lit(1)), F.max(l2_norm(F.col("vec")))).first()
    wanted = min(PIVOTS, pivots or max(1, math.isqrt(n)))
    picked = base.select("vec", F.xxhash64("base_id").alias("_h")).orderBy("_h").limit(2 * wanted)
    table = np.unique(_matrix([r["vec"] for r in picked.collect()]), axis=0)  # bounded by PIVOTS
    table = _side_by_side(table[np.random.default_rng(7).permutation(len(table))[:wanted]])
    lift = widest * (1 + 1e-12) if metric == "ip" else None
    placed = cut_lineage(_nearest_pivot(base, table, lift))
    shares = [i / RINGS for i in range(1, RINGS)]
    cuts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("dist", shares).alias("cuts"))
    every = F.greatest(F.lit(1), F.floor(F.lit(float(RINGS * min(block_rows, RING_ROWS))) / F.col("rows"))).cast("int")
    # each n-th quantile, so that a ring holds about a block; one row per pivot
    cuts = cuts.select("pivot", F.filter("cuts", lambda _, i: (i + 1) % every == 0).alias("cuts"))
    ringed = placed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist"))))
    ringed = ringed.drop("cuts")
    facts = ringed.groupBy("pivot", "ring").agg(F.min("dist"), F.max("dist"), F.count(F.lit(1))).collect()  # at most PIVOTS * RINGS
    pivot, ring, low, high, rows = (np.array(c) for c in zip(*sorted(tuple(r) for r in facts), strict=True))
    return ringed, Partitions(table, lift, pivot, ring, low, high, rows)


def _nearest_rings(parts: Partitions, k: int):
    """Function over a batch of queries: the nearest rings that hold ``k`` rows."""

    def want(batch) -> np.ndarray:
        bounds = parts.bounds(matrix(batch.column("vec")))
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(parts.rows[order], axis=1)
        wanted = np.zeros(bounds.shape, bool)
        np.put_along_axis(wanted, order, held - parts.rows[order] < k, 1)
        return wanted

    return want


def _rings_within(parts: Partitions):
    """The rings within ``reach``, but for as many of the nearest as an earlier round has ``seen``."""

    def want(batch) -> np.ndarray:
        bounds = parts.bounds(matrix(batch.column("vec")))
        wanted = bounds <= batch.column("reach").to_numpy()[:, None]
        seen = batch.column("seen").to_numpy()
        if seen.any():
            # stable, so in the order of the earlier round
            order = np.argsort(bounds, axis=1, kind="stable")[:, : seen.max()]
            earlier = np.arange(order.shape[1]) < seen[:, None]
            np.put_along_axis(wanted, order, np.take_along_axis(wanted, order, 1) & ~earlier, 1)
        return wanted

    return want


def _reach(score, norm, lift: float | None):
    """Distance at which a row has this score for a query of this norm."""
    if lift is None:
        return F.sqrt(F.greatest(-score, F.lit(0.0)))
    return F.sqrt(F.greatest(norm * norm + F.lit(lift * lift) - 2 * score, F.lit(0.0)))


def pivot_hits(
    queries: DataFrame, base: DataFrame, k: int | None, metric: str, floor: float | None, skip_self: bool,
    block_rows: int, pivots: int | None = None, copies: list | None = None,
) -> DataFrame:
    """(query_id, base_id, score) with the best ``k`` of every query, or all of ``floor`` and more.

    ``queries`` has query_id and vec, ``base`` base_id and vec. A list given as ``copies``
    receives the number of (query, ring) visits of each round.
    """
    if not base.head(1):
        return queries.sparkSession.createDataFrame([], "query_id long, base_id long, score double")
    ringed, parts = partition(base, metric, block_rows, pivots)
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = Deal(parts.rows, block_size(int(parts.rows.sum()), block_rows, tasks))
    number = queries.sparkSession.createDataFrame(
        [(int(p), int(r), i) for i, (p, r) in enumerate(zip(parts.pivot, parts.ring))], "pivot int, ring int, cell int"
    )
    # one row per ring: bounded by PIVOTS * RINGS
    celled = cut_lineage(ringed.join(F.broadcast(number), ["pivot", "ring"]).select("base_id", "vec", "cell"))
    queries = queries.withColumn("_norm", l2_norm(F.col("vec")))
    reach = None if floor is None else _reach(F.lit(float(floor)), F.col("_norm"), parts.lift) * (1 + SLACK) + SLACK

    def round_of(asking: DataFrame, want) -> tuple[DataFrame, DataFrame]:
        counted = cut_lineage(visits(asking, deal, want, False).select("query_id", "block", "cells"))
        _noted(copies, counted)
        return counted, hits_of_visits(asking, celled, deal, want, k, metric, floor, skip_self, counted)

    if k is None:
        near = queries.select("query_id", "vec", reach.alias("reach"))
        width = max(1, parts.pivots.shape[1])
        deal = Deal(parts.rows, min(deal.size, max(1, NUMBERS // width)))
        return _hits_of_blocks(near, celled, parts, deal, metric, floor, skip_self, copies)
    first, found = round_of(queries.select("query_id", "vec"), _nearest_rings(parts, k + skip_self))
    found = cut_lineage(top_k(found, ["query_id"], [F.desc("score"), F.asc("base_id")], k).drop("rank"))
    kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_kth"))
    seen = first.groupBy("query_id").agg(F.max("cells").alias("seen"))
    near = queries.join(seen, "query_id", "left").join(kth, "query_id", "left").fillna(0, ["seen"])
    by_kth = F.when(F.col("_kth").isNotNull(), _reach(F.col("_kth"), F.col("_norm"), parts.lift) * (1 + SLACK) + SLACK)
    widest = F.lit(float("inf")) if reach is None else reach
    near = near.withColumn("reach", F.least(F.coalesce(by_kth, F.lit(float("inf"))), widest))
    more = round_of(cut_lineage(near.select("query_id", "vec", "reach", "seen")), _rings_within(parts))[1]
    return found.unionByName(more.select(*found.columns))


def _query_blocks(queries: DataFrame, parts: Partitions, deal: Deal) -> DataFrame:
    """Queries (query_id, vec, reach) in rows of at most about ``deal.size``, those of near rings together.

    ``wants`` names the blocks of base rows in which any of them wants a ring, ``cells``
    counts the rings wanted.
    """
    shared = queries.sparkSession.sparkContext.broadcast((parts, deal))

    def chunks(vecs: np.ndarray):
        step = max(1, SCORES // len(shared.value[0].rows))
        for at in range(0, len(vecs), step):
            yield at, shared.value[0].bounds(vecs[at : at + step])

    def place(batches):
        for batch in batches:
            home = np.zeros(batch.num_rows, np.int64)
            for at, bounds in chunks(matrix(batch.column("vec"))):
                home[at : at + len(bounds)] = shared.value[1].start[bounds.argmin(1)] // shared.value[1].size
            yield batch.append_column("home", pa.array(home))

    def pack(table: pa.Table) -> pa.Table:
        vecs, reach = matrix(table.column("vec")), table.column("reach").to_numpy()
        wanted = np.zeros(len(shared.value[0].rows), np.int64)
        for at, bounds in chunks(vecs):
            wanted += (bounds <= reach[at : at + len(bounds), None]).sum(0)
        blocks = [i for i, (a, b) in enumerate(zip(shared.value[1].first, shared.value[1].end)) if wanted[a:b].any()]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (table.column("query_id").to_numpy(), vecs, reach)]
        return pa.table([*blobs, pa.array([blocks], pa.list_(pa.int64())), pa.array([wanted.sum()])], ["q_ids", "q_vecs", "reach", "wants", "cells"])

    placed = cut_lineage(queries.mapInArrow(place, "query_id long, vec array<double>, reach double, home long"))
    sizes = placed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(deal.size)).alias("_parts"))  # one row per block
    part = F.pmod(F.xxhash64("query_id"), F.col("_parts")).alias("part")
    dealt = placed.join(F.broadcast(sizes), "home").select("query_id", "vec", "reach", "home", part)
    packed = dealt.groupBy("home", "part").applyInArrow(pack, "q_ids binary, q_vecs binary, reach binary, wants array<long>, cells long")
    return cut_lineage(packed)


def _base_blocks(base: DataFrame, deal: Deal) -> DataFrame:
    """Base rows (base_id, vec, cell) of each block of ``deal`` as one row."""
    spark = base.sparkSession
    cells = spark.createDataFrame(list(enumerate(zip(deal.start.tolist(), deal.rows.tolist()))), "cell int, _at struct<start: long, rows: long>")
    # dealt by number within the cell, so that blocks are about equally long
    place = F.col("_at.start") + F.pmod(F.xxhash64("base_id"), F.col("_at.rows"))
    dealt = base.join(F.broadcast(cells), "cell").select("base_id", "vec", "cell", F.floor(place / deal.size).alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        blobs = [table.column("base_id").to_numpy(), matrix(table.column("vec")), table.column("cell").to_numpy()]
        return pa.table([table.column("block")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["block", "b_ids", "b_vecs", "b_cells"])

    return cut_lineage(dealt.groupBy("block").applyInArrow(pack, "block long, b_ids binary, b_vecs binary, b_cells binary"))


def _hits_of_blocks(
    queries: DataFrame, base: DataFrame, parts: Partitions, deal: Deal, metric: str, floor: float, skip_self: bool, copies: list | None
) -> DataFrame:
    """HITS of ``floor`` and more: each block of queries with each block of base rows it wants."""
    asking, rows = _query_blocks(queries, parts, deal), _base_blocks(base, deal)
    n = asking.agg(F.count(F.lit(1)), F.coalesce(F.sum("cells"), F.lit(0))).first()
    if copies is not None:
        copies.append(n[1])
    shared = base.sparkSession.sparkContext.broadcast((parts, deal))

    def meet(batches):
        parts, deal = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                names = {"q_ids": "<i8", "reach": "<f8", "b_ids": "<i8", "b_cells": "<i4", "q_vecs": "<f8", "b_vecs": "<f8"}
                got = {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in names.items()}
                q, b = got["q_vecs"].reshape(len(got["q_ids"]), -1), got["b_vecs"].reshape(len(got["b_ids"]), -1)
                first, end = int(deal.first[block]), int(deal.end[block])
                cell = got["b_cells"] - first
                for at in range(0, len(q), STEP):
                    some = slice(at, at + STEP)
                    wanted = parts.bounds_of(q[some], first, end) <= got["reach"][some, None]
                    near = wanted.any(0)[cell]
                    if near.any():
                        found = best_hits(got["q_ids"][some], q[some], got["b_ids"][near], b[near], None, metric, floor, skip_self, wanted, cell[near])
                        yield from found.to_batches()

    # a task for about each two blocks; the product reads both sides where they lie and writes nothing
    asking = asking.drop("cells").repartitionByRange(max(1, n[0]), F.xxhash64("q_ids"))
    rows = rows.repartitionByRange(len(deal.first), "block")
    met = asking.hint("shuffle_replicate_nl").join(rows, F.array_contains("wants", F.col("block")))
    return met.drop("wants").mapInArrow(meet, HITS)


def _noted(copies: list | None, counted: DataFrame) -> None:
    if copies is not None:
        each = counted.groupBy("query_id").agg(F.max("cells").alias("cells"))
        copies.append(each.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0])
