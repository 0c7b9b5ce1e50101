"""Visits of queries to cells of base rows, dealt by blocks of many cells.

A cell is a ring of a pivot or an inverted list. Cells follow each other in blocks of
about as many rows as a task may hold, whatever their own sizes; a query goes once to
each block in which it wants a cell, with one bit per cell there, and a block goes once
to each part of its visitors. So what is shuffled grows with the blocks, not with the
cells. A task multiplies its queries with the rows of the cells that any of them wants.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores that a task holds at once, and base rows whose maximum is taken together.
SCORES, GROUP = 1 << 19, 64
#: Least rows of a block, however many tasks there could be.
LEAST_ROWS = 512
#: Ranking uses all digits but the noise of summation.
RANK_DIGITS = 12
_NOISE = 2e-12

HITS = "query_id long, base_id long, score double"


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    numbers = flat.flatten().to_numpy(zero_copy_only=False)
    return numbers.astype(np.float64, copy=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def block_size(rows: int, most: int, tasks: int) -> int:
    """Rows of a block: ``most``, or fewer where blocks would not busy the tasks."""
    return min(most, max(LEAST_ROWS, math.ceil(rows / (2 * math.isqrt(tasks) + 2))))


@dataclass
class Deal:
    """Cells (numbered from 0) with their rows, one after another, cut every ``size`` rows."""

    rows: np.ndarray
    size: int

    def __post_init__(self):
        self.start = np.cumsum(self.rows) - self.rows
        edges = np.arange(0, int(self.rows.sum()), self.size)
        # first cell of each block, and the one after its last
        self.first = np.searchsorted(self.start + self.rows, edges, "right")
        self.end = np.searchsorted(self.start, edges + self.size, "left")

    def visits(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
        """Blocks in which queries want a cell: block, the queries, and their bits."""
        for block, (first, end) in enumerate(zip(self.first.tolist(), self.end.tolist(), strict=True)):
            here = wanted[:, first:end]
            who = np.flatnonzero(here.any(1))
            if len(who):
                yield block, who, [row.tobytes() for row in np.packbits(here[who], axis=1)]


def visits(queries: DataFrame, deal: Deal, want: Callable, with_vec: bool = True) -> DataFrame:
    """One row per query and block: query_id, vec, block, bits, and the cells wanted in all.

    ``want(batch)`` gives a row of booleans over the cells for each query of an Arrow batch.
    """
    shared = queries.sparkSession.sparkContext.broadcast(deal)

    def run(batches):
        step = max(1, SCORES // max(1, len(shared.value.rows)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                wanted = want(batch)
                cells = wanted.sum(1)
                for block, who, bits in shared.value.visits(wanted):
                    rows = batch.take(pa.array(who))
                    vec = [rows.column("vec")] if with_vec else []
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("query_id"), *vec, pa.array(np.full(len(who), block)), pa.array(bits, pa.binary()), pa.array(cells[who])],
                        ["query_id", *["vec"] * with_vec, "block", "bits", "cells"],
                    )

    vec = "vec array<double>, " if with_vec else ""
    return queries.mapInArrow(run, f"query_id long, {vec}block long, bits binary, cells long")


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the few true values, looked for eight at a time."""
    flat = hit.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.append(at, np.arange(whole, len(flat)))
    return np.divmod(at[flat[at]], hit.shape[1])


def best_hits(
    q_ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int | None, metric: str,
    min_score: float | None, skip_self: bool, wanted: np.ndarray | None = None, cell: np.ndarray | None = None,
) -> pa.Table:
    """Best ``k`` base rows per query, and those over a floor, as HITS (ties by base id).

    ``cell`` is the cell of each base row, and ``wanted`` has a row of booleans over the
    cells for each query. L2 scores are negated squared distances.
    """
    found = []
    order = np.argsort(b_ids, kind="stable") if skip_self else None
    sorted_ids = b_ids[order] if skip_self else None
    step = max(1, SCORES // max(1, len(b_ids)))
    b_squares = (b * b).sum(1)
    for at in range(0, len(q_ids) if len(b_ids) else 0, step):
        ids, own = q_ids[at : at + step], q[at : at + step]
        scores = own @ b.T
        if metric == "l2":
            scores *= 2.0
            scores -= (own * own).sum(1)[:, None]
            scores -= b_squares
            np.minimum(scores, 0.0, out=scores)
        if wanted is not None:
            here = wanted[at : at + step]
            if not here.all():
                scores[~here[:, cell]] = -np.inf
        if skip_self:
            begin, end = (np.searchsorted(sorted_ids, ids, side) for side in ("left", "right"))
            n = end - begin
            place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            scores[np.repeat(np.arange(len(ids)), n), order[place]] = -np.inf
        least = np.full(len(ids), -np.inf if min_score is None else min_score)
        if k is not None and len(b_ids) > k:
            # the k-th of the maxima of groups of rows is at most the k-th score
            group = max(1, min(GROUP, len(b_ids) // (2 * k)))
            tops = np.maximum.reduceat(scores, np.arange(0, len(b_ids), group), axis=1)
            least = np.maximum(least, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k])
        row, col = _places(scores >= np.maximum(least - _NOISE, np.finfo(np.float64).min)[:, None])
        score = np.round(scores[row, col], RANK_DIGITS)
        if min_score is not None:
            over = score >= min_score
            row, col, score = row[over], col[over], score[over]
        if k is not None:
            ranked = np.lexsort((b_ids[col], -score, row))
            row, col, score = row[ranked], col[ranked], score[ranked]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, score = (x[place < k] for x in (row, col, score))
        found.append((ids[row], b_ids[col], score))
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "base_id", "score"])


def hits_of_visits(
    queries: DataFrame, base: DataFrame, deal: Deal, want: Callable, k, metric, floor, skip_self,
    counted: DataFrame | None = None,
) -> DataFrame:
    """HITS of queries (query_id, vec) among the base rows (base_id, vec, cell) of the cells they want.

    ``counted``: the visits without vectors, where they are written down.
    """
    spark = queries.sparkSession
    counted = visits(queries, deal, want, False) if counted is None else counted
    visitors = {r["block"]: r["count"] for r in counted.groupBy("block").count().collect()}  # one row per block
    if not visitors:
        return spark.createDataFrame([], HITS)
    parts = [math.ceil(visitors.get(i, 0) / deal.size) for i in range(len(deal.first))]
    cells = spark.createDataFrame(list(enumerate(zip(deal.start.tolist(), deal.rows.tolist()))), "cell int, _at struct<start: long, rows: long>")
    blocks = F.broadcast(spark.createDataFrame(list(enumerate(parts)), "block long, _parts long").filter("_parts > 0"))
    place = F.col("_at.start") + F.pmod(F.xxhash64("base_id"), F.col("_at.rows"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part")
    b = base.join(F.broadcast(cells), "cell").withColumn("block", F.floor(place / deal.size))
    b = b.join(blocks, "block").select("base_id", "vec", "cell", "block", part)
    q = visits(queries, deal, want).join(blocks, "block")
    q = q.select("query_id", "vec", "bits", "block", F.pmod(F.xxhash64("query_id"), F.col("_parts")).alias("part"))
    shared = spark.sparkContext.broadcast(deal)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q, b_ids, b = left.column("query_id").to_numpy(), matrix(left.column("vec")), right.column("base_id").to_numpy(), matrix(right.column("vec"))
        if not len(q_ids) or not len(b_ids):
            return best_hits(q_ids[:0], q[:0], b_ids[:0], b[:0], k, metric, floor, skip_self)
        first, end = (int(x[key[0].as_py()]) for x in (shared.value.first, shared.value.end))
        bits = np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint8).reshape(len(q_ids), -1)
        wanted = np.unpackbits(bits, axis=1, count=end - first).view(bool)
        cell = right.column("cell").to_numpy() - first
        if wanted.all():
            return best_hits(q_ids, q, b_ids, b, k, metric, floor, skip_self)
        # queries that want the same cells stand together
        order = np.lexsort(bits.T)
        found, step = [], 256
        for at in range(0, len(order), step):
            some = order[at : at + step]
            near = wanted[some].any(0)[cell]
            found.append(best_hits(q_ids[some], q[some], b_ids[near], b[near], k, metric, floor, skip_self, wanted[some], cell[near]))
        return pa.concat_tables(found)

    n = max(sum(parts), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["block", "part"]
    return q.repartition(n, *keys).groupBy(*keys).cogroup(b.repartition(n, *keys).groupBy(*keys)).applyInArrow(meet, HITS)
