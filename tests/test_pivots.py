"""Exact joins through pivot partitions against brute force."""

import numpy as np
import pytest

from marklens.operators import pivots
from marklens.operators.knn import vector_join


def brute(queries, base, metric, k=None, floor=None, skip_self=False):
    out = {}
    for q, x in queries:
        scored = []
        for b, y in base:
            if skip_self and q == b:
                continue
            s = float(x @ y) if metric == "ip" else -float(((x - y) ** 2).sum())
            if floor is None or round(s, 12) >= floor:
                scored.append((-round(s, 12), b))
        scored.sort()
        out |= {(q, b): pytest.approx(abs(s), abs=1e-5) for s, b in (scored[:k] if k else scored)}
    return out


def frame(spark, rows, name):
    data = [(i, None if x is None else [float(v) for v in x], "extra") for i, x in rows]
    return spark.createDataFrame(data, f"{name} long, embedding array<double>, cell string").repartition(4)


def result(hits):
    rows = hits.collect()
    found = {(r.query_id, r.base_id): abs(r.score) for r in rows}
    assert len(found) == len(rows)
    return found


def clusters(seed, n, width=8, groups=10):
    rng = np.random.default_rng(seed)
    centres = 5 * rng.standard_normal((groups, width))
    return [(i, centres[i % groups] + rng.uniform(0.05, 1) * rng.standard_normal(width)) for i in range(n)]


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize(("k", "block"), [(1, 64), (7, 16), (30, 4096)])
def test_top_k(spark, metric, k, block):
    data = clusters(k, 300)
    queries = [(i, x * 1.1) for i, x in data[:40]]
    hits = vector_join(frame(spark, queries, "query_id"), frame(spark, data, "base_id"), k, metric, skip_self=True, block_rows=block, broadcast_cells=0)
    assert result(hits) == brute(queries, data, metric, k, skip_self=True)


@pytest.mark.parametrize(("metric", "limit"), [("ip", 40.0), ("l2", 3.0)])
def test_threshold_alone_and_with_top_k(spark, metric, limit):
    data = clusters(5, 250)
    floor = limit if metric == "ip" else -limit
    q, b = frame(spark, data[:50], "query_id"), frame(spark, data, "base_id")
    hits = vector_join(q, b, None, metric, limit, block_rows=32, broadcast_cells=0)
    assert result(hits) == brute(data[:50], data, metric, None, floor)
    hits = vector_join(q, b, 3, metric, limit, block_rows=32, broadcast_cells=0)
    assert result(hits) == brute(data[:50], data, metric, 3, floor)


def test_copies_nulls_zeros_and_empty(spark):
    """A third of all rows is one vector: its ring is split, ties go by id."""
    data = clusters(8, 120) + [(1000 + i, np.ones(8)) for i in range(60)] + [(2000, np.zeros(8)), (2001, None)]
    usable = [(i, x) for i, x in data if x is not None]
    queries = [usable[3], (1003, np.ones(8)), (2000, np.zeros(8))]
    b = frame(spark, data, "base_id")
    hits = vector_join(frame(spark, queries, "query_id"), b, 9, "l2", skip_self=True, block_rows=8, broadcast_cells=0)
    assert result(hits) == brute(queries, usable, "l2", 9, skip_self=True)
    none = frame(spark, [], "query_id")
    assert vector_join(none, b, 3, broadcast_cells=0).collect() == []
    assert vector_join(frame(spark, queries, "query_id"), frame(spark, [], "base_id"), 3, broadcast_cells=0).collect() == []


def test_visits_grow_slower_than_the_blocks(spark):
    """On clustered rows a query visits about as many partitions at four times the size."""
    shares = []
    for n in (500, 2000):
        data = clusters(9, n)
        copies = []
        b = frame(spark, data, "base_id")
        vector_join(frame(spark, data[:100], "query_id"), b, 5, "l2", block_rows=16, broadcast_cells=0, copies=copies).collect()
        shares.append((sum(copies) / 100, n / 16))
    (few, blocks), (many, more_blocks) = shares
    assert many < more_blocks and many / few < 0.75 * more_blocks / blocks


def test_bounds_hold():
    rng = np.random.default_rng(1)
    base, queries = rng.standard_normal((200, 5)) * rng.uniform(0, 3, (200, 1)), rng.standard_normal((50, 5))
    table = base[:10]
    for lift in (None, np.linalg.norm(base, axis=1).max()):
        d = pivots._distances(base, table, lift, False)
        near = d.argmin(1)
        own = d[np.arange(200), near]
        parts = pivots.Partitions(table, lift, np.arange(10), np.zeros(10, int), *(np.array([f(own[near == p]) for p in range(10)]) for f in (np.min, np.max, len)))
        least = parts.bounds(queries)
        true = ((queries[:, None] - base[None]) ** 2).sum(2)
        if lift is not None:
            true = (queries**2).sum(1)[:, None] + lift**2 - 2 * queries @ base.T
        assert (least[:, near] <= np.sqrt(np.maximum(true, 0)) + 1e-6).all()


def test_a_task_holds_no_more_for_more_queries_or_pivots(monkeypatch):
    """Distances from pivots come by bounded matrices, hits of broadcast queries part by part."""
    from marklens.operators import knn
    from marklens.operators.blocks import best_hits

    rng = np.random.default_rng(2)
    rows, table = rng.standard_normal((3000, 6)), rng.standard_normal((700, 6))
    plain, seen = pivots._distances(rows, table, None, False), []
    real = pivots._distances
    monkeypatch.setattr(pivots, "_distances", lambda v, *a: seen.append(len(v) * len(table)) or real(v, *a))
    at, dist = pivots._nearest_of(rows, table, None)
    assert max(seen) <= pivots.SCORES < plain.size
    assert (at == plain.argmin(1)).all() and dist == pytest.approx(plain.min(1))

    ids, q = np.arange(20000), rng.standard_normal((20000, 6))
    options = (np.arange(3000), rows, 3, "l2", None, True)
    found = list(knn._hits_by_parts(ids, q, *options))
    assert max(len(f) for f in found) <= 3 * knn.QUERY_ROWS and len(found) > 1
    whole = best_hits(ids, q, *options)
    assert whole.equals(whole.schema.empty_table().from_batches([b for f in found for b in f.to_batches()]))


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i) for i in range(files.size()))
    return {f.getPath(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_threshold_join_writes_no_copies_for_pairs_of_blocks(spark):
    rows = np.random.default_rng(5).normal(size=(3000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, embedding array<double>").repartition(4)
    before = _shuffled(spark)
    hits = vector_join(
        frame, frame, min_score=0.75, query_id="id", base_id="id", skip_self=True, block_rows=64, broadcast_cells=0
    ).collect()
    written = sum(n for path, n in _shuffled(spark).items() if path not in before)
    scores = np.round(rows @ rows.T, 12)
    np.fill_diagonal(scores, -1)
    want = {(a, b, round(float(scores[a, b]), 6)) for a, b in zip(*np.nonzero(scores >= 0.75))}
    assert len(hits) == len(want) > 1000
    assert {(h.query_id, h.base_id) for h in hits} == {w[:2] for w in want}
    # 47 blocks of 64 rows: a copy of both sides for each of them would be over 30 MB
    assert written < 12 * rows.nbytes
