"""Visits dealt by blocks of cells, and pairs of images by cells of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.functions.vector import l2_norm, normalised
from marklens.operators import blocks as B
from marklens.operators import pairwise


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_a_query_goes_once_to_a_block(spark, size):
    """All cells wanted: copies follow the blocks, and every row is met once."""
    gen = np.random.default_rng(size)
    cell = np.sort(gen.integers(0, 40, 300))
    cell[100:200] = 20  # a third of the rows lies in one cell
    rows = np.bincount(cell, minlength=40)
    deal = B.Deal(rows, size)
    data, asked = gen.normal(size=(300, 4)), gen.normal(size=(30, 4))
    base = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(data, cell))], "base_id long, vec array<double>, cell int")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    odd = gen.random(40) < 0.5
    for wanted in (np.ones(40, bool), odd):
        want = lambda batch: np.tile(wanted & (rows > 0), (batch.num_rows, 1))  # noqa: B023, E731
        assert B.visits(queries, deal, want).count() <= 30 * (300 // size + 1)
        got = B.hits_of_visits(queries, base, deal, want, None, "ip", -1e9, False).collect()
        assert sorted((r.query_id, r.base_id) for r in got) == [(q, b) for q in range(30) for b in range(300) if wanted[cell[b]]]
        best = B.hits_of_visits(queries, base, deal, want, 3, "ip", None, False).collect()
        for q in range(30):
            scores = np.where(wanted[cell], asked[q] @ data.T, -np.inf)
            kept = sorted((r.score for r in best if r.query_id == q), reverse=True)[:3]
            assert kept == pytest.approx(np.sort(scores)[::-1][:3])


def test_best_hits_ties_and_own_row():
    ids, rows = np.arange(500), np.tile([[1.0, 0.0]], (500, 1))
    found = B.best_hits(ids[:3], rows[:3], ids, rows, 2, "l2", None, True).to_pydict()
    assert found["base_id"] == [1, 2, 0, 2, 0, 1] and set(found["score"]) == {0.0}


def test_few_pairs_make_few_cells(spark):
    """Ten pairs for each of many images: a cell for about CELL_PAIRS, not one for each pair."""
    n = 2000
    pairs = [(i, (i * 7 + j * 131) % n) for i in range(n) for j in range(10)]
    codes = spark.range(n).select(F.col("id").alias("image_id"), F.lit(0).alias("kp_id"), (F.col("id") % 5).alias("code"))
    listed = spark.createDataFrame(pairs, "ref_id long, cmp_id long")

    def match(kp1, a, kp2, b):
        return [np.array([int(a[0, 0] + b[0, 0])])]

    blocks = pairwise.math.isqrt(len(pairs) // pairwise.CELL_PAIRS) + 1
    got = pairwise.per_pair(listed, codes, "code", match, {"total": "long"}, order="kp_id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f", {blocks})" in plan and f", {n // pairwise.IMAGE_BLOCK + 1})" not in plan
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, a % 5 + b % 5) for a, b in pairs)


def test_norm_is_not_computed_for_each_number(spark):
    """Unit vectors of 4,000 numbers: quadratic work per row would take minutes."""
    df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: x.cast("double")).alias("v"))
    unit = df.withColumn("n", l2_norm(F.col("v"))).withColumn("v", normalised(F.col("v"), F.col("n")))
    plan = unit.select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" in plan
    assert unit.select(F.round(l2_norm(F.col("v")), 9)).distinct().collect() == [(1.0,)]
