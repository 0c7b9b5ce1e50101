"""Palettes, k-means and masks on small images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.functions import color as C
from marklens.functions.color_arrays import DELTA_E
from marklens.operators import kmeans
from marklens.operators import palette as P
from marklens.operators import pixels as X
from marklens.operators.kmeans import kmeans_palette
from marklens.plans import color as J
from marklens.plans.sanity import sanity_report


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(5)
    rows = []
    for image, centres in enumerate([[(200, 30, 30), (20, 200, 40)], [(30, 60, 220), (230, 200, 40), (120, 120, 120)]]):
        for c in centres:
            for _ in range(400):
                rows.append((image, *[int(np.clip(x + rng.integers(-12, 13), 0, 255)) for x in c]))
    rows.append((2, 10, 20, 30))  # a single pixel
    return spark.createDataFrame(rows, "image_id long, r int, g int, b int")


def lloyd(points, weights, centres, rounds):
    for _ in range(rounds):
        d = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        for j in range(len(centres)):
            m = label == j
            if m.any():
                centres[j] = (points[m] * weights[m, None]).sum(axis=0) / weights[m].sum()
    return centres


def test_kmeans_matches_numpy(spark, pixels):
    hist = X.color_histogram(pixels)
    got = kmeans_palette(hist, 3, rounds=6)
    for image in (0, 1):
        rows = sorted(
            ((r.n, r.r, r.g, r.b) for r in hist.filter(F.col("image_id") == image).collect()),
            key=lambda x: (-x[0], x[1:]),
        )
        points = np.array([r[1:] for r in rows], dtype=float)
        weights = np.array([r[0] for r in rows], dtype=float)
        expected = lloyd(points, weights, points[:3].copy(), 6)
        mine = [(r.x0, r.x1, r.x2) for r in got.filter(F.col("image_id") == image).collect()]
        assert np.allclose(sorted(mine), sorted(map(tuple, expected)))
    alone = got.filter("image_id = 2").collect()
    assert len(alone) == 1 and alone[0].weight == 1


def test_kmeans_of_large_images_is_the_same(spark, pixels, monkeypatch):
    hist = C.with_lab(X.color_histogram(pixels))
    options = {"rounds": 4, "space": ("lab_l", "lab_a", "lab_b"), "max_k": 5}
    size = F.least(F.lit(5), F.expr("total div 3"))

    def rows():
        return sorted((r.image_id, r.slot, r.x0, r.x1, r.x2, r.n, r.weight) for r in kmeans_palette(hist, size, **options).collect())

    whole = rows()
    monkeypatch.setattr(kmeans, "IMAGE_COLORS", 1)
    steps = rows()
    assert [r[:2] + r[5:6] for r in whole] == [r[:2] + r[5:6] for r in steps]
    assert np.allclose([r[2:5] for r in whole], [r[2:5] for r in steps])
    assert kmeans_palette(hist.limit(0), 3).collect() == []


def test_palette_jobs(spark, pixels):
    strict = J.strict_palette(pixels, rounds=3)
    assert strict.groupBy("image_id").count().filter("count <> 8").count() == 0
    soft = J.perceptual_palette(pixels, rounds=3)
    sums = {r.image_id: r.s for r in soft.groupBy("image_id").agg(F.sum("weight").alias("s")).collect()}
    assert sums == pytest.approx({0: 1, 1: 1, 2: 1})
    index = J.build_color_index(pixels, rounds=3)
    assert {r.image_id for r in index.collect()} == {0, 1}  # the single pixel has no palette
    near = J.search_color_index(index, index, 2).collect()
    assert {(r.query_id, r.base_id) for r in near if r["rank"] == 1} == {(0, 0), (1, 1)}
    assert J.scan_palette(pixels, rounds=2).filter("image_id = 1").count() == 2


def test_scores_of_equal_and_missing_palettes(spark, pixels):
    palette = X.dominant_colors(pixels, 8).select("image_id", "slot", "r", "g", "b", (F.col("n") / 1200).alias("weight"))
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 9)], "ref_id long, cmp_id long")

    def scores(df):
        return {r.cmp_id: r.color_similarity for r in df.collect()}

    strict = scores(P.strict_color_score(pairs, palette))
    assert strict[0] <= 95 and strict[9] == 0
    assert scores(P.perceptual_color_score(pairs, palette))[0] == 100
    assert scores(P.lab_color_score(pairs, palette))[0] == 100
    assert scores(P.rgb_color_score(pairs, palette))[0] == 100
    vectors = P.lab_vector(palette)
    for method in ("cosine", "euclidean"):
        got = scores(P.vector_color_score(pairs, vectors, method))
        assert got[0] == pytest.approx(100) and got[9] == 0
    scan = {r.cmp_id: r for r in J.color_scan(pairs, palette).collect()}
    assert scan[0].risk_assessment == "VERY HIGH RISK" and scan[0].processing_status == "Success"
    assert scan[9].risk_assessment == "PROCESSING FAILED" and scan[9].color_similarity == 0
    summary = J.color_summary(J.color_scan(pairs, palette)).first()
    assert (summary.total_comparisons, summary.successfully_processed) == (3, 2)
    with pytest.raises(ValueError):
        J.color_scan(pairs, palette, "other")


def test_guards_stop_when_little_survives(spark):
    dark = [(0, 5, 5, 5)] * 100 + [(0, 90, 40, 20)] * 10  # too few bright pixels
    bright = [(1, 5, 5, 5)] * 100 + [(1, 200, 40, 20)] * 500
    hist = X.color_histogram(spark.createDataFrame(dark + bright, "image_id long, r int, g int, b int"))
    kept = X.guarded_filter(hist, "image_id", X.logo_pixel_guards(8))
    sizes = {r.image_id: r.n for r in kept.groupBy("image_id").agg(F.sum("n").alias("n")).collect()}
    assert sizes == {0: 110, 1: 500}


def test_sanity_report_warns(spark):
    hist = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "image_id long, histogram array<double>")
    edges = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "image_id long, edge array<double>")
    pairs = spark.createDataFrame([(0, 0), (0, 1)], "ref_id long, cmp_id long")
    got = {r.cmp_id: r for r in sanity_report(pairs, hist, edges).collect()}
    assert not got[0].warning and got[1].warning and got[1].color_distance == 0


@pytest.mark.parametrize("metric", ["de76", "de94", "de2000"])
def test_color_arrays_equal_columns(spark, metric):
    rng = np.random.default_rng(5)
    lab = rng.uniform([0, -100, -100], [100, 100, 100], (400, 2, 3)).transpose(1, 0, 2)
    lab[:, :40, 1:] = 0  # grays
    lab[1, 40:80] = lab[0, 40:80]
    rows = [(i, *x.tolist(), *y.tolist()) for i, (x, y) in enumerate(zip(*lab, strict=True))]
    names = [f"{p}{c}" for p in ("x_", "y_") for c in "lab"]
    frame = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in names))
    got = C.DELTA_E[metric](frame, "x_", "y_").orderBy("i").collect()
    assert np.allclose([r.delta_e for r in got], DELTA_E[metric](*lab), rtol=1e-9, atol=1e-9)


def test_nearest_colours_by_hand(spark):
    rng = np.random.default_rng(6)
    sizes = {"a": 3, "b": 1, "c": 8, "d": 0}
    colours = {k: [(s, *map(int, rng.integers(1, 256, 3)), float(rng.uniform(0.02, 1))) for s in range(n)] for k, n in sizes.items()}
    palette = spark.createDataFrame([(k, *c) for k, v in colours.items() for c in v], "image_id string, slot int, r int, g int, b int, weight double")
    keys = [(x, y) for x in sizes for y in sizes] + [("a", "c"), (None, "a"), ("a", "gone")]
    pairs = spark.createDataFrame(keys, "ref_id string, cmp_id string")
    expected = []
    for x, y in keys:
        one, two = colours.get(x, []), colours.get(y, [])
        gaps = [min(sum((p - q) ** 2 for p, q in zip(c[1:4], d[1:4], strict=True)) ** 0.5 for d in two) for c in one if two]
        expected.append((x or "", y, round((1 - np.mean(gaps) / (255 * 3**0.5)) * 100, 6) if gaps else 0.0))
    flat = P._nearest(P._sides(pairs, palette, None), ("r", "g", "b"), P._rgb_gap)
    mean = F.expr("aggregate(near, 0D, (a, x) -> a + x.d) / nullif(size(near), 0)")
    got = flat.select("ref_id", "cmp_id", F.coalesce(C.rgb_similarity(mean), F.lit(0.0)).alias("s")).collect()
    assert sorted((r.ref_id or "", r.cmp_id, round(r.s, 6)) for r in got) == sorted(expected)
    for score in (P.strict_color_score, P.perceptual_color_score, P.lab_color_score, P.rgb_color_score):
        scores = {(r.ref_id, r.cmp_id): r.color_similarity for r in score(pairs, palette).collect()}
        assert len(scores) == len(set(keys)) and all(0 <= v <= 100 for v in scores.values())
