"""Descriptor and code matching against loops over all keypoints."""

import os
import random

import numpy as np
import pytest

from marklens.operators import matching as M
from marklens.operators import pairwise
from marklens.operators.consensus import consensus_score, variant_join


def keypoints(seed, images=12, bits=256):
    rng = random.Random(seed)
    shared = [rng.getrandbits(bits) for _ in range(6)]
    out = {}
    for image in range(images):
        codes = []
        for _ in range(rng.choice((0, 1, 2, 9, 30))):
            code = rng.choice(shared) if rng.random() < 0.6 else rng.getrandbits(bits)
            for _ in range(rng.choice((0, 3, 30, 42, 60))):
                code ^= 1 << rng.randrange(bits)
            codes.append(code)
        out[image] = codes
    return out


def words(code):
    return [int(np.uint64(code >> (64 * w) & (2**64 - 1)).view(np.int64)) for w in range(4)]


def all_pairs(images):
    pairs = [(a, b) for a in images for b in images if a < b]
    return [*pairs, pairs[0], (0, 99), (99, 98)]  # repeated, and images that are not there


@pytest.mark.parametrize("bound,block", [(40, 128), (45, 3)])
def test_wide_codes(spark, monkeypatch, bound, block):
    monkeypatch.setattr(pairwise, "IMAGE_BLOCK", block)
    monkeypatch.setattr(M, "KEYPOINT_ROWS", 7)
    images = keypoints(bound)
    rows = [(i, kp, words(c)) for i, codes in images.items() for kp, c in enumerate(codes)]
    random.Random(1).shuffle(rows)
    codes = spark.createDataFrame([*rows, (3, 900, None)], "image_id long, kp_id int, code array<long>")
    pairs = all_pairs(images)
    got = M.mutual_match(spark.createDataFrame(pairs, "ref_id long, cmp_id long"), codes, bound)
    want = []
    for a, b in pairs:
        x, y = images.get(a, []), images.get(b, [])
        apart = [[(p ^ q).bit_count() for q in y] for p in x]
        for i in range(len(x)):
            if y:
                j = min(range(len(y)), key=lambda j: (apart[i][j], j))
                if min(range(len(x)), key=lambda i: (apart[i][j], i)) == i and apart[i][j] < bound:
                    want.append((a, b, i, j, apart[i][j]))
    assert len(want) > 50
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("block", [128, 2])
def test_ratio(spark, monkeypatch, block):
    monkeypatch.setattr(pairwise, "IMAGE_BLOCK", block)
    monkeypatch.setattr(M, "KEYPOINT_ROWS", 5)
    gen = np.random.default_rng(block)
    centres = gen.normal(size=(8, 16)) * 100
    images = {}
    for i in range(10):
        size = (0, 1, 2, 12, 25)[i % 5]
        # some descriptors are equal, so both nearest are at distance 0
        images[i] = centres[gen.integers(0, 8, size)] + gen.normal(size=(size, 16)) * gen.choice([0, 1, 30], (size, 1))
    rows = [(i, kp, d.tolist()) for i, m in images.items() for kp, d in enumerate(m)]
    features = spark.createDataFrame(rows, "image_id long, kp_id int, descriptor array<double>")
    pairs = all_pairs(images)
    got = M.ratio_match(spark.createDataFrame(pairs, "ref_id long, cmp_id long"), features).collect()
    want = []
    for a, b in pairs:
        count = 0
        if len(images.get(b, ())) > 1:
            for x in images.get(a, ()):
                near = np.sort(np.linalg.norm(images[b] - x, axis=1))
                count += near[0] < 0.75 * near[1]
        want.append((a, b, count))
    assert sum(n for *_, n in want) > 50
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert max(r.good_matches for r in M.ratio_match(spark.createDataFrame(pairs, "ref_id long, cmp_id long"), features, ceiling=3).collect()) == 3


def test_no_pairs(spark):
    none = spark.createDataFrame([], "ref_id long, cmp_id long")
    codes = spark.createDataFrame([], "image_id long, kp_id int, code long")
    assert M.mutual_match(none, codes).collect() == []
    one = spark.createDataFrame([(1, 2)], "ref_id long, cmp_id long")
    features = spark.createDataFrame([], "image_id long, kp_id int, descriptor array<double>")
    assert [tuple(r) for r in M.ratio_match(one, features).collect()] == [(1, 2, 0)]


@pytest.mark.parametrize("block", [128, 2])
def test_consensus(spark, monkeypatch, block):
    monkeypatch.setattr(pairwise, "IMAGE_BLOCK", block)
    gen = np.random.default_rng(3)
    centres = gen.normal(size=(3, 8))
    images = {i: centres[i % 3] + gen.normal(size=((0, 1, 3, 5)[i % 4], 8)) for i in range(12)}
    rows = [(i, v.tolist()) for i, m in images.items() for v in m] + [(2, None), (3, [0.0] * 8)]
    variants = spark.createDataFrame(rows, "image_id long, embedding array<double>")
    listed = all_pairs(images)
    pairs = spark.createDataFrame(listed, "ref_id long, cmp_id long")
    want, several = {}, 0
    for a, b in set(listed):
        x, y = images.get(a, ()), images.get(b, ())
        if len(x) and len(y):
            c = [float(p @ q / np.linalg.norm(p) / np.linalg.norm(q)) for p in x for q in y]
            high = sum(v > 0.3 for v in c)
            several += high >= 3
            want[a, b] = (np.median(c), np.mean(c), max(c), high / len(c), max(c) if high >= 3 else np.median(c))
    got = {(r.ref_id, r.cmp_id): tuple(r)[2:] for r in consensus_score(pairs, variants, 0.3).collect()}
    assert got.keys() == want.keys() and 0 < several < len(want)
    np.testing.assert_allclose([got[p] for p in want], list(want.values()))
    once = spark.createDataFrame(sorted(set(listed)), "ref_id long, cmp_id long")
    assert variant_join(once, variants).count() == sum(len(images.get(a, ())) * len(images.get(b, ())) for a, b in set(listed))


def test_scores_of_a_pair_meet_without_joins(spark):
    """Shapes are grouped once, the four scores meet without a shuffle, null ids stay alone."""
    from marklens.operators import matching as M
    from marklens.plans.balanced import balanced_compare

    rng = np.random.default_rng(4)
    rows = []
    for pair in range(12):
        for _ in range(int(rng.integers(1, 12))):
            c1, c2, a1, a2 = (int(x) for x in rng.integers(0, 5, 4))
            shape = None if rng.random() < 0.3 else float(rng.random())
            rows.append((pair % 4, pair // 4, None if c1 == 4 else c1, c2, a1 or None, a2, float(rng.random()), shape))
    contours = spark.createDataFrame(rows, "ref_id long, cmp_id long, c1 int, c2 int, area1 int, area2 int, hu double, shape double")

    def largest(own, c, a):
        keys = sorted({(r[a] is None, -(r[a] or 0), r[c] is not None, r[c] or 0) for r in own})[:3]
        return {key[3] for key in keys if key[2]}

    want = {}
    for pair in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == pair]
        one, two = largest(own, 2, 4), largest(own, 3, 5)
        for r in (r for r in own if r[2] in one and r[3] in two):
            parts = [1 / (1 + r[6])] + ([1 / (1 + r[7])] if r[7] is not None else [])
            big = max(x for x in r[4:6] if x is not None)
            parts += [min(x for x in r[4:6] if x is not None) / big] if big else []
            want[pair] = max(want.get(pair, 0), sum(parts) / len(parts))
    boosted = {p: min(0.85, b * 1.2) if b > 0.6 else min(0.7, b * 1.1) if b > 0.4 else b for p, b in want.items()}
    scored = M.shape_score(contours)
    assert {(r.ref_id, r.cmp_id): pytest.approx(r.shape_score) for r in scored.collect()} == boosted
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0

    counts = spark.createDataFrame([(0, 0, "ORB", 30, 20, 90, 90), (None, 1, "ORB", 30, 20, 90, 90)], "ref_id long, cmp_id long, method string, good_matches int, inliers int, kp1 int, kp2 int")
    seen = spark.createDataFrame([(0, 0, 64, 0.9, 0.8), (None, 1, 64, 0.9, 0.8), (7, 7, 64, 0.9, 0.8)], "ref_id long, cmp_id long, size int, mv double, em double")
    fused = balanced_compare(counts, seen, seen, contours)
    assert "Join" not in fused._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.ref_id, r.cmp_id): r for r in fused.collect() if r.ref_id is not None}
    assert set(got) == set(boosted) | {(0, 0), (7, 7)} and fused.count() == len(got) + 3
    assert (got[0, 0].best_method, got[0, 0].inlier_matches) == ("ORB", 20)
    assert (got[7, 7].best_method, got[7, 7].inlier_matches) == (None, 0)


def test_structure_of_sizes_seen(spark):
    """Exactly the weighted sizes, repeated or not, give the weighted sum, others the mean, in one shuffle."""
    seen = {1: [(64, 0.9), (128, 0.5), (256, 0.4)], 2: [(64, 0.9), (64, 0.8), (128, 0.5), (256, 0.4)], 3: [(64, 0.9), (128, 0.5)]}
    seen |= {4: [(64, 0.9), (128, 0.5), (256, 0.4), (512, 0.7)], 5: [(64, 0.9), (128, 0.5), (None, 0.8)], 6: [(256, None), (64, 0.9), (128, 0.5)]}
    rows = [(p, 0, size, mv) for p, own in seen.items() for size, mv in own] + [(7, 0, 64, None)]
    scored = M.ssim_score(spark.createDataFrame(rows, "ref_id long, cmp_id long, size int, mv double"))
    want = {}
    for p, own in seen.items():
        own = [(size, mv) for size, mv in own if mv is not None]
        sizes = {size for size, _ in own}
        weighted = sum(mv * M.SIZE_WEIGHTS.get(size, 0) for size, mv in own)
        value = weighted if sizes == set(M.SIZE_WEIGHTS) else sum(mv for _, mv in own) / len(own)
        want[p] = pytest.approx(0.0 if value < 0.3 else min(0.9, (value - 0.3) / 0.7 * 0.9))
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.ref_id: r.ssim_score for r in scored.collect()} == want


def test_pairs_are_dealt_once_by_size(spark, monkeypatch):
    """Each input of the bands is shuffled once, by pair, in partitions that follow its rows."""
    import duckdb

    import marklens.session as session
    from __spark_entry__ import oracle_sql, queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    monkeypatch.setattr(session, "PART_ROWS", 500)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    bands = queries()["score_bands"](spark, folder)
    plan = bands._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
    assert plan.count(f", {-(-rows // 500)}), REPARTITION_BY_NUM") == 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    assert [tuple(bands.first())] == con.execute(oracle_sql()["score_bands"]).fetchall()


def test_best_method_of_equals(spark):
    """Equal scores go to the first method, rows without a score are last."""
    rows = [(1, "AKAZE", 0.5, 9), (1, "ORB", 0.5, 7), (1, "SIFT", None, 8), (2, "ORB", None, 3), (3, "other", 0.6, 2), (3, "SIFT", 0.5, 9)]
    scores = spark.createDataFrame([(p, 0, *r, 10, 10) for p, *r in rows], "ref_id long, cmp_id long, method string, score double, inliers int, kp1 int, kp2 int")
    best = {r.ref_id: (r.best_method, r.feature_score, r.inlier_matches) for r in M.best_method(scores).collect()}
    assert best == {1: ("ORB", 0.5, 7), 2: ("ORB", None, 3), 3: ("other", 0.6, 2)}
