"""Similarity joins against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.functions import text as T
from marklens.operators import knn as K
from marklens.operators import text_pairs as P
from marklens.operators.grouping import carry_forward, first_per_group, top_k
from marklens.plans import index as I


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    stems = ["nike", "adidas", "pumas", "red bull", "blue bolt", "zz", "a", "coca cola", "pepsi co", "apple inc"]
    found = set(stems)
    while len(found) < 70:
        word = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e", " x", "rt"])
        found.add("".join(word).strip() or "q")
    return sorted(found)


def frame(spark, values):
    return spark.createDataFrame([(t,) for t in values], "text string")


def all_pairs(spark, values):
    return spark.createDataFrame(list(itertools.product(values, values)), "text1 string, text2 string")


def as_map(df, digits=6):
    return {(r.text1, r.text2): round(r.text_similarity, digits) for r in df.collect()}


@pytest.mark.parametrize("minimum", [40.0, 55.0, 70.0, 90.0])
def test_edit_and_containment_join(spark, texts, minimum):
    df, pairs = frame(spark, texts), all_pairs(spark, texts)
    for join, score in (
        (P.edit_score_pairs, T.levenshtein_similarity),
        (P.containment_score_pairs, T.containment_similarity),
    ):
        brute = pairs.withColumn("text_similarity", score(F.col("text1"), F.col("text2")))
        expected = as_map(brute.filter(F.col("text_similarity") >= minimum - 1e-9))
        assert as_map(join(df, df, minimum)) == expected


@pytest.mark.parametrize("minimum", [45.0, 60.0, 70.0, 85.0])
def test_word_joins(spark, texts, minimum):
    df, pairs = frame(spark, texts), all_pairs(spark, texts)
    v1 = as_map(P.text_score_v1(pairs).filter(F.col("text_similarity") >= minimum))
    assert as_map(P.text_score_pairs_v1(df, df, minimum)) == v1
    v3 = as_map(P.text_score_v3(pairs).filter(F.col("text_similarity") >= minimum))
    assert as_map(P.text_score_pairs_v3(df, df, minimum)) == v3
    words = sorted({w for t in texts for w in t.split()})
    crossed = spark.createDataFrame(list(itertools.product(words, words)), "w1 string, w2 string")
    near = {
        (r.w1, r.w2): r.word_score
        for r in P._scored_words(crossed, P.word_score_v2).collect()
        if round(r.word_score, 2) >= minimum
    }
    expected = {}
    for a, b in itertools.product(texts, texts):
        best = max((near.get((x, y), 0) for x in a.split() for y in b.split()), default=0)
        if best:
            expected[(a, b)] = round(best, 2)
    assert as_map(P.text_score_pairs_v2(df, df, minimum), 2) == pytest.approx(expected)


def test_text_v1_golden(spark):
    df = spark.createDataFrame([("nike", "nike"), ("nike", ""), ("nike", None)], "text1 string, text2 string")
    assert [r.text_similarity for r in P.text_score_v1(df).orderBy(F.desc("text_similarity")).collect()] == [96.5, 0, 0]


def test_blocks_of_words_do_not_change_candidates(spark, texts, monkeypatch):
    df = frame(spark, texts)
    whole = as_map(P.text_score_pairs_v1(df, df, 60.0))
    monkeypatch.setattr(P, "WORD_BLOCK", 5)
    assert as_map(P.text_score_pairs_v1(df, df, 60.0)) == whole


def test_best_marks_with_copies(spark):
    marks = spark.createDataFrame([(i, "nike" if i % 3 else f"mark {i}") for i in range(60)], "mark_id long, mark_text string")
    texts = P.distinct_texts(marks, "mark_text")
    best = P.best_marks(marks, marks, P.containment_score_pairs(texts, texts, 95.0), 4)
    for ref in (1, 2, 4, 58):
        got = [r.cmp_id for r in best.filter(F.col("ref_id") == ref).orderBy("rank").collect()]
        assert got == [i for i in range(60) if i % 3 and i != ref][:4]


@pytest.mark.parametrize("entries", [P.LIST_ENTRIES, 0])
def test_best_marks_ranks_in_the_row(spark, monkeypatch, entries):
    """Lists are sorted once per text: no window over references, same ranks as brute force."""
    monkeypatch.setattr(P, "LIST_ENTRIES", entries)
    names = ["nike", "nikes", "nikee", "puma", "pumas", None, ""]
    marks = spark.createDataFrame([(i, names[i * i % 7]) for i in range(80)], "mark_id long, mark_text string")
    texts = P.distinct_texts(marks, "mark_text")
    pairs = P.containment_score_pairs(texts, texts, 70.0)
    scores = {(r.text1, r.text2): r.text_similarity for r in pairs.collect()}
    rows = [(r.mark_id, r.mark_text) for r in marks.collect()]
    for itself in (True, False):
        best = P.best_marks(marks, marks, pairs, 5, exclude_self=itself)
        assert best._jdf.queryExecution().optimizedPlan().toString().count("row_number") == 0
        want = []
        for i, a in rows:
            near = sorted((-scores[a, b], j) for j, b in rows if (a, b) in scores and not (itself and i == j))
            want += [(i, n, j) for n, (_, j) in enumerate(near[:5], 1)]
        assert sorted((r.ref_id, r["rank"], r.cmp_id) for r in best.collect()) == sorted(want)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 16))
    data[100:200] = data[100]  # a third of the rows are copies
    data[7] = 0.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return K.unit_vectors(spark.createDataFrame(rows, "image_id long, embedding array<double>"))


def hits(df):
    return sorted((r.query_id, r["rank"], r.base_id, r.score) for r in df.collect())


def brute(vectors, k, metric):
    rows = sorted((r.image_id, np.array(r.embedding)) for r in vectors.collect())
    out = []
    for q, qv in rows:
        scored = []
        for b, bv in rows:
            if q != b:
                s = round(float(qv @ bv), 6) if metric == "ip" else round(float(((qv - bv) ** 2).sum()), 6)
                scored.append((-s if metric == "ip" else s, b, s))
        for rank, (_, b, s) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, b, s))
    return sorted(out)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_knn_broadcast_and_blocked(spark, vectors, metric, monkeypatch):
    options = {"query_id": "image_id", "base_id": "image_id", "skip_self": True}
    got = hits(K.knn_join(vectors, vectors, 5, metric, **options))
    expected = brute(vectors, 5, metric)
    assert [h[:3] for h in got] == [h[:3] for h in expected]
    assert [h[3] for h in got] == pytest.approx([h[3] for h in expected], abs=2e-6)
    monkeypatch.setattr(K, "BROADCAST_CELLS", 1)
    assert hits(K.knn_join(vectors, vectors, 5, metric, block_rows=64, **options)) == got


def test_k_larger_than_base(spark, vectors):
    few = vectors.filter("image_id < 4")
    assert len(hits(K.knn_join(few, few, 50, query_id="image_id", base_id="image_id"))) == 16
    assert K.clamp_k(30, 20) == 20 and K.clamp_k(500, 2000, cap=100) == 100


def test_threshold_join(spark, vectors):
    got = K.vector_join(vectors, vectors, min_score=0.9, query_id="image_id", base_id="image_id", skip_self=True)
    assert got.count() == 100 * 99  # only the copies


def test_ivf_equals_exact_with_all_probes(spark, vectors):
    rows = vectors.select(F.concat(F.lit("/p/"), F.col("image_id")).alias("path"), F.col("image_id").alias("index_id"), "embedding")
    index = I.build_vector_index(rows, lists=8)
    exact = hits(K.knn_join(vectors, vectors, 5, query_id="image_id", base_id="image_id"))
    options = {"query_id": "image_id", "block_rows": 32}
    assert hits(K.ivf_knn_join(vectors, index.vectors, index.centroids, 5, probes=8, **options)) == exact
    part = hits(K.ivf_knn_join(vectors, index.vectors, index.centroids, 5, probes=4, **options))
    found = len({h[:1] + h[2:3] for h in part} & {h[:1] + h[2:3] for h in exact}) / len(exact)
    assert found > 0.7


def test_ivf_recall_with_many_lists(spark):
    rng = random.Random(8)
    rows = [(i, f"/p/{i}", [rng.gauss(0, 1) for _ in range(32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "index_id long, path string, embedding array<double>")
    index = I.build_vector_index(df, lists=160)
    queries = K.unit_vectors(df.filter("index_id % 5 = 0"))
    pairs = lambda found: {(r.query_id, r.base_id) for r in found.collect()}
    exact = pairs(K.knn_join(queries, index.vectors, 10, query_id="index_id", base_id="index_id"))
    got = pairs(K.ivf_knn_join(queries, index.vectors, index.centroids, 10, query_id="index_id"))
    assert len(got & exact) >= 0.9 * len(exact)


def test_list_rules():
    assert K.list_count(2000) == 44 and K.list_count(30) == 7 and K.list_count(10**9) == 31622
    assert K.probe_count(4000, most=500) == 500
    assert K.probe_count(44) == 11 and K.probe_count(256) == 32 and K.probe_count(3) == 1


def test_carry_forward_levels(spark):
    rng = random.Random(1)
    rows = [(d, p // 4, p, i, rng.choice([None, None, None, "x", "y"])) for d in range(2) for p in range(12) for i in range(5)]
    df = spark.createDataFrame(rows, "doc int, block int, page int, line int, v string")
    got = carry_forward(df, [("doc", "block", "page"), ("doc", "block"), ("doc",)], ["page", "line"], ["v"])
    expected, last = {}, {}
    for d, _, p, i, v in rows:
        last[d] = v if v is not None else last.get(d)
        expected[(d, p, i)] = last[d]
    assert {(r.doc, r.page, r.line): r.v for r in got.collect()} == expected


def test_top_k_and_first_per_group(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    big = top_k(df, ["g"], [F.desc("id")], 1200)
    assert big.filter("g = 0").agg(F.min("id")).first()[0] == sorted((i for i in range(5000) if i % 3), reverse=True)[1199]
    assert {(r.g, r.id) for r in first_per_group(df, ["g"], ["id"]).collect()} == {(0, 1), (1, 0)}


def test_dense_ids_and_growth(spark, vectors):
    rows = vectors.select(F.concat(F.lit("/p//"), F.lpad(F.col("image_id").cast("string"), 4, "0")).alias("path"), "embedding")
    index = I.build_vector_index(rows.filter("path < '/p//0200'"))
    grown = I.add_vectors(index, rows)
    ids = [r.index_id for r in grown.vectors.orderBy("path").collect()]
    assert ids == list(range(299))
    stats = I.index_stats(grown).first()
    assert (stats.total_vectors, stats.dimension, stats.index_type, stats.nlist) == (299, 16, "Flat", None)


def test_growth_keeps_the_lists(spark, vectors, monkeypatch):
    rows = vectors.select(F.concat(F.lit("/p/"), F.lpad(F.col("image_id").cast("string"), 4, "0")).alias("path"), "embedding")
    index = I.build_vector_index(rows.filter("path < '/p/0200'"), lists=4)
    grown = I.add_vectors(index, rows)
    stats = I.index_stats(grown).first()
    assert (stats.total_vectors, stats.index_type, stats.nlist, stats.nprobe) == (299, "IVF", 4, 1)
    lists = {r.path: r.centroid_id for r in grown.vectors.collect()}
    assert len(lists) == 299 and None not in lists.values()
    monkeypatch.setattr(K, "BROADCAST_CELLS", 1)
    apart = K.nearest_lists(grown.vectors.drop("centroid_id"), index.centroids, 1, "embedding")
    assert {r.path: r.centroid_id for r in apart.collect()} == lists


def test_near_ties_rank_by_the_raw_score(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0 + 1e-8, 0.0])], "image_id long, embedding array<double>")
    best = K.knn_join(base.filter("image_id = 1"), base, 1, query_id="image_id", base_id="image_id").first()
    assert best.base_id == 2
