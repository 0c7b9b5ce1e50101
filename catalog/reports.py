"""Report, scoring, matching and file queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import table, view, with_views
from catalog.sqlparts import knn_ctes
from catalog.vectors import _UNIT, neighbours
from marklens.functions import scoring as S
from marklens.functions import text as T
from marklens.functions.vector import doubles
from marklens.operators import dedup as D
from marklens.operators import matching as M
from marklens.operators import reporting as R
from marklens.operators.knn import unit_vectors
from marklens.plans.balanced import balanced_compare as plan_balanced
from marklens.plans.dashboard import dashboard, stored_view
from marklens.session import cut_lineage, ensure_checkpoint_dir
from marklens.sources import cache as cache_table
from marklens.sources import files as file_source


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair results fused from component scores, named after the part."""
    scores = view(spark, sf_dir, "scores")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cmp_id"), F.col("p_name").alias("logo_name"), F.col("p_type").alias("text2")
    )
    image = S.blend_fixed(F.col("vit_similarity"), F.col("color_similarity"))
    return (
        scores.join(part, "cmp_id")
        .withColumn("text1", F.concat(F.lit("ref "), F.col("ref_id").cast("string")))
        .withColumn("image_score", image)
        .withColumn("final_similarity", F.round(S.final_strict(F.col("image_score"), F.col("text_similarity")), 6))
        .withColumn("infringement_detected", S.is_infringement(F.col("final_similarity")))
    )


_FINAL = """CASE WHEN {i} >= 75 AND {t} < 30 THEN {i} * 0.7::DOUBLE + {t} * 0.3::DOUBLE
  WHEN {t} >= 75 AND {i} < 30 THEN {i} * 0.3::DOUBLE + {t} * 0.7::DOUBLE ELSE {i} * 0.5::DOUBLE + {t} * 0.5::DOUBLE END"""
_RES = f"""{with_views("scores")},
ri AS (SELECT s.*, p_name AS logo_name, p_type AS text2, concat('ref ', ref_id::VARCHAR) AS text1,
              vit_similarity * 0.7::DOUBLE + color_similarity * 0.3::DOUBLE AS image_score FROM scores s JOIN part ON p_partkey = cmp_id),
rf AS (SELECT *, round({_FINAL.format(i="image_score", t="text_similarity")}, 6) AS final_similarity FROM ri),
res AS (SELECT *, final_similarity >= 70 AS infringement_detected FROM rf)"""


def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blends, fusion rules, flags and labels side by side."""
    s = view(spark, sf_dir, "scores")
    vit, color, text = (F.col(f"{c}_similarity") for c in ("vit", "color", "text"))
    fixed, adaptive = S.blend_fixed(vit, color), S.blend_adaptive(vit, color)
    word = F.when(F.col("cmp_id") % 7 == 0, F.lit("")).otherwise(F.lit("mark"))
    final = S.final_strict(fixed, text)
    return s.select(
        "ref_id",
        "cmp_id",
        F.round(fixed, 6).alias("image_fixed"),
        F.round(adaptive, 6).alias("image_adaptive"),
        F.round(final, 6).alias("final_strict"),
        F.round(S.final_indexed(adaptive, text), 6).alias("final_indexed"),
        F.round(S.final_visual_text(vit, text, word, F.lit("mark")), 6).alias("final_visual_text"),
        S.is_infringement(F.round(final, 6)).alias("infringement_detected"),
        S.clamp_percent(color * 1.5 - 20).alias("clamped"),
        S.confidence_label(F.round(final, 6) / 100).alias("confidence"),
        S.highlight_label(color, 70.0).alias("highlight"),
        S.card_band(color).alias("card"),
    )


_FUSION_SQL = f"""{with_views("scores")},
b AS (SELECT *, vit_similarity AS v, color_similarity AS c, text_similarity AS t,
        vit_similarity * 0.7::DOUBLE + color_similarity * 0.3::DOUBLE AS fx,
        CASE WHEN color_similarity = 0 THEN vit_similarity WHEN vit_similarity < color_similarity
             THEN color_similarity * 0.6::DOUBLE + vit_similarity * 0.4::DOUBLE
             ELSE vit_similarity * 0.75::DOUBLE + color_similarity * 0.25::DOUBLE END AS ad FROM scores),
f AS (SELECT *, {_FINAL.format(i="fx", t="t")} AS fs, {_FINAL.format(i="ad", t="t")} AS fi FROM b)
SELECT ref_id, cmp_id, round(fx, 6) AS image_fixed, round(ad, 6) AS image_adaptive, round(fs, 6) AS final_strict,
  round(CASE WHEN t = 0 THEN ad ELSE fi END, 6) AS final_indexed,
  round(CASE WHEN cmp_id % 7 = 0 THEN v WHEN t > 75 THEN t * 0.8::DOUBLE + v * 0.2::DOUBLE ELSE t * 0.5::DOUBLE + v * 0.5::DOUBLE END, 6) AS final_visual_text,
  round(fs, 6) >= 70 AS infringement_detected, least(greatest(c * 1.5::DOUBLE - 20, 0), 100) AS clamped,
  CASE WHEN round(fs, 6) / 100 >= 0.75 THEN 'Very High' WHEN round(fs, 6) / 100 >= 0.55 THEN 'High'
       WHEN round(fs, 6) / 100 >= 0.35 THEN 'Medium' WHEN round(fs, 6) / 100 >= 0.15 THEN 'Low' ELSE 'Very Low' END AS confidence,
  CASE WHEN c >= 70 THEN 'high' WHEN c >= 50 THEN 'medium' ELSE 'none' END AS highlight,
  CASE WHEN c >= 70 THEN 'high' WHEN c >= 30 THEN 'medium' ELSE 'low' END AS card FROM f"""


def per_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_reference(results(spark, sf_dir))


_PER_REFERENCE_SQL = f"""{_RES} SELECT ref_id, count(*) AS result_count,
  count(*) FILTER (infringement_detected) AS infringement_count FROM res GROUP BY ref_id"""


def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(results(spark, sf_dir))


_SUMMARY_SQL = f"""{_RES} SELECT ref_id, grouping(ref_id)::INT AS is_total, count(*) AS total_comparisons,
  count(*) FILTER (infringement_detected) AS infringements,
  round(count(*) FILTER (infringement_detected) * 100.0::DOUBLE / count(*), 2) AS infringement_rate
FROM res GROUP BY ROLLUP (ref_id)"""


def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = R.dashboard_stats(results(spark, sf_dir), 40.0)
    return stats.withColumns({c: F.round(c, 6) for c in ("mean_final", "mean_visual")})


_STATS_SQL = f"""{_RES} SELECT count(*) AS total, count(*) FILTER (s) AS shown, count(*) FILTER (s AND d) AS infringements,
  round(avg(final_similarity) FILTER (s), 6) AS mean_final, round(avg(vit_similarity) FILTER (s), 6) AS mean_visual,
  count(*) FILTER (s AND final_similarity >= 70) AS high_similarity, count(*) FILTER (s AND NOT d) AS clear,
  round(count(*) FILTER (s AND d) * 100.0::DOUBLE / count(*) FILTER (s), 2) AS infringement_rate
FROM (SELECT *, final_similarity >= 40 AS s, infringement_detected AS d FROM res)"""

_SHOW = ("ref_id", "cmp_id", "logo_name", "final_similarity", "infringement_detected")


def dashboard_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of the infringing results that mention "ring"."""
    rows, _, _ = dashboard(
        results(spark, sf_dir), term="RING", status="infringement", min_similarity=50.0, page=3
    )
    return rows.select(*_SHOW)


_HIT = "(contains(lower(logo_name), 'ring') OR contains(lower(text1), 'ring') OR contains(lower(text2), 'ring'))"
_PAGE_SQL = f"""{_RES} SELECT ref_id, cmp_id, logo_name, final_similarity, infringement_detected FROM res
WHERE final_similarity >= 50 AND {_HIT} AND infringement_detected
ORDER BY final_similarity DESC, ref_id, cmp_id LIMIT 6 OFFSET 12"""


def dashboard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard(results(spark, sf_dir), status="clear", min_similarity=50.0)[1]


_PAGES_SQL = f"""{_RES} SELECT ceil(count(*) / 6.0::DOUBLE)::BIGINT AS pages FROM res
WHERE final_similarity >= 50 AND NOT infringement_detected"""


def dashboard_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last page of the clear results, read from the stored order, with positions."""
    folder = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages = stored_view(results(spark, sf_dir), folder, status="clear")
    return pages.page(max(1, pages.page_count())).select("position", *_SHOW)


_LAST_PAGE_SQL = f"""{_RES} SELECT position, ref_id, cmp_id, logo_name, final_similarity, infringement_detected FROM
(SELECT *, row_number() OVER (ORDER BY coalesce(final_similarity, 0) DESC, ref_id, cmp_id) AS position, count(*) OVER () AS n
 FROM res WHERE coalesce(final_similarity, 0) >= 0 AND NOT infringement_detected)
WHERE position > (n - 1) // 6 * 6"""


def top_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_results(results(spark, sf_dir), 20, "vit_similarity").select("vit_similarity", *_SHOW)


_TOP_SQL = f"""{_RES} SELECT vit_similarity, ref_id, cmp_id, logo_name, final_similarity, infringement_detected
FROM res ORDER BY vit_similarity DESC, ref_id, cmp_id LIMIT 20"""


def reference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.rank_in_reference(results(spark, sf_dir), 10)
    return ranked.select(*_SHOW, F.col("rank").cast("long").alias("rank"))


_RANKING_SQL = f"""{_RES} SELECT ref_id, cmp_id, logo_name, final_similarity, infringement_detected, rank FROM
(SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY final_similarity DESC, logo_name, cmp_id) AS rank FROM res) WHERE rank <= 10"""


def all_infringements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.infringements(results(spark, sf_dir)).select(*_SHOW)


_INFRINGEMENTS_SQL = f"""{_RES} SELECT ref_id, cmp_id, logo_name, final_similarity, infringement_detected
FROM res WHERE infringement_detected"""


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infringing pairs through the nested report and back."""
    return R.flatten_report(R.to_report(R.filter_status(results(spark, sf_dir), "infringement"))).select(*_SHOW)


# --- matching ----------------------------------------------------------------


def _descriptor_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nearest images as pairs; eight keypoints of eight numbers per image."""
    vectors = view(spark, sf_dir, "vectors")
    pairs = cut_lineage(neighbours(unit_vectors(vectors)).select("ref_id", "cmp_id"))
    keypoints = vectors.select("image_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("kp_id"))
    return pairs, keypoints.select(
        "image_id", "kp_id", doubles(F.slice("embedding", F.col("kp_id") * 8 + 1, F.lit(8))).alias("descriptor")
    )


_DESC = f"""{with_views("vectors")}, {_UNIT}, {knn_ctes("unit", 10)},
kp AS (SELECT image_id, k AS kp_id, list_slice(embedding, k * 8 + 1, k * 8 + 8)::DOUBLE[] AS d
       FROM vectors, (SELECT unnest(range(0, 8)) AS k))"""


def ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ratio_match(*_descriptor_pairs(spark, sf_dir))


_RATIO_SQL = f"""{_DESC},
x AS (SELECT ref_id, cmp_id, a.kp_id AS k1, list_distance(a.d, b.d) AS d, b.kp_id AS k2
      FROM nn JOIN kp a ON a.image_id = ref_id JOIN kp b ON b.image_id = cmp_id),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_id, cmp_id, k1 ORDER BY d, k2) AS rn FROM x),
g AS (SELECT ref_id, cmp_id, k1, max(CASE WHEN rn = 1 THEN d END) AS d1, max(CASE WHEN rn = 2 THEN d END) AS d2
      FROM r WHERE rn <= 2 GROUP BY ALL)
SELECT ref_id, cmp_id, (count(*) FILTER (d1 < 0.75 * d2))::BIGINT AS good_matches FROM g GROUP BY ref_id, cmp_id"""


def mutual_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary codes are the sign patterns of the descriptors."""
    pairs, keypoints = _descriptor_pairs(spark, sf_dir)
    code = F.aggregate(
        F.transform(
            "descriptor", lambda x, i: F.when(x > 0, F.pow(F.lit(2), i)).otherwise(0.0)
        ),
        F.lit(0.0),
        lambda acc, x: acc + x,
    ).cast("long")
    codes = keypoints.select("image_id", "kp_id", code.alias("code"))
    return M.mutual_match(pairs, codes, 4)


_MUTUAL_SQL = f"""{_DESC},
kc AS (SELECT image_id, kp_id, list_sum(list_transform(d, lambda x, i: CASE WHEN x > 0 THEN 1 << (i - 1)::INT ELSE 0 END))::BIGINT AS code FROM kp),
x AS (SELECT ref_id, cmp_id, a.kp_id AS kp1, b.kp_id AS kp2, bit_count(xor(a.code, b.code))::INT AS d
      FROM nn JOIN kc a ON a.image_id = ref_id JOIN kc b ON b.image_id = cmp_id),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_id, cmp_id, kp1 ORDER BY d, kp2) AS f,
             row_number() OVER (PARTITION BY ref_id, cmp_id, kp2 ORDER BY d, kp1) AS b FROM x)
SELECT ref_id, cmp_id, kp1::INT AS kp1, kp2::INT AS kp2, d AS distance FROM r WHERE f = 1 AND b = 1 AND d < 4"""


def mutual_match_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 256 bits: comparisons of the vector's values at four distances."""
    vectors = view(spark, sf_dir, "vectors")
    pairs = cut_lineage(neighbours(unit_vectors(vectors)).select("ref_id", "cmp_id"))
    at = lambda i: F.get("embedding", i.cast("int"))

    def word(w):
        first = lambda i: (w % 2) * 32 + i
        other = lambda i: F.pmod(first(i) + 1 + F.col("kp_id") * 4 + F.floor(w / 2), F.lit(64))
        bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(at(first(i)) > at(other(i)), F.pow(F.lit(2.0), i)).otherwise(0.0))
        return F.aggregate(bits, F.lit(0.0), lambda acc, x: acc + x).cast("long")

    keypoints = vectors.select("image_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("kp_id"))
    codes = keypoints.select("image_id", "kp_id", F.transform(F.sequence(F.lit(0), F.lit(7)), word).alias("code"))
    return M.mutual_match(pairs, codes, 100)


_MUTUAL_WIDE_SQL = f"""{with_views("vectors")}, {_UNIT}, {knn_ctes("unit", 10)},
kw AS (SELECT image_id, k AS kp_id, list_transform(range(0, 8), lambda w: list_sum(list_transform(range(0, 32),
         lambda i: CASE WHEN embedding[(w % 2) * 32 + i + 1] > embedding[((w % 2) * 32 + i + 1 + k * 4 + w // 2) % 64 + 1] THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT) AS code
       FROM vectors, (SELECT unnest(range(0, 8)) AS k)),
x AS (SELECT ref_id, cmp_id, a.kp_id AS kp1, b.kp_id AS kp2,
        list_sum(list_transform(range(1, 9), lambda w: bit_count(xor(a.code[w], b.code[w]))))::INT AS d
      FROM nn JOIN kw a ON a.image_id = ref_id JOIN kw b ON b.image_id = cmp_id),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_id, cmp_id, kp1 ORDER BY d, kp2) AS f,
             row_number() OVER (PARTITION BY ref_id, cmp_id, kp2 ORDER BY d, kp1) AS b FROM x)
SELECT ref_id, cmp_id, kp1::INT AS kp1, kp2::INT AS kp2, d AS distance FROM r WHERE f = 1 AND b = 1 AND d < 100"""


def _of_pairs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input whose rows are grouped by pair, dealt by pair."""
    return view(spark, sf_dir, name, "l_suppkey", "l_partkey")


def feature_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "match_counts")
    scored = M.method_scores(counts)
    simple = S.inlier_score(F.col("good_matches"), F.col("inliers"), F.col("kp1"), F.col("kp2"))
    return scored.select(
        "ref_id", "cmp_id", "method", F.round("score", 6).alias("score"), F.round(simple, 6).alias("inlier_score")
    )


_FEATURE = """lim AS (SELECT *, CASE method WHEN 'SIFT' THEN 5 WHEN 'ORB' THEN 8 ELSE 6 END AS nk,
    CASE method WHEN 'SIFT' THEN 4 WHEN 'ORB' THEN 5 ELSE 4 END AS ng, CASE method WHEN 'SIFT' THEN 4 ELSE 5 END AS sg,
    CASE WHEN good_matches = 0 THEN 0 ELSE inliers::DOUBLE / good_matches END AS r0 FROM match_counts),
l2 AS (SELECT *, CASE WHEN r0 < 0.5 THEN r0 * 0.8::DOUBLE ELSE r0 END AS rt FROM lim),
l3 AS (SELECT *, (rt * 0.4::DOUBLE + least(1, good_matches / 20.0::DOUBLE) * 0.35::DOUBLE + least(1, inliers / 15.0::DOUBLE) * 0.25::DOUBLE)
   * CASE WHEN rt > 0.8 AND inliers > 10 THEN 1.3::DOUBLE WHEN rt > 0.7 AND inliers > 8 THEN 1.25::DOUBLE WHEN rt > 0.6 AND inliers > 5 THEN 1.2::DOUBLE
          WHEN rt > 0.5 AND inliers > 3 THEN 1.15::DOUBLE WHEN rt < 0.4 THEN 0.9::DOUBLE ELSE 1 END
   * CASE WHEN (kp1 + kp2) / 2.0::DOUBLE > 150 THEN 1.1::DOUBLE WHEN (kp1 + kp2) / 2.0::DOUBLE > 100 THEN 1.05::DOUBLE ELSE 1 END AS sc FROM l2),
fs AS (SELECT *, CASE WHEN least(kp1, kp2) < nk OR good_matches < ng OR good_matches < sg OR inliers < 3 THEN 0.0::DOUBLE
             ELSE least(0.95::DOUBLE, greatest(0, sc)) END AS score FROM l3)"""
_FEATURE_SQL = f"""{with_views("match_counts")}, {_FEATURE}
SELECT ref_id, cmp_id, method, round(score, 6) AS score,
  round(CASE WHEN good_matches >= 10 AND least(kp1, kp2) >= 2 THEN least(1.0::DOUBLE, inliers / 50.0::DOUBLE) ELSE 0 END, 6) AS inlier_score FROM fs"""


def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = M.best_method(M.method_scores(_of_pairs(spark, sf_dir, "match_counts")))
    return best.withColumn("feature_score", F.round("feature_score", 6))


_BEST = """bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, cmp_id ORDER BY score DESC,
   CASE method WHEN 'SIFT' THEN 0 WHEN 'ORB' THEN 1 ELSE 2 END) AS rn FROM fs) WHERE rn = 1)"""
_BEST_SQL = f"""{with_views("match_counts")}, {_FEATURE}, {_BEST} SELECT ref_id, cmp_id, method AS best_method,
  round(score, 6) AS feature_score, inliers AS inlier_matches, kp1 AS keypoints_img1, kp2 AS keypoints_img2 FROM bm"""


def template_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = M.template_score(_of_pairs(spark, sf_dir, "observations"))
    return scored.withColumn("template_score", F.round("template_score", 6))


_TEMPLATE = """tb AS (SELECT ref_id, cmp_id, max(CASE WHEN mv > 0.25 THEN CASE WHEN em > 0.3 THEN mv * 0.7::DOUBLE + em * 0.3::DOUBLE
   WHEN mv > 0.6 THEN mv * 0.9::DOUBLE END END) AS m FROM observations GROUP BY ref_id, cmp_id),
ts AS (SELECT ref_id, cmp_id, CASE WHEN m IS NULL OR m < 0.3 THEN 0 WHEN m < 0.6 THEN (m - 0.3::DOUBLE) * 0.5::DOUBLE / 0.3::DOUBLE
   ELSE (m - 0.6::DOUBLE) * 0.45::DOUBLE / 0.4::DOUBLE + 0.5::DOUBLE END AS template_score FROM tb)"""
_TEMPLATE_SQL = f"""{with_views("observations")}, {_TEMPLATE} SELECT ref_id, cmp_id, round(template_score, 6) AS template_score FROM ts"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the observations as image sizes: 64, 128, 256 and so on."""
    obs = _of_pairs(spark, sf_dir, "observations")
    return obs.withColumn("size", F.expr("shiftleft(64, step)"))


def ssim_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ssim_score(_sizes(spark, sf_dir)).withColumn("ssim_score", F.round("ssim_score", 6))


_SSIM = """sg AS (SELECT ref_id, cmp_id, count(*) AS c, sum(mv * CASE step WHEN 1 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END) AS w, avg(mv) AS a, max(step) AS ms
   FROM observations WHERE mv IS NOT NULL GROUP BY ref_id, cmp_id),
sx AS (SELECT ref_id, cmp_id, CASE WHEN c = 3 AND ms = 2 THEN w ELSE a END AS x FROM sg),
ssm AS (SELECT ref_id, cmp_id, CASE WHEN x < 0.3 THEN 0 ELSE least(0.9::DOUBLE, (x - 0.3::DOUBLE) / 0.7::DOUBLE * 0.9::DOUBLE) END AS ssim_score FROM sx)"""
_SSIM_SQL = f"""{with_views("observations")}, {_SSIM} SELECT ref_id, cmp_id, round(ssim_score, 6) AS ssim_score FROM ssm"""


def shape_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shape_score(_of_pairs(spark, sf_dir, "contours")).withColumn("shape_score", F.round("shape_score", 6))


_SHAPE = """d1 AS (SELECT ref_id, cmp_id, c1 FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, cmp_id ORDER BY area1 DESC, c1) AS rn
   FROM (SELECT DISTINCT ref_id, cmp_id, c1, area1 FROM contours)) WHERE rn <= 3),
d2 AS (SELECT ref_id, cmp_id, c2 FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, cmp_id ORDER BY area2 DESC, c2) AS rn
   FROM (SELECT DISTINCT ref_id, cmp_id, c2, area2 FROM contours)) WHERE rn <= 3),
sp AS (SELECT ref_id, cmp_id, max(CASE WHEN shape IS NULL THEN (1 / (1 + hu) + least(area1, area2)::DOUBLE / greatest(area1, area2)) / 2
   ELSE (1 / (1 + hu) + 1 / (1 + shape) + least(area1, area2)::DOUBLE / greatest(area1, area2)) / 3 END) AS b
   FROM contours JOIN d1 USING (ref_id, cmp_id, c1) JOIN d2 USING (ref_id, cmp_id, c2) GROUP BY ref_id, cmp_id),
shp AS (SELECT ref_id, cmp_id, CASE WHEN b > 0.6 THEN least(0.85::DOUBLE, b * 1.2::DOUBLE) WHEN b > 0.4 THEN least(0.7::DOUBLE, b * 1.1::DOUBLE) ELSE b END AS shape_score FROM sp)"""
_SHAPE_SQL = f"""{with_views("contours")}, {_SHAPE} SELECT ref_id, cmp_id, round(shape_score, 6) AS shape_score FROM shp"""


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    # scores are short decimals that may lie half-way; 1e-9 settles those alike in SQL
    return plan_balanced(
        _of_pairs(spark, sf_dir, "match_counts"),
        _of_pairs(spark, sf_dir, "observations"),
        _sizes(spark, sf_dir),
        _of_pairs(spark, sf_dir, "contours"),
    ).withColumn("similarity_score", F.round(F.col("similarity_score") + 1e-9, 6))


def balanced_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balanced(spark, sf_dir)


_BALANCED = f"""{with_views("match_counts", "observations", "contours")}, {_FEATURE}, {_BEST}, {_TEMPLATE}, {_SSIM}, {_SHAPE},
ba AS (SELECT ref_id, cmp_id, method, coalesce(inliers, 0)::INT AS inliers, coalesce(kp1, 0)::INT AS kp1, coalesce(kp2, 0)::INT AS kp2, coalesce(score, 0) AS f, coalesce(template_score, 0) AS t, coalesce(ssim_score, 0) AS s, coalesce(shape_score, 0) AS h
  FROM bm FULL JOIN ts USING (ref_id, cmp_id) FULL JOIN ssm USING (ref_id, cmp_id) FULL JOIN shp USING (ref_id, cmp_id)),
bb AS (SELECT *, (f > 0.6)::INT + (t > 0.6)::INT + (s > 0.6)::INT + (h > 0.6)::INT AS ns,
   (f > 0.35)::INT + (t > 0.35)::INT + (s > 0.35)::INT + (h > 0.35)::INT AS ng2, (f > 0.1)::INT + (t > 0.1)::INT + (s > 0.1)::INT + (h > 0.1)::INT AS nw FROM ba),
bc AS (SELECT *, round(1e-9::DOUBLE + least(0.95::DOUBLE, (f * 0.45::DOUBLE + t * 0.25::DOUBLE + s * 0.2::DOUBLE + h * 0.1::DOUBLE)
   * CASE WHEN ns >= 2 THEN 1.25::DOUBLE WHEN ns >= 1 OR ng2 >= 2 THEN 1.15::DOUBLE WHEN ng2 >= 1 OR nw >= 2 THEN 1.08::DOUBLE ELSE 1 END
   * CASE WHEN f > 0.4 AND t > 0.3 THEN 1.12::DOUBLE WHEN f > 0.5 AND s > 0.4 THEN 1.08::DOUBLE ELSE 1 END
   * CASE WHEN inliers >= 5 THEN 1.1::DOUBLE WHEN inliers > 0 THEN 1.05::DOUBLE ELSE 1 END), 6) AS x FROM bb)"""
_BALANCED_SQL = f"""{_BALANCED} SELECT ref_id, cmp_id, x AS similarity_score, kp1 AS keypoints_img1, kp2 AS keypoints_img2,
  inliers AS inlier_matches, method AS best_method,
  CASE WHEN x >= 0.75 THEN 'Very High' WHEN x >= 0.55 THEN 'High' WHEN x >= 0.35 THEN 'Medium' WHEN x >= 0.15 THEN 'Low' ELSE 'Very Low' END AS confidence_level FROM bc"""


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_bands(_balanced(spark, sf_dir)).withColumn("average_score", F.round("average_score", 6))


_BANDS_SQL = f"""{_BALANCED} SELECT count(*) AS results, round(avg(x), 6) AS average_score, count(*) FILTER (x >= 0.75) AS very_high,
  count(*) FILTER (x >= 0.55 AND x < 0.75) AS high, count(*) FILTER (x >= 0.35 AND x < 0.55) AS medium,
  count(*) FILTER (x >= 0.15 AND x < 0.35) AS low, count(*) FILTER (x < 0.15) AS very_low FROM bc"""


# --- files -------------------------------------------------------------------


def dedup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_files(view(spark, sf_dir, "files"))


# whole contents, grouped as they are; a signature is the size and the base name
_DEDUP = f"""{with_views("files")},
s AS (SELECT length, parse_filename(path) AS name, content, min(path) AS path, count(*) AS n FROM files GROUP BY ALL),
k AS (SELECT length, content, min(path) AS path, count(*) AS n FROM s GROUP BY length, content)"""
_DEDUP_SQL = f"""{_DEDUP} SELECT path, length FROM k"""


def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_report(view(spark, sf_dir, "files"))


_DEDUP_REPORT_SQL = f"""{_DEDUP}
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files) - (SELECT count(*) FROM s) AS signature_duplicates,
  (SELECT count(*) FROM s) - (SELECT count(*) FROM k) AS content_duplicates, (SELECT count(*) FROM k) AS unique_files"""


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose signature is not cached yet (two of three are cached)."""
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/logos/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("n_chars").alias("length"),
        "doc_id",
    )
    keyed = cache_table.with_signature(files, ("path", "length"))
    cached = keyed.filter(F.col("doc_id") % 3 != 0).select("signature")
    return cache_table.misses(keyed, cached).select("path", "length")


_CACHE_SQL = """SELECT concat('/logos/', doc_id::VARCHAR) AS path, n_chars AS length FROM documents WHERE doc_id % 3 = 0"""


def cache_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths through the feature cache: two runs, the cache as each of them left it."""
    folder = f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/logos/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"), "doc_id", "text"
    )

    def compute(df: DataFrame) -> DataFrame:
        return df.select("signature", "path", F.length("text").cast("long").alias("feature"))

    columns = ("path", "length")
    cache_table.with_feature_cache(files.filter("doc_id % 3 <> 0"), folder, compute, columns)
    cache_table.with_feature_cache(files, folder, compute, columns)
    last = cache_table.cache_version(spark, folder)
    parts = [
        cache_table.read_cache(spark, folder, v).select(F.lit(v).cast("long").alias("version"), "path", "feature")
        for v in range(last + 1)
    ]
    return parts[0].unionByName(parts[-1])


_CACHE_VERSIONS_SQL = """SELECT v.version, concat('/logos/', doc_id::VARCHAR) AS path, length(text)::BIGINT AS feature
FROM documents JOIN (VALUES (0::BIGINT), (1::BIGINT)) v(version) ON v.version = 1 OR doc_id % 3 <> 0"""


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base name and normal form of untidy paths."""
    messy = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("/logos//"), F.col("source"), F.lit("/./x/../"), F.col("doc_id").cast("string"), F.lit(".txt/")
        ).alias("raw"),
    )
    return messy.select(
        "doc_id", T.normal_path(F.col("raw")).alias("path"), T.base_name(T.normal_path(F.col("raw"))).alias("name")
    )


_PATHS_SQL = """SELECT doc_id, concat('/logos/', source, '/', doc_id::VARCHAR, '.txt') AS path, concat(doc_id::VARCHAR, '.txt') AS name FROM documents"""


def dataset_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every table file of the folder and their total."""
    return file_source.dataset_footprint(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        score_fusion, per_reference, summary_rollup, dashboard_stats, dashboard_page, dashboard_pages, dashboard_last_page,
        top_results, reference_ranking, all_infringements, report_roundtrip, ratio_match, mutual_match, mutual_match_wide,
        feature_score, best_method, template_score, ssim_score, shape_score, balanced_compare, score_bands,
        dedup_files, dedup_report, cache_misses, cache_versions, path_names, dataset_footprint,
    )
}
ORACLE = {
    "score_fusion": _FUSION_SQL,
    "per_reference": _PER_REFERENCE_SQL,
    "summary_rollup": _SUMMARY_SQL,
    "dashboard_stats": _STATS_SQL,
    "dashboard_page": _PAGE_SQL,
    "dashboard_pages": _PAGES_SQL,
    "dashboard_last_page": _LAST_PAGE_SQL,
    "top_results": _TOP_SQL,
    "reference_ranking": _RANKING_SQL,
    "all_infringements": _INFRINGEMENTS_SQL,
    "report_roundtrip": _INFRINGEMENTS_SQL,
    "ratio_match": _RATIO_SQL,
    "mutual_match": _MUTUAL_SQL,
    "mutual_match_wide": _MUTUAL_WIDE_SQL,
    "feature_score": _FEATURE_SQL,
    "best_method": _BEST_SQL,
    "template_score": _TEMPLATE_SQL,
    "ssim_score": _SSIM_SQL,
    "shape_score": _SHAPE_SQL,
    "balanced_compare": _BALANCED_SQL,
    "score_bands": _BANDS_SQL,
    "dedup_files": _DEDUP_SQL,
    "dedup_report": _DEDUP_REPORT_SQL,
    "cache_misses": _CACHE_SQL,
    "cache_versions": _CACHE_VERSIONS_SQL,
    "path_names": _PATHS_SQL,
}
