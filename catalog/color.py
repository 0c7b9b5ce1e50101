"""Colour queries: histograms, palettes, colour vectors and palette scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import sqlparts as Q
from catalog.fixtures import duck, table, view
from marklens.functions import color as C
from marklens.operators import palette as P
from marklens.operators import pixels as X
from marklens.operators.kmeans import kmeans_palette
from marklens.operators.knn import knn_join
from marklens.plans import color as J
from marklens.plans.sanity import sanity_report as plan_sanity_report
from marklens.session import cut_lineage

N_COLORS, NEAREST = 8, 10


def palettes(spark: SparkSession, sf_dir: str, pixels: str = "pixels") -> DataFrame:
    """Top quantised colours of each image with their share of those, as a table."""
    top = X.dominant_colors(view(spark, sf_dir, pixels), N_COLORS)
    total = top.groupBy("image_id").agg(F.sum("n").alias("_t"))
    palette = top.join(total, "image_id").select(
        "image_id",
        F.col("slot").cast("int").alias("slot"),
        *"rgb",
        (F.col("n") / F.col("_t")).alias("weight"),
    )
    return cut_lineage(palette)


def _near(vectors: DataFrame) -> DataFrame:
    hits = knn_join(
        vectors, vectors, NEAREST, "l2", query_id="image_id", base_id="image_id", skip_self=True
    )
    return hits.select(
        F.col("query_id").alias("ref_id"),
        F.col("base_id").alias("cmp_id"),
        F.col("rank").cast("long").alias("rank"),
    )


def color_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of images with near palette vectors, and the palettes."""
    palette = palettes(spark, sf_dir)
    return cut_lineage(_near(P.lab_vector(palette)).select("ref_id", "cmp_id")), palette


_PAL = f"WITH {Q.palette_ctes('pixels', N_COLORS)}"
_LABVEC = f"""lv AS MATERIALIZED {Q.lab("pal", "r", "g", "b", "k_")},
labv AS (SELECT image_id, (flatten(list([k_l, k_a, k_b, weight * 100] ORDER BY weight DESC, slot))
                           || list_resize([]::DOUBLE[], 40, 0))[1:40] AS embedding FROM lv GROUP BY image_id)"""
_PAIRS = f"{_PAL}, {_LABVEC}, {Q.knn_ctes('labv', NEAREST, 'nn', 'l2')}, cp AS (SELECT ref_id, cmp_id FROM nn)"


def dominant_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = X.dominant_colors(view(spark, sf_dir, "pixels"))
    return top.select("image_id", F.col("slot").cast("long").alias("slot"), *"rgb", "n")


_DOMINANT_SQL = f"""{_PAL} SELECT image_id, slot, r, g, b, n FROM hr WHERE slot <= 5"""


def hsv_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.hsv_histogram(view(spark, sf_dir, "pixels")).withColumn("share", F.round("share", 6))


_HSV = f"""hp AS MATERIALIZED {Q.hsv("px")},
hb AS (SELECT image_id, 'h' AS channel, floor(h180 * 50 / 180)::INT AS bin FROM hp
  UNION ALL SELECT image_id, 's', floor(s255 * 50 / 256)::INT FROM hp
  UNION ALL SELECT image_id, 'v', floor(mx_ * 50 / 256)::INT FROM hp),
hc AS (SELECT image_id, channel, bin, count(*) AS n FROM hb GROUP BY ALL),
hh AS (SELECT image_id, channel, bin, n::DOUBLE / sum(n) OVER (PARTITION BY image_id, channel) AS share FROM hc)"""
_HSV_SQL = f"""{_PAL}, {_HSV} SELECT image_id, channel, bin, round(share, 6) AS share FROM hh"""


def guarded_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = X.color_histogram(view(spark, sf_dir, "pixels"))
    kept = X.guarded_filter(hist, "image_id", X.logo_pixel_guards(N_COLORS))
    return kept.groupBy("image_id").agg(
        F.sum("n").alias("pixels"), F.sum(F.col("n") * (F.col("r") + F.col("g") + F.col("b"))).alias("brightness")
    )


_GUARDED_SQL = f"""{_PAL},
g0 AS MATERIALIZED {Q.hsv("px")},
g1 AS (SELECT *, r + g + b > 50 AND r + g + b < 700 AS p1 FROM g0),
g2 AS (SELECT * FROM (SELECT *, count(*) FILTER (p1) OVER (PARTITION BY image_id) AS c1 FROM g1) WHERE p1 OR c1 <= 120),
g3 AS (SELECT * FROM (SELECT *, count(*) FILTER (s255 > 40 AND mx_ > 50) OVER (PARTITION BY image_id) AS c2 FROM g2)
       WHERE (s255 > 40 AND mx_ > 50) OR c2 <= 64),
g4 AS (SELECT * FROM (SELECT *, count(*) FILTER (sd_ > 15) OVER (PARTITION BY image_id) AS c3 FROM g3)
       WHERE sd_ > 15 OR c3 <= 40)
SELECT image_id, count(*) AS pixels, sum(r + g + b)::BIGINT AS brightness FROM g4 GROUP BY image_id"""


def pixel_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels left per image under each mask."""
    pixels = view(spark, sf_dir, "pixels_rgba")
    masks = {
        "alpha_100": X.alpha_mask(pixels, 100),
        "alpha_128": X.alpha_mask(pixels, 128),
        "background": X.background_mask(pixels),
        "not_white_gray": X.background_mask(pixels, low=None),
        "chroma": X.chroma_filter(pixels),
        "non_white": X.non_white(pixels),
    }
    parts = [
        df.groupBy("image_id").agg(F.count("*").alias("pixels")).withColumn("mask", F.lit(name))
        for name, df in masks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_LUMA = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"
_MASKS = {
    "alpha_100": "a > 100",
    "alpha_128": "a > 128",
    "background": f"{_LUMA} BETWEEN 15 AND 240",
    "not_white_gray": f"{_LUMA} < 240",
    "chroma": "sp_ > 30 AND mean_ > 25 AND mean_ < 230 AND sd_ > 10",
    "non_white": "least(r, g, b) < 230",
}
_MASKS_SQL = (
    f"WITH px AS ({duck('pixels_rgba')}), hp AS {Q.hsv('px')} "
    + " UNION ALL ".join(
        f"SELECT image_id, count(*) AS pixels, '{name}' AS mask FROM hp WHERE {test} GROUP BY image_id"
        for name, test in _MASKS.items()
    )
)


def kmeans_palette_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of k-means with eight colours per image."""
    clusters = kmeans_palette(X.color_histogram(view(spark, sf_dir, "pixels")), N_COLORS, rounds=2)
    return clusters.select(
        "image_id",
        F.col("slot").cast("long").alias("slot"),
        *[F.round(f"x{i}", 6).alias(c) for i, c in enumerate("rgb")],
        "n",
        F.round("weight", 6).alias("weight"),
    )


def _kmeans_sql(k: int, rounds: int) -> str:
    parts = [
        f"px AS ({duck('pixels')})",
        "h AS (SELECT image_id, r, g, b, count(*) AS n FROM px GROUP BY ALL)",
        f"""c0 AS (SELECT image_id, j, r::DOUBLE AS x, g::DOUBLE AS y, b::DOUBLE AS z FROM
            (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS j FROM h) WHERE j <= {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS (SELECT image_id, r, g, b, n, arg_min(j, (d, j)) AS j FROM
            (SELECT h.*, c.j, (r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z) AS d
             FROM h JOIN c{i} c ON h.image_id = c.image_id) GROUP BY image_id, r, g, b, n)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS (SELECT c.image_id, c.j, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.z, c.z) AS z
                FROM c{i} c LEFT JOIN (SELECT image_id, j, sum(n * r)::DOUBLE / sum(n) AS x, sum(n * g)::DOUBLE / sum(n) AS y,
                  sum(n * b)::DOUBLE / sum(n) AS z FROM a{i} GROUP BY image_id, j) m ON c.image_id = m.image_id AND c.j = m.j)"""
            )
    return (
        "WITH " + ",\n".join(parts) + f""",
s AS (SELECT image_id, j, sum(n)::BIGINT AS n FROM a{rounds} GROUP BY image_id, j)
SELECT s.image_id, row_number() OVER (PARTITION BY s.image_id ORDER BY n DESC, s.j) AS slot,
       round(x, 6) AS r, round(y, 6) AS g, round(z, 6) AS b, n,
       round(n::DOUBLE / sum(n) OVER (PARTITION BY s.image_id), 6) AS weight
FROM s JOIN c{rounds} c ON s.image_id = c.image_id AND s.j = c.j"""
    )


def _shown_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "image_id",
        F.col("slot").cast("long").alias("slot"),
        *[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(3)],
        "n",
        F.round("weight", 6).alias("weight"),
    )


def kmeans_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of k-means with six colours per image in LAB."""
    hist = C.with_lab(X.color_histogram(view(spark, sf_dir, "pixels")))
    return _shown_clusters(kmeans_palette(hist, 6, rounds=3, space=("lab_l", "lab_a", "lab_b")))


def kmeans_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of k-means with a colour per hundred pixels, eight at most."""
    hist = X.color_histogram(view(spark, sf_dir, "pixels"))
    return _shown_clusters(kmeans_palette(hist, F.expr("total div 100"), rounds=3, max_k=8))


def _kmeans_space_sql(points: str, k: str, rounds: int) -> str:
    parts = [
        f"px AS ({duck('pixels')})",
        "h0 AS (SELECT image_id, r, g, b, count(*) AS n FROM px GROUP BY ALL)",
        f"h AS MATERIALIZED ({points})",
        f"""c0 AS (SELECT image_id, j, p AS x, q AS y, s AS z FROM
            (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS j,
                    sum(n) OVER (PARTITION BY image_id) AS total FROM h) WHERE j <= {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT image_id, p, q, s, n, arg_min(j, (d, j)) AS j FROM
            (SELECT h.*, c.j, (p - x) * (p - x) + (q - y) * (q - y) + (s - z) * (s - z) AS d
             FROM h JOIN c{i} c ON h.image_id = c.image_id) GROUP BY image_id, r, g, b, p, q, s, n)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS (SELECT c.image_id, c.j, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.z, c.z) AS z
                FROM c{i} c LEFT JOIN (SELECT image_id, j, sum(n * p) / sum(n) AS x, sum(n * q) / sum(n) AS y,
                  sum(n * s) / sum(n) AS z FROM a{i} GROUP BY image_id, j) m ON c.image_id = m.image_id AND c.j = m.j)"""
            )
    return (
        "WITH " + ",\n".join(parts) + f""",
t AS (SELECT image_id, j, sum(n)::BIGINT AS n FROM a{rounds} GROUP BY image_id, j)
SELECT t.image_id, row_number() OVER (PARTITION BY t.image_id ORDER BY n DESC, t.j) AS slot,
       round(x, 6) AS x0, round(y, 6) AS x1, round(z, 6) AS x2, n,
       round(n::DOUBLE / sum(n) OVER (PARTITION BY t.image_id), 6) AS weight
FROM t JOIN c{rounds} c ON t.image_id = c.image_id AND t.j = c.j"""
    )


_KMEANS_LAB_SQL = _kmeans_space_sql(f"SELECT *, k_l AS p, k_a AS q, k_b AS s FROM {Q.lab('h0', 'r', 'g', 'b', 'k_')} k", "6", 3)
_KMEANS_SIZE_SQL = _kmeans_space_sql(
    "SELECT *, r::DOUBLE AS p, g::DOUBLE AS q, b::DOUBLE AS s FROM h0", "least(8, total // 100)", 3
)


def palette_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours over 13 % kept where at least three are left, padded to eight."""
    pruned = P.prune_palette(palettes(spark, sf_dir), N_COLORS, 0.13, 3)
    return pruned.withColumn("weight", F.round("weight", 6))


_PRUNE_SQL = f"""{_PAL},
k AS (SELECT *, count(*) FILTER (weight > 0.13) OVER (PARTITION BY image_id) AS heavy FROM pal),
f AS (SELECT image_id, slot, r, g, b, CASE WHEN heavy >= 3 THEN weight / sum(weight) OVER (PARTITION BY image_id) ELSE weight END AS weight
      FROM k WHERE weight > 0.13 OR heavy < 3),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY slot) AS s FROM f),
i AS (SELECT DISTINCT image_id, unnest(range(1, 9)) AS s FROM pal)
SELECT i.image_id, i.s::INT AS slot, coalesce(r, 0)::INT AS r, coalesce(g, 0)::INT AS g, coalesce(b, 0)::INT AS b,
       round(coalesce(weight, 0), 6) AS weight FROM i LEFT JOIN n ON i.image_id = n.image_id AND i.s = n.s"""


def palette_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_palette(palettes(spark, sf_dir), 6, 80.0).withColumn(
        "weight", F.round("weight", 6)
    )


_DIST = "sqrt((({a}.r - {b}.r) * ({a}.r - {b}.r) + ({a}.g - {b}.g) * ({a}.g - {b}.g) + ({a}.b - {b}.b) * ({a}.b - {b}.b))::DOUBLE)"
_DISTINCT_SQL = f"""{_PAL},
imp AS (SELECT a.image_id, a.slot, any_value(a.r) AS r, any_value(a.g) AS g, any_value(a.b) AS b, any_value(a.weight) AS weight,
          any_value(a.weight) * 0.7::DOUBLE + sum({_DIST.format(a="a", b="b")} ORDER BY b.slot) / count(*) * 0.3::DOUBLE AS im
        FROM pal a JOIN pal b ON a.image_id = b.image_id GROUP BY a.image_id, a.slot),
rk AS (SELECT image_id, list([{{'r': r, 'g': g, 'b': b, 'w': weight}}] ORDER BY im DESC, slot) AS cs FROM imp GROUP BY image_id),
fold AS (SELECT image_id, list_reduce(cs, lambda acc, x: CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda k:
           {_DIST.format(a="k", b="x[1]")} < 80)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM rk),
fl AS (SELECT image_id, unnest(kept) AS c, generate_subscripts(kept, 1) AS s FROM fold),
n AS (SELECT image_id, s, c.r AS r, c.g AS g, c.b AS b, c.w / sum(c.w) OVER (PARTITION BY image_id) AS weight FROM fl),
i AS (SELECT DISTINCT image_id, unnest(range(1, 7)) AS s FROM pal)
SELECT i.image_id, i.s::INT AS slot, coalesce(r, 0)::INT AS r, coalesce(g, 0)::INT AS g, coalesce(b, 0)::INT AS b,
       round(coalesce(weight, 0), 6) AS weight FROM i LEFT JOIN n ON i.image_id = n.image_id AND i.s = n.s"""


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.withColumn("color_similarity", F.round("color_similarity", 6))


def color_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.strict_color_score(*color_pairs(spark, sf_dir)))


# palette padded with black slots of weight 0
PADDED = """padn AS (SELECT DISTINCT image_id, unnest(range(1, {n} + 1)) AS slot FROM pal),
pad{n} AS (SELECT padn.image_id, padn.slot, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(weight, 0) AS weight
  FROM padn LEFT JOIN pal ON padn.image_id = pal.image_id AND padn.slot = pal.slot)"""


def strict_ctes(pairs: str) -> str:
    """``strict(ref_id, cmp_id, cs)`` over ``pairs`` and ``pal``."""
    return f"""{PADDED.format(n=8)},
ss AS (SELECT * FROM ({Q.slot_pairs(pairs, "pad8", "pad8")}) WHERE w1 >= 0.05),
sd AS MATERIALIZED {Q.de2000(Q.both_labs("ss"))},
sm AS (SELECT ref_id, cmp_id, s1, any_value(w1) AS w, min(de) AS d FROM sd GROUP BY ref_id, cmp_id, s1),
sw AS (SELECT ref_id, cmp_id, sum(d * w) / sum(w) AS d FROM sm GROUP BY ref_id, cmp_id),
fh AS MATERIALIZED {Q.hsv("pal")},
fm AS (SELECT image_id, {Q.FAMILY} AS fam, sum(weight) AS w FROM fh WHERE weight > 0.05 GROUP BY ALL),
fo AS (SELECT p.ref_id, p.cmp_id, coalesce(sum(CASE WHEN b.w IS NULL THEN 0 ELSE least(a.w, b.w) END), 0) AS ov FROM {pairs} p
       LEFT JOIN fm a ON a.image_id = p.ref_id LEFT JOIN fm b ON b.image_id = p.cmp_id AND b.fam = a.fam
       GROUP BY p.ref_id, p.cmp_id),
sx AS (SELECT fo.ref_id, fo.cmp_id, ov, coalesce(d, 100) AS d FROM fo LEFT JOIN sw ON sw.ref_id = fo.ref_id AND sw.cmp_id = fo.cmp_id),
strict AS (SELECT ref_id, cmp_id, ov, least(100, greatest(0, ({Q.STRICT.format(d="d")}) * (1 - greatest(0, 1 - 2 * ov)))) AS cs FROM sx)"""


_STRICT_SQL = f"{_PAIRS}, {strict_ctes('cp')} SELECT ref_id, cmp_id, round(cs, 6)::DOUBLE AS color_similarity FROM strict"


def family_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, palette = color_pairs(spark, sf_dir)
    return P.family_overlap(pairs, palette).withColumn("family_overlap", F.round("family_overlap", 6))


_FAMILY_SQL = f"{_PAIRS}, {strict_ctes('cp')} SELECT ref_id, cmp_id, round(ov, 6) AS family_overlap FROM strict"


def color_perceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.perceptual_color_score(*color_pairs(spark, sf_dir)))


def perceptual_ctes(pairs: str) -> str:
    return f"""use AS (SELECT * FROM pal WHERE weight > 0.01 AND greatest(r, g, b) > 0),
pl AS ({Q.slot_pairs(pairs, "use", "use")}),
pd AS MATERIALIZED {Q.de2000(Q.both_labs("pl"))},
pm AS (SELECT ref_id, cmp_id, s1, any_value(w1) AS w, max({Q.PERCEPTUAL.format(d="de")}) AS v FROM pd GROUP BY ref_id, cmp_id, s1),
percep AS (SELECT p.ref_id, p.cmp_id, coalesce(sum(v * w) / sum(w), 0) AS cs FROM {pairs} p
       LEFT JOIN pm ON pm.ref_id = p.ref_id AND pm.cmp_id = p.cmp_id GROUP BY p.ref_id, p.cmp_id)"""


_PERCEPTUAL_SQL = f"{_PAIRS}, {perceptual_ctes('cp')} SELECT ref_id, cmp_id, round(cs, 6) AS color_similarity FROM percep"

_LAB_CTES = f"""ll AS ({Q.slot_pairs("cp", "pal", "pal")}),
ld AS MATERIALIZED {Q.de94(Q.both_labs("ll"))},
lm AS (SELECT ref_id, cmp_id, s1, any_value(w1) AS w, min(de) AS d FROM ld GROUP BY ref_id, cmp_id, s1),
labs AS (SELECT ref_id, cmp_id, sum(({Q.LAB.format(d="d")}) * w) / sum(w) AS cs FROM lm GROUP BY ref_id, cmp_id)"""


def color_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.lab_color_score(*color_pairs(spark, sf_dir)))


_LAB_SQL = f"{_PAIRS}, {_LAB_CTES} SELECT ref_id, cmp_id, round(cs, 6) AS color_similarity FROM labs"


def color_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.rgb_color_score(*color_pairs(spark, sf_dir)))


_RGB_SQL = f"""{_PAIRS}, {PADDED.format(n=5)},
rd AS (SELECT ref_id, cmp_id, s1, min(sqrt(((r1 - r2) * (r1 - r2) + (g1 - g2) * (g1 - g2) + (b1 - b2) * (b1 - b2))::DOUBLE)) AS d
       FROM ({Q.slot_pairs("cp", "pad5", "pad5")}) GROUP BY ref_id, cmp_id, s1)
SELECT ref_id, cmp_id, round((1 - avg(d) / (255 * sqrt(3.0::DOUBLE))) * 100, 6) AS color_similarity FROM rd GROUP BY ref_id, cmp_id"""


def color_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, palette = color_pairs(spark, sf_dir)
    return _rounded(P.vector_color_score(pairs, P.lab_vector(palette), "cosine"))


def color_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, palette = color_pairs(spark, sf_dir)
    return _rounded(P.vector_color_score(pairs, P.lab_vector(palette), "euclidean"))


_VECTOR_SIDES = """FROM cp JOIN labv a ON a.image_id = ref_id JOIN labv b ON b.image_id = cmp_id"""
_COSINE_SQL = f"""{_PAIRS} SELECT ref_id, cmp_id,
  round(greatest(0, list_cosine_similarity(a.embedding, b.embedding) * 100), 6) AS color_similarity {_VECTOR_SIDES}"""
_EUCLIDEAN_SQL = f"""{_PAIRS} SELECT ref_id, cmp_id,
  round(greatest(0, (1 - list_distance(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding))
    + sqrt(list_dot_product(b.embedding, b.embedding)))) * 100), 6) AS color_similarity {_VECTOR_SIDES}"""


def _rounded_array(name: str) -> F.Column:
    return F.transform(name, lambda x: F.round(x, 6) + F.lit(0.0)).alias(name)


def color_vector_39(spark: SparkSession, sf_dir: str) -> DataFrame:
    prominent = P.prominent_colors(palettes(spark, sf_dir))
    vectors = P.feature_vector(prominent)
    return vectors.select("image_id", F.posexplode("embedding").alias("i", "value")).select(
        "image_id", "i", F.round("value", 6).alias("value")
    )


_PROMINENT = f"""pr0 AS (SELECT *, weight * 100 AS pct FROM pal WHERE weight >= 0.05),
pr AS MATERIALIZED {Q.lab(Q.hsv("pr0"), "r", "g", "b", "k_")},
pk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pct * dist DESC, slot) AS rk FROM pr),
fv AS (SELECT image_id, (flatten(list([r / 255.0::DOUBLE, g / 255.0::DOUBLE, b / 255.0::DOUBLE, k_l / 100, k_a / 127, k_b / 127,
   hue / 360, sat / 100, val / 100, pct / 100, pct * dist / 100, dist, 1.0::DOUBLE] ORDER BY rk))
   || list_resize([]::DOUBLE[], 39, 0))[1:39] AS embedding FROM pk WHERE rk <= 3 GROUP BY image_id)"""
_VECTOR_39_SQL = f"""{_PAL}, {_PROMINENT}
SELECT image_id, (unnest(range(1, 40)) - 1)::INT AS i, round(unnest(embedding), 6) AS value FROM fv"""


def lab_vector_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = P.lab_vector(palettes(spark, sf_dir))
    return vectors.select("image_id", F.posexplode("embedding").alias("i", "value")).select(
        "image_id", "i", F.round("value", 6).alias("value")
    )


_VECTOR_40_SQL = f"""{_PAL}, {_LABVEC}
SELECT image_id, (unnest(range(1, 41)) - 1)::INT AS i, round(unnest(embedding), 6) AS value FROM labv"""


def color_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest images by the vector of their main colours."""
    return _near(P.feature_vector(P.prominent_colors(palettes(spark, sf_dir))))


_INDEX_SEARCH_SQL = f"""{_PAL}, {_PROMINENT}, {Q.knn_ctes("fv", NEAREST, "nn", "l2")} SELECT ref_id, cmp_id, rank FROM nn"""


def color_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(J.color_scan(*color_pairs(spark, sf_dir)))


_RISK = """CASE WHEN cs >= 85 THEN 'VERY HIGH RISK' WHEN cs >= 70 THEN 'HIGH RISK' WHEN cs >= 50 THEN 'MODERATE RISK'
  WHEN cs >= 30 THEN 'LOW RISK' ELSE 'MINIMAL RISK' END"""
_SCAN_SQL = f"""{_PAIRS}, {_LAB_CTES} SELECT ref_id, cmp_id, round(cs, 6) AS color_similarity, {_RISK} AS risk_assessment,
  'weighted_lab' AS vector_method, 'Success' AS processing_status FROM labs"""


def color_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = J.color_summary(J.color_scan(*color_pairs(spark, sf_dir)))
    return summary.withColumn("average_similarity", F.round("average_similarity", 6))


_SCAN_SUMMARY_SQL = f"""{_PAIRS}, {_LAB_CTES} SELECT count(*) AS total_comparisons, count(*) FILTER (cs >= 70) AS high_risk_matches,
  count(*) AS successfully_processed, round(avg(cs), 6) AS average_similarity FROM labs"""


def sanity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram and edge plausibility of pairs with near palettes."""
    pairs, _ = color_pairs(spark, sf_dir)
    histograms = X.histogram_vector(X.hsv_histogram(view(spark, sf_dir, "pixels")))
    edges = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("embedding").alias("edge")
    )
    report = plan_sanity_report(pairs, histograms, edges)
    numbers = ("color_distance", "color_similarity", "edge_similarity", "discriminative_score")
    return report.withColumns({c: F.round(c, 6) for c in numbers})


_SANITY_SQL = f"""{_PAIRS}, {_HSV},
hx AS (SELECT image_id, CASE channel WHEN 'h' THEN 0 WHEN 's' THEN 50 ELSE 100 END + bin AS i, share FROM hh),
hg AS (SELECT DISTINCT image_id, unnest(range(0, 150)) AS i FROM px),
hv AS (SELECT hg.image_id, list(coalesce(share, 0) ORDER BY hg.i) AS h, list(coalesce(share, 0) ORDER BY coalesce(share, 0)) AS hs
       FROM hg LEFT JOIN hx ON hg.image_id = hx.image_id AND hg.i = hx.i GROUP BY hg.image_id),
fx AS (SELECT hv.*, embedding::DOUBLE[] AS e FROM hv JOIN embeddings ON vec_id = image_id),
r AS (SELECT ref_id, cmp_id, list_sum(list_transform(list_zip(a.hs, b.hs), lambda z: abs(z[1] - z[2]))) / 150 AS cd,
             list_cosine_similarity(a.h, b.h) AS c, list_cosine_similarity(a.e, b.e) AS e
      FROM cp LEFT JOIN fx a ON a.image_id = ref_id LEFT JOIN fx b ON b.image_id = cmp_id)
SELECT ref_id, cmp_id, round(cd, 6) AS color_distance, round(c, 6) AS color_similarity, round(e, 6) AS edge_similarity,
       cd <= 0.3 AS color_compatible, e >= 0.4 AS structure_compatible, round((c + e) / 2, 6) AS discriminative_score,
       coalesce(NOT (cd <= 0.3 AND e >= 0.4), true) AS warning FROM r"""


def color_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAB, HSV and family of every distinct pixel colour."""
    colors = view(spark, sf_dir, "pixels").select(*"rgb").distinct()
    rgb = tuple(F.col(c) for c in "rgb")
    return C.with_lab(colors).select(
        *"rgb",
        *[F.round(f"lab_{c}", 6).alias(f"lab_{c}") for c in "lab"],
        F.round(C.hue_degrees(*rgb), 6).alias("hue"),
        F.round(C.saturation_percent(*rgb), 6).alias("saturation"),
        F.round(C.value_percent(*rgb), 6).alias("brightness"),
        F.round(C.distinctiveness(*rgb), 6).alias("distinctiveness"),
        C.color_family(*rgb).alias("family"),
    )


_SPACES_SQL = f"""{_PAL}, u AS (SELECT DISTINCT r, g, b FROM px),
x AS MATERIALIZED {Q.lab(Q.hsv("u"), "r", "g", "b", "k_")}
SELECT r, g, b, round(k_l, 6) AS lab_l, round(k_a, 6) AS lab_a, round(k_b, 6) AS lab_b, round(hue, 6) AS hue,
  round(sat, 6) AS saturation, round(val, 6) AS brightness, round(dist, 6) AS distinctiveness, {Q.FAMILY} AS family FROM x"""

QUERIES = {
    f.__name__: f
    for f in (
        color_spaces, dominant_colors, hsv_hist, guarded_pixels, pixel_masks, kmeans_palette_2,
        kmeans_lab, kmeans_by_size,
        palette_prune, palette_distinct, color_strict, family_overlap, color_perceptual,
        color_lab, color_rgb, color_cosine, color_euclidean, color_vector_39, lab_vector_40,
        color_index_search, color_scan, color_scan_summary, sanity_report,
    )
}
ORACLE = {
    "color_spaces": _SPACES_SQL,
    "dominant_colors": _DOMINANT_SQL,
    "hsv_hist": _HSV_SQL,
    "guarded_pixels": _GUARDED_SQL,
    "pixel_masks": _MASKS_SQL,
    "kmeans_palette_2": _kmeans_sql(N_COLORS, 2),
    "kmeans_lab": _KMEANS_LAB_SQL,
    "kmeans_by_size": _KMEANS_SIZE_SQL,
    "palette_prune": _PRUNE_SQL,
    "palette_distinct": _DISTINCT_SQL,
    "color_strict": _STRICT_SQL,
    "family_overlap": _FAMILY_SQL,
    "color_perceptual": _PERCEPTUAL_SQL,
    "color_lab": _LAB_SQL,
    "color_rgb": _RGB_SQL,
    "color_cosine": _COSINE_SQL,
    "color_euclidean": _EUCLIDEAN_SQL,
    "color_vector_39": _VECTOR_39_SQL,
    "lab_vector_40": _VECTOR_40_SQL,
    "color_index_search": _INDEX_SEARCH_SQL,
    "color_scan": _SCAN_SQL,
    "color_scan_summary": _SCAN_SUMMARY_SQL,
    "sanity_report": _SANITY_SQL,
}
