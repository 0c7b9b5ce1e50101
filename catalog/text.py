"""Text queries: similarity joins over mark names, cleaning of extracted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import view, with_views
from marklens.functions import text as T
from marklens.functions.scoring import is_infringement
from marklens.operators import text_pairs as P

MIN_SCORE = 70.0


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_texts(view(spark, sf_dir, "marks"), "mark_text")


def text_lev_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = view(spark, sf_dir, "marks")
    texts = P.distinct_texts(marks, "mark_text")
    pairs = P.containment_score_pairs(texts, texts, MIN_SCORE)
    return P.best_marks(marks, marks, pairs, k=10).select(
        "ref_id",
        "cmp_id",
        "text1",
        "text2",
        F.round("text_similarity", 6).alias("text_similarity"),
        is_infringement(F.col("text_similarity"), MIN_SCORE).alias("infringement_detected"),
        F.col("rank").cast("long").alias("rank"),
    )


_CONTAINMENT = """
CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0
     WHEN contains(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END,
                   CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)
       THEN 85.0::DOUBLE + 15.0::DOUBLE * least(length({a}), length({b})) / greatest(length({a}), length({b}))
     ELSE (1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) * 100 END"""
_EDIT = "(1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) * 100"

_TEXTS = with_views("marks") + """,
t AS (SELECT DISTINCT mark_text AS text FROM marks WHERE length(mark_text) > 0)"""

_TEXT_LEV_RANK_SQL = f"""
{_TEXTS},
p AS (SELECT a.text AS text1, b.text AS text2,
             {_CONTAINMENT.format(a="a.text", b="b.text")} AS s FROM t a, t b),
r AS (SELECT m1.mark_id AS ref_id, m2.mark_id AS cmp_id, text1, text2, s,
             row_number() OVER (PARTITION BY m1.mark_id ORDER BY s DESC, m2.mark_id) AS rank
      FROM p JOIN marks m1 ON m1.mark_text = text1 JOIN marks m2 ON m2.mark_text = text2
      WHERE s >= 70 AND m1.mark_id <> m2.mark_id)
SELECT ref_id, cmp_id, text1, text2, round(s, 6) AS text_similarity,
       s >= 70 AS infringement_detected, rank
FROM r WHERE rank <= 10"""


def text_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return P.edit_score_pairs(texts, texts, MIN_SCORE).select(
        "text1", "text2", F.round("text_similarity", 6).alias("text_similarity")
    )


_TEXT_EDIT_SQL = f"""
{_TEXTS}
SELECT a.text AS text1, b.text AS text2, round({_EDIT.format(a="a.text", b="b.text")}, 6) AS text_similarity
FROM t a, t b WHERE {_EDIT.format(a="a.text", b="b.text")} >= 70 - 1e-9"""


def text_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return P.text_score_pairs_v1(texts, texts, MIN_SCORE).select(
        "text1", "text2", "text_similarity", T.text_band(F.col("text_similarity")).alias("band")
    )


_BAND = """CASE WHEN {s} >= 90 THEN 'Very High Similarity - Texts are nearly identical'
     WHEN {s} >= 70 THEN 'High Similarity - Texts are quite similar'
     WHEN {s} >= 50 THEN 'Moderate Similarity - Some similarities found'
     WHEN {s} >= 20 THEN 'Low Similarity - Few similarities found'
     ELSE 'Very Low Similarity - Texts appear different' END"""

# word-level parts shared by the two word-based scores
_WORD_PARTS = """
w0 AS MATERIALIZED (SELECT text, list_filter(string_split(lower(trim(text)), ' '), lambda x: x <> '') AS al FROM t),
w AS MATERIALIZED (SELECT text, list_filter(al, lambda x, i: list_position(al, x) = i) AS ws FROM w0),
v AS MATERIALIZED (SELECT DISTINCT unnest(ws) AS word FROM w),
q AS MATERIALIZED (SELECT a.word AS w1, b.word AS w2, length(a.word) AS l1, length(b.word) AS l2,
             least(length(a.word), length(b.word)) AS mn, greatest(length(a.word), length(b.word)) AS mx,
             jaro_winkler_similarity(a.word, b.word) AS jw, levenshtein(a.word, b.word) AS lev,
             len(list_intersect(list_distinct(string_split(a.word, '')), list_distinct(string_split(b.word, ''))))::DOUBLE
               / len(list_distinct(list_concat(string_split(a.word, ''), string_split(b.word, '')))) * 100 AS o,
             list_max(list_filter(range(0, least(length(a.word), length(b.word)) + 1),
                      lambda i: left(a.word, i::BIGINT) = left(b.word, i::BIGINT)))::INT AS pre,
             list_max(list_filter(range(0, least(length(a.word), length(b.word)) + 1),
                      lambda i: right(a.word, i::BIGINT) = right(b.word, i::BIGINT)))::INT AS suf,
             len(list_filter(string_split(a.word, ''), lambda c: contains(b.word, c))) AS same
      FROM v a, v b)"""

_V1_CORE = f"""
{_WORD_PARTS},
ws AS MATERIALIZED (SELECT w1, w2, greatest(
         CASE WHEN w1 <> w2 AND mn >= 4 THEN CASE WHEN jw >= 0.8 THEN jw * 85 WHEN jw >= 0.6 THEN jw * 70 ELSE 0 END ELSE 0 END,
         CASE WHEN o >= 60 THEN o * 0.8::DOUBLE WHEN o >= 40 THEN o * 0.6::DOUBLE ELSE 0 END,
         CASE WHEN suf >= 3 THEN suf::DOUBLE / mn * 70 ELSE 0 END,
         CASE WHEN pre >= 3 THEN pre::DOUBLE / mn * 70 ELSE 0 END,
         CASE WHEN mn >= 3 AND mx <= 10 THEN
              CASE WHEN lev <= 2 AND mx >= 5 THEN (mx - lev)::DOUBLE / mx * 75
                   WHEN lev <= 1 THEN (mx - lev)::DOUBLE / mx * 80 ELSE 0 END ELSE 0 END,
         CASE WHEN mn >= 4 AND (contains(w1, w2) OR contains(w2, w1)) THEN mn::DOUBLE / mx * 60 ELSE 0 END) AS sc FROM q),
tp AS MATERIALIZED (SELECT a.text AS text1, b.text AS text2, a.ws AS ws1, b.ws AS ws2, len(a.ws) AS n1, len(b.ws) AS n2,
              CASE WHEN len(a.ws) = 1 AND len(b.ws) = 1 THEN 95
                   WHEN len(list_intersect(a.ws, b.ws))::DOUBLE / greatest(len(a.ws), len(b.ws)) > 0.7 THEN 90
                   ELSE 70 END AS eq,
              jaro_winkler_similarity(array_to_string(a.ws, ' '), array_to_string(b.ws, ' ')) * 100 AS ov
       FROM w a, w b WHERE len(a.ws) > 0 AND len(b.ws) > 0),
e1 AS (SELECT text1, text2, ws2, eq, unnest(ws1) AS w1 FROM tp),
e2 AS (SELECT text1, text2, eq, w1, unnest(ws2) AS w2 FROM e1),
b1 AS MATERIALIZED (SELECT text1, text2, e2.w1, max(CASE WHEN e2.w1 = e2.w2 THEN greatest(sc, eq) ELSE sc END) AS best
       FROM e2 JOIN ws ON e2.w1 = ws.w1 AND e2.w2 = ws.w2 GROUP BY text1, text2, e2.w1),
av AS (SELECT text1, text2, avg(best) AS m FROM b1 GROUP BY text1, text2),
raw AS MATERIALIZED (SELECT tp.text1, tp.text2, m * 0.7::DOUBLE + ov * 0.3::DOUBLE AS f, least(n1, n2)::DOUBLE / greatest(n1, n2) AS r
        FROM tp JOIN av ON tp.text1 = av.text1 AND tp.text2 = av.text2),
v1 AS MATERIALIZED (SELECT text1, text2, round(least(CASE WHEN r < 0.5 THEN f * (r * 0.5::DOUBLE + 0.5::DOUBLE) ELSE f END, 99.5), 2) AS s FROM raw)"""

_TEXT_V1_SQL = f"""
{_TEXTS},
{_V1_CORE}
SELECT text1, text2, s AS text_similarity, {_BAND.format(s="s")} AS band FROM v1 WHERE s >= 70"""


def text_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return P.text_score_pairs_v2(texts, texts, MIN_SCORE)


_TEXT_V2_SQL = f"""
{_TEXTS},
{_WORD_PARTS},
ws AS (SELECT w1, w2, CASE WHEN w1 = w2 THEN 100.0::DOUBLE ELSE greatest(
         CASE WHEN mn >= 5 AND jw >= 0.85 AND same >= floor(mn / 2) THEN jw * 100 ELSE 0 END,
         CASE WHEN suf >= 3 THEN suf::DOUBLE / mn * 100 ELSE 0 END,
         CASE WHEN pre >= 3 THEN pre::DOUBLE / mn * 100 ELSE 0 END,
         CASE WHEN mn >= 5 AND mx <= 8 AND lev <= 2 THEN (mn - lev)::DOUBLE / mn * 100 ELSE 0 END) END AS sc FROM q),
e1 AS (SELECT a.text AS text1, b.text AS text2, unnest(a.ws) AS w1, b.ws AS ws2 FROM w a, w b),
e2 AS (SELECT text1, text2, w1, unnest(ws2) AS w2 FROM e1),
s AS (SELECT text1, text2, round(max(sc), 2) AS s FROM e2 JOIN ws ON e2.w1 = ws.w1 AND e2.w2 = ws.w2
      GROUP BY text1, text2)
SELECT text1, text2, s AS text_similarity FROM s WHERE s >= 70"""


def text_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return P.text_score_pairs_v3(texts, texts, MIN_SCORE).select(
        "text1", "text2", F.round("text_similarity", 6).alias("text_similarity")
    )


_TEXT_V3_SQL = f"""
{_TEXTS},
w AS (SELECT text, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS n FROM t),
x AS (SELECT text, n, list_distinct(string_split(n, ' ')) AS ws FROM w),
p AS (SELECT a.text AS text1, b.text AS text2,
        least(100.0::DOUBLE, {_CONTAINMENT.format(a="a.n", b="b.n")} * 0.4::DOUBLE
          + jaro_winkler_similarity(a.n, b.n) * 100 * 0.3::DOUBLE
          + len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))) * 100 * 0.3::DOUBLE
          + CASE WHEN CASE WHEN len(a.ws) <= len(b.ws) THEN len(list_intersect(a.ws, b.ws)) = len(a.ws)
                           ELSE len(list_intersect(a.ws, b.ws)) = len(b.ws) END THEN 30 ELSE 0 END) AS s
      FROM x a, x b)
SELECT text1, text2, round(s, 6) AS text_similarity FROM p WHERE s >= 70"""


def text_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infringing marks per reference, counted from text groups without listing pairs."""
    marks = view(spark, sf_dir, "marks")
    texts = P.distinct_texts(marks, "mark_text")
    pairs = P.containment_score_pairs(texts, texts, MIN_SCORE)
    holders = marks.groupBy(F.col("mark_text").alias("text2")).agg(F.count("*").alias("n"))
    per_text = pairs.join(holders, "text2").groupBy("text1").agg(F.sum("n").alias("n"))
    return marks.join(per_text, marks["mark_text"] == per_text["text1"]).select(
        F.col("mark_id").alias("ref_id"), (F.col("n") - 1).alias("infringement_count")
    )


_TEXT_REFERENCE_COUNTS_SQL = f"""
{_TEXTS},
p AS (SELECT a.text AS text1, b.text AS text2 FROM t a, t b
      WHERE {_CONTAINMENT.format(a="a.text", b="b.text")} >= 70)
SELECT m1.mark_id AS ref_id, count(*) - 1 AS infringement_count
FROM p JOIN marks m1 ON m1.mark_text = text1 JOIN marks m2 ON m2.mark_text = text2
GROUP BY m1.mark_id"""


def ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_text")
    return view(spark, sf_dir, "ocr").select(
        "conv_id",
        "turn",
        T.clean_short(raw).alias("clean_short"),
        T.clean_long(raw).alias("clean_long"),
        T.normalise(T.clean_short(raw)).alias("normalised"),
        T.normalise_words(T.clean_short(raw)).alias("distinct_words"),
    )


def _sql_clean(expr: str, lead_ins, once: bool) -> str:
    """SQL of the lead-in rules, spelled out step by step."""
    strip = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
    if once:
        whens = " ".join(
            f"WHEN starts_with(lower(tx), '{p.lower()}') THEN "
            + strip.format(x=f"substr(tx, {len(p) + 1})")
            for p in lead_ins
        )
        return f"CASE {whens} ELSE tx END"
    out = expr
    for p in lead_ins:
        cut = strip.format(x=f"substr({out}, {len(p) + 1})")
        out = f"CASE WHEN starts_with(lower({out}), '{p.lower()}') THEN {cut} ELSE {out} END"
    return out


_QUOTES = ", ".join("'" + q.replace("'", "''") + "'" for q in T.EMPTY_QUOTES)
_OCR_CLEAN_SQL = f"""
{with_views("ocr")},
s AS (SELECT conv_id, turn,
             regexp_replace(regexp_replace(coalesce(raw_text, ''), '^\\s+', ''), '\\s+$', '') AS tx FROM ocr),
u AS (SELECT *, CASE WHEN tx IN ({_QUOTES}) THEN '' ELSE tx END AS tq FROM s),
c AS (SELECT conv_id, turn, {_sql_clean("tq", T.LEAD_INS_SHORT, False)} AS clean_short,
             {_sql_clean("tx", T.LEAD_INS_LONG, True)} AS clean_long FROM u),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(clean_short), '^\\s+', ''), '\\s+$', ''),
                               '\\s+', ' ', 'g') AS normalised FROM c),
i AS (SELECT conv_id, turn, unnest(string_split(normalised, ' ')) AS w,
             generate_subscripts(string_split(normalised, ' '), 1) AS i FROM n),
f AS (SELECT conv_id, turn, w, min(i) AS i FROM i WHERE w <> '' GROUP BY conv_id, turn, w),
d AS (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS distinct_words FROM f GROUP BY conv_id, turn)
SELECT n.conv_id, n.turn, clean_short, clean_long, normalised, coalesce(distinct_words, '') AS distinct_words
FROM n LEFT JOIN d ON n.conv_id = d.conv_id AND n.turn = d.turn"""

QUERIES = {
    "text_lev_rank": text_lev_rank,
    "text_edit": text_edit,
    "text_v1": text_v1,
    "text_v2": text_v2,
    "text_v3": text_v3,
    "text_reference_counts": text_reference_counts,
    "ocr_clean": ocr_clean,
}
ORACLE = {
    "text_lev_rank": _TEXT_LEV_RANK_SQL,
    "text_edit": _TEXT_EDIT_SQL,
    "text_v1": _TEXT_V1_SQL,
    "text_v2": _TEXT_V2_SQL,
    "text_v3": _TEXT_V3_SQL,
    "text_reference_counts": _TEXT_REFERENCE_COUNTS_SQL,
    "ocr_clean": _OCR_CLEAN_SQL,
}
