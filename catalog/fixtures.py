"""Engine inputs derived from the driver tables, whole tables each.

The SQL runs unchanged in Spark and in DuckDB; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marklens.session import deal

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_PIXELS = """
SELECT {key} AS image_id,
       CAST(l_quantity AS INT) * 5 AS r,
       CAST(round(l_discount * 100) AS INT) * 25 AS g,
       CAST(round(l_tax * 100) AS INT) * 31 AS b
FROM {{lineitem}}"""

SQL = {
    "marks": "SELECT p_partkey AS mark_id, p_name AS mark_text FROM {part}",
    "ocr": """
SELECT conv_id, turn,
       CASE WHEN conv_id % 4 = 0 THEN concat('The text in the image reads: ', text)
            WHEN conv_id % 4 = 1 THEN concat('  THE TEXT IN THE IMAGE IS:', text)
            WHEN conv_id % 4 = 2 AND turn = 0 THEN '""'
            ELSE text END AS raw_text
FROM {conversations}""",
    "vectors": "SELECT vec_id AS image_id, embedding FROM {embeddings}",
    "variants": """
SELECT CAST(floor(vec_id / 5) AS BIGINT) AS image_id,
       CAST(vec_id % 5 AS INT) AS variant, embedding
FROM {embeddings}""",
    "pixels": _PIXELS.format(key="l_suppkey"),
    "pixels_rgba": _PIXELS.format(key="l_suppkey").replace(
        " AS b\n", " AS b, CAST(l_linenumber AS INT) * 37 AS a\n"
    ),
    "logo_pixels": _PIXELS.format(key="l_partkey"),
    "files": """
SELECT concat('/logos/', source, '/', CAST(doc_id AS STRING), '/', CAST(doc_id % 2 AS STRING), '.txt') AS path,
       CAST(length(text) AS BIGINT) AS length, text AS content
FROM {documents}""",
    "scores": """
SELECT l_suppkey AS ref_id, l_partkey AS cmp_id,
       max(round(l_quantity * 2, 2)) AS text_similarity,
       max(round(l_discount * 1000, 2)) AS color_similarity,
       max(round(l_tax * 1250, 2)) AS vit_similarity
FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "match_counts": """
SELECT l_suppkey AS ref_id, l_partkey AS cmp_id,
       CASE WHEN l_linenumber % 3 = 0 THEN 'SIFT'
            WHEN l_linenumber % 3 = 1 THEN 'ORB' ELSE 'AKAZE' END AS method,
       max(CAST(l_quantity AS INT)) AS good_matches,
       max(CAST(floor(l_quantity * round(l_discount * 100) / 10) AS INT)) AS inliers,
       CAST(max(l_partkey % 220) AS INT) AS kp1, CAST(max(l_suppkey % 180) AS INT) AS kp2
FROM {lineitem}
GROUP BY l_suppkey, l_partkey,
         CASE WHEN l_linenumber % 3 = 0 THEN 'SIFT'
              WHEN l_linenumber % 3 = 1 THEN 'ORB' ELSE 'AKAZE' END""",
    "observations": """
SELECT l_suppkey AS ref_id, l_partkey AS cmp_id,
       CAST(l_linenumber % 5 AS INT) AS step,
       max(round(l_discount * 10, 4)) AS mv, max(round(l_tax * 12.5, 4)) AS em
FROM {lineitem} GROUP BY l_suppkey, l_partkey, CAST(l_linenumber % 5 AS INT)""",
    "contours": """
SELECT l_suppkey AS ref_id, l_partkey AS cmp_id,
       CAST(l_linenumber % 5 AS INT) AS c1, CAST(CAST(l_quantity AS INT) % 5 AS INT) AS c2,
       max((l_suppkey * 7 + l_linenumber % 5 * 13) % 50 + 1) AS area1,
       max((l_partkey * 5 + CAST(l_quantity AS INT) % 5 * 11) % 50 + 1) AS area2,
       min(round(l_discount * 10, 4)) AS hu,
       min(CASE WHEN l_orderkey % 4 > 0 THEN round(l_tax * 12.5, 4) END) AS shape
FROM {lineitem}
GROUP BY l_suppkey, l_partkey, CAST(l_linenumber % 5 AS INT),
         CAST(CAST(l_quantity AS INT) % 5 AS INT)""",
    "journal_lines": """
WITH o AS (
  SELECT o_orderkey AS k, c_name, c_mktsegment,
         concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
                lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/',
                CAST(year(o_orderdate) AS STRING)) AS d,
         CAST(floor(o_orderkey / 3) AS INT) AS page_no,
         CAST(o_orderkey % 3 AS INT) * 10 + 10 AS base
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey)
SELECT 0 AS doc_id, 0 AS page_no, 0 AS line_no, 'Trade Marks Journal No: 2123 , 18/09/2023' AS line
UNION ALL SELECT 0, page_no, 5, concat('Class ', CAST(page_no % 45 + 1 AS STRING)) FROM o WHERE base = 10
UNION ALL SELECT 0, page_no, base, concat(CAST(k AS STRING), ' ', d) FROM o
UNION ALL SELECT 0, page_no, base + 1, CASE WHEN k % 2 = 0 THEN concat(c_name, ' PVT. LTD.') ELSE concat(c_name, ' TRADING AS ACME') END FROM o
UNION ALL SELECT 0, page_no, base + 2, 'MG ROAD BANGALORE - 560 001' FROM o
UNION ALL SELECT 0, page_no, base + 3, 'Merchants and Manufacturers' FROM o
UNION ALL SELECT 0, page_no, base + 4, 'Address for service in India' FROM o
UNION ALL SELECT 0, page_no, base + 5, 'AGENT HOUSE, DELHI' FROM o
UNION ALL SELECT 0, page_no, base + 6, concat('Used Since :', d) FROM o
UNION ALL SELECT 0, page_no, base + 7, 'MUMBAI' FROM o
UNION ALL SELECT 0, page_no, base + 8, concat('goods of ', lower(c_mktsegment)) FROM o
UNION ALL SELECT 0, page_no, base + 9, 'THIS IS A CONDITION' FROM o""",
    # one journal per market segment, one page per nation; the applications of an
    # even journal are announced by a phrase, those of an odd one by a class line
    "segment_lines": """
WITH p AS (SELECT DISTINCT ascii(c_mktsegment) AS doc_id, c_nationkey AS page_no FROM {customer})
SELECT doc_id, page_no, 0 AS line_no,
       CASE WHEN page_no < doc_id % 7 THEN 'Contents'
            WHEN doc_id % 2 = 0 THEN 'Applications advertised before registration'
            ELSE 'see class 5 below' END AS line FROM p
UNION ALL SELECT doc_id, page_no, 1,
       CASE WHEN page_no < doc_id % 7 THEN 'Class 1' ELSE '  123 01/02/2020 ' END AS line FROM p
UNION ALL SELECT doc_id, page_no, 2, 'end of page' FROM p""",
    # one logo per part: text, vector and colours share the id
    "logos": "SELECT p_partkey AS logo_id, p_name AS logo_text FROM {part}",
    # the first holder of each name is the registered reference
    "registered": """
SELECT min(p_partkey) AS logo_id, p_name AS logo_text FROM {part} GROUP BY p_name""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in sql]


def view(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A derived input as a Spark DataFrame.

    With ``keys`` its table is dealt by these columns first: neither the input nor what
    groups it by them has to be shuffled again. The rows are the same.
    """
    sql = SQL[name]
    tables = {t: table(spark, sf_dir, t) for t in _names(sql)}
    if keys:
        tables = {t: deal(rows, rows.count(), *keys) for t, rows in tables.items()}
    return spark.sql(sql, **tables)


def duck(name: str) -> str:
    """The same input as SQL over the table names."""
    return SQL[name].format(**{t: t for t in TABLES})


def with_views(*names: str) -> str:
    """``WITH`` list of derived inputs for a SQL counterpart."""
    return "WITH " + ",\n".join(f"{n} AS ({duck(n)})" for n in names)
