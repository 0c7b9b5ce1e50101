"""Trademark-journal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import table, view
from marklens.functions import text as T
from marklens.plans import journal as J
from marklens.session import spread


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the view ``journal_lines``, every order joined to its customer once."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k, i = F.col("k"), F.col("i")
    numbers = F.array(*[F.lit(n) for n in range(10)])
    # -1 is the class line, on the page of the first of three records
    order = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("goods of "), F.lower("c_mktsegment")).alias("goods"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.explode(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.array(F.lit(-1)), numbers)).otherwise(numbers)).alias("i"),
    )
    page = F.floor(k / 3).cast("int")
    texts = (
        F.concat(k.cast("string"), F.lit(" "), "day"),
        F.concat("name", F.when(k % 2 == 0, F.lit(" PVT. LTD.")).otherwise(F.lit(" TRADING AS ACME"))),
        F.lit("MG ROAD BANGALORE - 560 001"),
        F.lit("Merchants and Manufacturers"),
        F.lit("Address for service in India"),
        F.lit("AGENT HOUSE, DELHI"),
        F.concat(F.lit("Used Since :"), "day"),
        F.lit("MUMBAI"),
        F.col("goods"),
        F.lit("THIS IS A CONDITION"),
    )
    line = F.when(i == -1, F.concat(F.lit("Class "), (page % 45 + 1).cast("string")))
    for n, text in enumerate(texts):
        line = line.when(i == n, text)
    number = F.when(i == -1, F.lit(5)).otherwise((k % 3).cast("int") * 10 + 10 + i)
    rows = order.select(F.lit(0).alias("doc_id"), page.alias("page_no"), number.alias("line_no"), line.alias("line"))
    head = spark.range(1).select(
        F.lit(0).alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0).alias("line_no"),
        F.lit("Trade Marks Journal No: 2123 , 18/09/2023").alias("line"),
    )
    return head.unionByName(rows)


def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order rendered as a journal record, read back as a row."""
    rows = J.extract_trademarks(_lines(spark, sf_dir), "client")
    return rows.select("doc_id", "page_no", *J.COLUMNS, "db_type", "application_day")


_D = "strftime(o_orderdate, '%d/%m/%Y')"
_NAME = "CASE WHEN o_orderkey % 2 = 0 THEN concat(c_name, ' PVT. LTD.') ELSE concat(c_name, ' TRADING AS ACME') END"
_JOURNAL_SQL = f"""
SELECT 0 AS doc_id, (o_orderkey // 3)::INT AS page_no, '2123' AS journal_no, '18/09/2023' AS journal_date,
  ((o_orderkey // 3) % 45 + 1)::VARCHAR AS class, o_orderkey::VARCHAR AS application_number, {_D} AS application_date,
  {_NAME} AS company_name, 'MG ROAD BANGALORE - 560 001' AS address, 'Merchants and Manufacturers' AS entity_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a company organized under the laws of India' ELSE 'PROPRIETOR' END AS legal_status,
  'AGENT HOUSE, DELHI' AS address_for_service, concat('Used Since :', {_D}) AS usage_details, 'MUMBAI' AS location_of_use,
  concat('goods of ', lower(c_mktsegment)) AS goods_services, 'THIS IS A CONDITION' AS additional_notes,
  NULL::VARCHAR AS logo_path, NULL::VARCHAR AS logo_placeholder, '0' AS source_file,
  CASE WHEN o_orderkey % 2 = 0 THEN concat(c_name, ' PVT. LTD.') ELSE c_name END AS proprietor_name,
  'client' AS db_type, o_orderdate::DATE AS application_day
FROM orders JOIN customer ON o_custkey = c_custkey"""


def journal_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page with applications of each market segment's journal."""
    lines = view(spark, sf_dir, "segment_lines")
    return J.start_pages(lines)


_START_SQL = """
WITH p AS (SELECT DISTINCT ascii(c_mktsegment) AS doc_id, c_nationkey AS page_no FROM customer)
SELECT doc_id, min(CASE WHEN page_no >= doc_id % 7 THEN page_no END)::INT + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS start_page
FROM p GROUP BY doc_id"""


def journal_logos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First image of each page attached to its records; images stand on even pages."""
    lines = _lines(spark, sf_dir)
    pages = lines.filter(F.col("page_no") % 2 == 0)
    images = pages.select("doc_id", "page_no", (F.col("line_no") % 4 + 1).alias("img_index")).distinct()
    rows = J.extract_trademarks(lines, "client", images)
    return rows.select("application_number", "page_no", "logo_path", "logo_placeholder")


_LOGOS_SQL = """
SELECT o_orderkey::VARCHAR AS application_number, (o_orderkey // 3)::INT AS page_no,
  CASE WHEN (o_orderkey // 3) % 2 = 0 THEN concat(o_orderkey::VARCHAR, '_page_', (o_orderkey // 3)::VARCHAR, '_img_1.png') END AS logo_path,
  NULL::VARCHAR AS logo_placeholder
FROM orders JOIN customer ON o_custkey = c_custkey"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of lines and of characters in them per document."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_no"), "text")
    return J.page_lines(pages).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")
    )


_LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM l GROUP BY doc_id"""


def proprietors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner read off three forms of a company line."""
    customer = table(spark, sf_dir, "customer")
    name = F.col("c_name")
    line = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(name, F.lit(" trading as SHOP")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(name, F.lit(" AND "), F.col("c_mktsegment")))
        .otherwise(name)
    )
    return customer.select("c_custkey", T.proprietor_name(line).alias("proprietor_name"))


_PROPRIETORS_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN concat(c_name, ', ', c_mktsegment) ELSE c_name END AS proprietor_name FROM customer"""

QUERIES = {
    "journal_rows": journal_rows,
    "journal_start": journal_start,
    "journal_logos": journal_logos,
    "document_lines": document_lines,
    "proprietors": proprietors,
}
ORACLE = {
    "journal_rows": _JOURNAL_SQL,
    "journal_start": _START_SQL,
    "journal_logos": _LOGOS_SQL,
    "document_lines": _LINES_SQL,
    "proprietors": _PROPRIETORS_SQL,
}
