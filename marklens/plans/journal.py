"""Trademark records out of ordered journal lines.

Lines are ``doc_id, page_no, line_no, line``. A record never crosses its page, so the
lines are shuffled once, by blocks of pages, and a page becomes one row with its lines
as an array; records are slices of it and their sections array expressions. Only the
class and the journal number travel across pages, as one value per page, and across
blocks, as one value per block. Partitions follow the number of lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.functions import journal as J
from marklens.functions.text import proprietor_name, strip
from marklens.operators.grouping import carry_before
from marklens.session import cut_lineage

KINDS = ("journal", "client")
PAGE_BLOCK = 128
#: Lines of a partition, about.
TASK_LINES = 1 << 20
_BLOCK = ["doc_id", "_block"]
_CARRIED = ("class", "journal_no", "journal_date")
COLUMNS = (
    "journal_no", "journal_date", "class", "application_number", "application_date",
    "company_name", "address", "entity_type", "legal_status", "address_for_service",
    "usage_details", "location_of_use", "goods_services", "additional_notes",
    "logo_path", "logo_placeholder", "source_file", "proprietor_name",
)


def page_lines(pages: DataFrame) -> DataFrame:
    """Ordered lines of ``doc_id, page_no, text`` pages."""
    return pages.select(
        "doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def start_pages(lines: DataFrame) -> DataFrame:
    """``doc_id, start_page``: where the applications of a journal begin."""
    upper = F.upper(F.col("line"))
    following = F.lead(upper).over(Window.partitionBy("doc_id", "page_no").orderBy("line_no"))
    marked = lines.withColumns(
        {
            "_phrase": F.contains(upper, F.lit(J.ADVERTISED)),
            "_class": upper.rlike(J.CLASS_UPPER)
            & F.coalesce(strip(following).rlike(J.RECORD_START), F.lit(False)),
        }
    )
    found = marked.groupBy("doc_id").agg(
        F.min(F.when(F.col("_phrase"), F.col("page_no"))).alias("_p"),
        F.min(F.when(F.col("_class"), F.col("page_no"))).alias("_c"),
    )
    phrase_first = F.col("_p").isNotNull() & (F.col("_c").isNull() | (F.col("_p") <= F.col("_c")))
    start = F.when(phrase_first, F.col("_p") + 1).otherwise(F.coalesce("_c", F.lit(0)))
    return found.select("doc_id", start.alias("start_page"))


#: Tests that every line takes once, kept as the bits of one number.
_TESTS: dict[str, Callable[[Column], Column]] = {
    "start": lambda line: line.rlike(J.RECORD_START),
    "class": lambda line: line.rlike(J.CLASS_LINE),
    "journal": lambda line: line.rlike(J.JOURNAL_HEADER),
    "stop": lambda line: J.ends_placeholder_search(line) | J.is_placeholder(line),
}
_BITS = {name: 1 << i for i, name in enumerate(_TESTS)}
#: Tests of the lines of a section only.
_PLACES: dict[str, Callable[[Column], Column]] = {
    "header_end": lambda line: line.rlike(J.HEADER_END),
    "service": lambda line: F.contains(line, F.lit(J.SERVICE)),
    "service_end": lambda line: line.rlike(J.SERVICE_END),
    "usage": lambda line: line.rlike(J.USAGE),
    "location": lambda line: F.upper(line).rlike(J.LOCATION),
    "notes": J.is_disclaimer,
}
_PIN: Callable[[Column], Column] = lambda line: line.rlike(J.PINCODE)
_TRADE: Callable[[Column], Column] = lambda line: F.upper(line).rlike(J.TRADE_WORDS)
#: White space and line ends: a line without them at its ends is its own ``strip``.
_EDGES = " \t\n\x0b\f\r\u0085\u2028\u2029"


def _stripped(line: Column) -> Column:
    """``strip`` of a line; the pattern is tried only where there is something to strip.

    An array holds the line, so that what renders it is not repeated for each use.
    """
    own = lambda x: F.when(F.btrim(x, F.lit(_EDGES)) == x, x).otherwise(strip(x))
    return _first(F.transform(F.array(line), own))


def _is(entry: Column, *names: str) -> Column:
    """One of the tests holds for the line."""
    return entry["tests"].bitwiseAND(F.lit(sum(_BITS[n] for n in names))) != 0


def _first(entries: Column) -> Column:
    return F.get(entries, F.lit(0))


def _last(entries: Column) -> Column:
    return F.get(entries, F.size(entries) - 1)


def _in_blocks(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_block", F.floor(F.col("page_no") / PAGE_BLOCK))


def _header_values(head: Column) -> dict[str, Column]:
    """Journal number, its date and the class in a journal header."""
    return {
        "journal_no": F.regexp_extract(head, J.JOURNAL_HEADER, 1),
        "journal_date": F.regexp_extract(head, J.JOURNAL_HEADER, 2),
        "_head_class": F.nullif(F.regexp_extract(head, J.CLASS_IN_HEADER, 1), F.lit("")),
    }


def block_values(lines: DataFrame) -> DataFrame:
    """``doc_id, _block`` with its number of lines and the values in force where it begins.

    Only class lines and journal headers are gathered by page; the blocks of a document
    then hand on one row each.
    """
    line = F.col("line")
    is_class, is_head = _TESTS["class"](line), _TESTS["journal"](line)
    marked = F.exists(F.array(line), lambda x: _TESTS["class"](x) | _TESTS["journal"](x))
    marks = _in_blocks(lines).filter(marked).groupBy(*_BLOCK, "page_no").agg(
        F.max_by("line", F.when(is_class, F.col("line_no"))).alias("_own"),
        F.min_by("line", F.when(is_head, F.col("line_no"))).alias("_head"),
    )
    own = F.regexp_extract("_own", J.CLASS_LINE, 1)
    pages = marks.withColumns(_header_values(F.col("_head"))).withColumn("class", F.coalesce(own, "_head_class"))
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("page_no"))).alias(v) for v in _CARRIED]
    sizes = _in_blocks(lines).groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("_lines"))
    blocks = sizes.join(pages.groupBy(*_BLOCK).agg(*last), _BLOCK, "left")
    return carry_before(blocks.withColumn("_at", F.col("_block")), [("doc_id",)], _CARRIED).drop("_at")


def gather_pages(lines: DataFrame, parts: int) -> DataFrame:
    """One row per page with ``entries``, its lines in order and the tests of each."""
    line = F.col("line")
    bits = [F.when(test(line), F.lit(_BITS[name])).otherwise(F.lit(0)) for name, test in _TESTS.items()]
    tests = bits[0]
    for bit in bits[1:]:
        tests = tests.bitwiseOR(bit)
    tested = _in_blocks(lines).select(*_BLOCK, "page_no", F.struct("line_no", "line", tests.alias("tests")).alias("_entry"))
    entries = F.sort_array(F.collect_list("_entry")).alias("entries")
    return tested.repartition(parts, *_BLOCK).groupBy(*_BLOCK, "page_no").agg(entries)


def carry_journal_values(pages: DataFrame, entering: DataFrame, parts: int) -> DataFrame:
    """Add the journal header in force on each page and the class where it begins.

    A window stays inside a block; ``entering`` holds the values where blocks begin.
    """
    own = F.regexp_extract(_last(F.filter("entries", lambda x: _is(x, "class")))["line"], J.CLASS_LINE, 1)
    head = _first(F.filter("entries", lambda x: _is(x, "journal")))["line"]
    valued = pages.withColumns({"_own": own, "_head": head}).withColumns(_header_values(F.col("_head")))
    before = Window.partitionBy(*_BLOCK).orderBy("page_no")
    so_far = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = valued.withColumn("class", F.coalesce("_own", "_head_class")).withColumns(
        {
            "class": F.last("class", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)),
            **{v: F.last(v, ignorenulls=True).over(so_far) for v in ("journal_no", "journal_date")},
        }
    )
    handed = entering.select(*_BLOCK, *[F.col(v).alias(f"_in_{v}") for v in _CARRIED]).repartition(parts, *_BLOCK)
    joined = carried.join(handed, _BLOCK, "left").withColumns({v: F.coalesce(v, f"_in_{v}") for v in _CARRIED})
    # a class in the page's journal header is in force from its first line
    return joined.withColumn("class", F.coalesce("_head_class", "class")).select(
        *_BLOCK, "page_no", "entries", *_CARRIED
    )


def segment_records(pages: DataFrame) -> DataFrame:
    """Records with ``lines``, from their header to the next one or a class line, and ``_next``.

    ``_next`` is the first line after the record that ends the search for placeholders.
    """
    places = lambda *names: F.filter(
        F.transform("entries", lambda x, i: F.when(_is(x, *names), i)), lambda i: i.isNotNull()
    )
    pages = pages.withColumns(
        {
            "_markers": places("start", "class"),
            "_classes": places("class"),
            "_stops": F.transform("entries", lambda x: _is(x, "stop")),
        }
    )
    spans = F.transform(
        "_markers",
        lambda at, i: F.struct(at.alias("at"), F.coalesce(F.get("_markers", i + 1), F.size("entries")).alias("end")),
    )
    starts = F.filter(spans, lambda x: _is(F.get("entries", x["at"]), "start"))
    records = pages.withColumn("_span", F.explode(starts)).withColumns({"_from": F.col("_span.at"), "_end": F.col("_span.end")})
    records = records.withColumns(
        {
            "_class_at": _last(F.filter("_classes", lambda c: c < F.col("_from"))),
            "_stop": F.array_position(F.slice("_stops", F.col("_end") + 1, F.size("entries")), True),
        }
    )
    next_line = F.get("entries", (F.col("_end") + F.col("_stop") - 1).cast("int"))["line"]
    own = F.regexp_extract(F.get("entries", F.col("_class_at"))["line"], J.CLASS_LINE, 1)
    return records.select(
        *_BLOCK,
        "page_no",
        "journal_no",
        "journal_date",
        F.coalesce(own, "class").alias("class"),
        F.slice("entries", F.col("_from") + 1, F.col("_end") - F.col("_from")).alias("lines"),
        F.when(F.col("_stop") > 0, next_line).alias("_next"),
    )


def label_sections(records: DataFrame) -> DataFrame:
    """Add the line positions that separate the sections of a record."""

    def position(name: str, after: str, strictly: bool = True) -> Column:
        """First line under a test after an earlier position."""
        behind = lambda x: x["line_no"] > F.col(after) if strictly else x["line_no"] >= F.col(after)
        return _first(F.filter("lines", lambda x: behind(x) & _PLACES[name](x["line"])))["line_no"]

    staged = records.withColumn("_start", _first(F.col("lines"))["line_no"])
    for name, after, strictly in (
        ("header_end", "_start", True),
        ("service", "_header_end", False),
        ("service_end", "_service", True),
        ("usage", "_service_end", False),
        ("location", "_usage", True),
        ("notes", "_location", True),
    ):
        staged = staged.withColumn(f"_{name}", position(name, after, strictly))
    end = F.coalesce("_header_end", F.lit(2147483647))
    in_header = F.filter("lines", lambda x: (x["line_no"] > F.col("_start")) & (x["line_no"] < end))
    return staged.withColumn("_header", in_header).withColumn(
        "_company", _first(F.filter("_header", lambda x: x["line"] != ""))
    )


def _joined(condition: Callable[[Column], Column]) -> Column:
    """Lines under a condition in order, joined by a space."""
    return strip(F.array_join(F.transform(F.filter("lines", condition), lambda x: x["line"]), " "))


def fold_records(labelled: DataFrame) -> DataFrame:
    """One row per record with its fields."""
    at = lambda position: _first(F.filter("lines", lambda x: x["line_no"] == F.col(position)))["line"]
    after_company = lambda x: (x["line_no"] > F.col("_company.line_no")) & ~J.is_trading_as(x["line"])
    in_service = lambda x: (x["line_no"] > F.col("_service")) & (
        F.col("_service_end").isNull() | (x["line_no"] < F.col("_service_end"))
    )
    in_goods = lambda x: (x["line_no"] > F.col("_location")) & (
        F.col("_notes").isNull() | (x["line_no"] < F.col("_notes"))
    )
    folded = labelled.withColumn("_further", F.filter("_header", after_company)).withColumns(
        {
            "_trading": _last(F.filter("_header", lambda x: J.is_trading_as(x["line"]))),
            "_pin": _first(F.filter("_further", lambda x: _PIN(x["line"]))),
            "_pin_trade": _last(F.filter("_further", lambda x: _PIN(x["line"]) & _TRADE(x["line"]))),
            "_trade": _last(F.filter("_further", lambda x: _TRADE(x["line"]) & ~_PIN(x["line"]))),
            "_head": _first(F.col("lines"))["line"],
        }
    )
    # a line with a pincode is the address only the first time
    later_pin = F.when(
        F.col("_pin_trade.line_no") > F.col("_pin.line_no"), F.col("_pin_trade")
    )
    entity = F.greatest(F.col("_trade"), later_pin)
    company = F.coalesce("_trading.line", "_company.line", F.lit(""))
    return folded.withColumns({"company_name": company, "_entity": entity}).select(
        *_BLOCK,
        "page_no",
        "_next",
        "journal_no",
        "journal_date",
        "class",
        F.regexp_extract("_head", J.RECORD_START, 1).alias("application_number"),
        F.regexp_extract("_head", J.RECORD_START, 2).alias("application_date"),
        "company_name",
        F.coalesce("_pin.line", F.lit("")).alias("address"),
        F.coalesce("_entity.line", F.lit("")).alias("entity_type"),
        F.when(F.col("_trading").isNotNull(), "PROPRIETOR")
        .otherwise(J.status_of(F.col("company_name")))
        .alias("legal_status"),
        _joined(in_service).alias("address_for_service"),
        F.coalesce(at("_usage"), F.lit("")).alias("usage_details"),
        F.coalesce(F.upper(at("_location")), F.lit("")).alias("location_of_use"),
        _joined(in_goods).alias("goods_services"),
        _joined(lambda x: x["line_no"] >= F.col("_notes")).alias("additional_notes"),
        proprietor_name(F.col("company_name")).alias("proprietor_name"),
    )


def _placeholders(records: DataFrame) -> DataFrame:
    """First placeholder wording after a record, unless another capital line comes first."""
    return records.withColumn("logo_placeholder", F.when(J.is_placeholder(F.col("_next")), F.col("_next")))


def attach_logo(records: DataFrame, page_images: DataFrame, parts: int) -> DataFrame:
    """Name of the page's first image; the placeholder stays only where there is none.

    The images come to the records, which lie in ``parts`` partitions by blocks of pages.
    """
    images = _in_blocks(page_images).repartition(parts, *_BLOCK)
    first = images.groupBy(*_BLOCK, "page_no").agg(F.min("img_index").alias("_img"))
    name = F.concat(
        F.col("application_number"), F.lit("_page_"), F.col("page_no").cast("string"),
        F.lit("_img_"), F.col("_img").cast("string"), F.lit(".png"),
    )
    return (
        records.join(first, [*_BLOCK, "page_no"], "left")
        .withColumn("logo_path", name)
        .withColumn("logo_placeholder", F.when(F.col("_img").isNull(), F.col("logo_placeholder")))
        .drop("_img")
    )


def extract_trademarks(
    lines: DataFrame, kind: str = "journal", page_images: DataFrame | None = None
) -> DataFrame:
    """All trademark records of the documents, dates also parsed."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}: {kind}")
    clean = lines.withColumn("line", _stripped(F.col("line")))
    if kind == "journal":
        clean = (
            clean.join(start_pages(lines), "doc_id")
            .filter(F.col("page_no") >= F.col("start_page"))
            .drop("start_page")
        )
    entering = cut_lineage(block_values(clean))
    total = entering.agg(F.coalesce(F.sum("_lines"), F.lit(0))).first()[0]
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, math.ceil(total / TASK_LINES))
    pages = carry_journal_values(gather_pages(clean, parts), entering, parts)
    records = _placeholders(fold_records(label_sections(segment_records(pages))))
    if page_images is None:
        records = records.withColumn("logo_path", F.lit(None).cast("string"))
    else:
        records = attach_logo(records, page_images, parts)
    return records.withColumns(
        {
            "source_file": F.col("doc_id").cast("string"),
            "db_type": F.lit(kind),
            "application_day": F.try_to_date("application_date", J.DATE_FORMAT),
            "journal_day": F.try_to_date("journal_date", J.DATE_FORMAT),
        }
    ).select("doc_id", "page_no", *COLUMNS, "db_type", "application_day", "journal_day")
