"""Patterns and line tests of trademark-journal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and wordings of the journal.
JOURNAL_HEADER = r"^Trade Marks Journal No: (\d+)\s*,\s*(\d{2}/\d{2}/\d{4})"
RECORD_START = r"^(\d+)\s+(\d{2}/\d{2}/\d{4})"
CLASS_LINE = r"^Class (\d+)"
CLASS_IN_HEADER = r"Class (\d+)"
CLASS_UPPER = r"CLASS \d+"
ADVERTISED = "APPLICATIONS ADVERTISED BEFORE REGISTRATION"
HEADER_END = r"(?i)^(USED SINCE|PROPOSED TO BE USED|Address for service)"
SERVICE = "Address for service"
SERVICE_END = r"(?i)^(USED SINCE|PROPOSED TO BE USED)"
USAGE = r"^(Used Since :\d{2}/\d{2}/\d{4}|Proposed to be Used)"
LOCATION = r"^[A-Z]+$"
PINCODE = r"[A-Z\s]+-\s*\d{3}\s*\d{3}"
TRADE_WORDS = r"MANUFACTURERS?|MERCHANTS?|TRADERS?|DEALERS?"
PERSON_NAME = r"^[A-Z\s.]+$"
COMPANY_STATUS = "a company organized under the laws of India"
PLACEHOLDERS = ("NO LOGO", "DEVICE NOT PRESENT", "TEXT MARK")
UPPER_LINE = r"^[A-Z\s,.-]+"
UPPER_LINE_SKIP = r"^(USED SINCE|PROPOSED TO BE USED|CLASS \d+)"
DATE_FORMAT = "dd/MM/yyyy"


def is_disclaimer(line: Column) -> Column:
    upper = F.upper(line)
    return (
        F.contains(upper, F.lit("THIS IS"))
        | F.contains(upper, F.lit("REGISTRATION OF THIS TRADE MARK"))
        | F.contains(line, F.lit("No claim is made"))
    )


def is_placeholder(line: Column) -> Column:
    found = F.lit(False)
    for wording in PLACEHOLDERS:
        found = found | F.contains(F.upper(line), F.lit(wording))
    return found


def ends_placeholder_search(line: Column) -> Column:
    return line.rlike(UPPER_LINE) & ~line.rlike(UPPER_LINE_SKIP)


def is_trading_as(line: Column) -> Column:
    return F.contains(F.lower(line), F.lit("trading as"))


def status_of(company: Column) -> Column:
    """Legal status read off a company line."""
    upper = F.upper(company)
    return (
        F.when(
            F.contains(upper, F.lit("PVT. LTD.")) | F.contains(upper, F.lit("PRIVATE LIMITED")),
            COMPANY_STATUS,
        )
        .when(upper.rlike(PERSON_NAME), "INDIVIDUAL")
        .otherwise("")
    )
