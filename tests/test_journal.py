"""Journal records with irregular pages."""

import pytest

from marklens.plans import journal as J

PAGE1 = """Trade Marks Journal No: 2100 , 01/01/2020 Class 9
111 05/06/2019
RAVI KUMAR
14 PARK ST KOLKATA - 700 016
TRADERS
Address for service in India
LAW OFFICE
DELHI
Proposed to be Used
KOLKATA
shoes
and boots
No claim is made on the word
112 06/06/2019

ANN trading as SHOP
PUNE MERCHANTS - 411 001
OLD DEALERS - 411 002
Address for service in India
AGENT
Used Since :01/02/2018
DELHI
hats
Class 25
stray line
113 07/06/2019
X AND Y PRIVATE LIMITED
Address for service in India
Z
USED SINCE :01/01/2000
no usage above matched"""
PAGE2 = """Trade Marks Journal No: 2101 , 08/01/2020
114 08/06/2019
NO DEVICE LTD
TEXT MARK"""


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame([(7, 0, PAGE1), (7, 1, PAGE2)], "doc_id int, page_no int, text string")
    got = J.extract_trademarks(J.page_lines(pages), "client")
    return {r.application_number: r for r in got.collect()}


def test_fields(rows):
    assert set(rows) == {"111", "112", "113", "114"}
    a = rows["111"]
    assert (a.journal_no, a.journal_date, a["class"]) == ("2100", "01/01/2020", "9")
    assert (a.company_name, a.legal_status) == ("RAVI KUMAR", "INDIVIDUAL")
    assert (a.address, a.entity_type) == ("14 PARK ST KOLKATA - 700 016", "TRADERS")
    assert (a.address_for_service, a.usage_details) == ("LAW OFFICE DELHI", "Proposed to be Used")
    assert (a.location_of_use, a.goods_services) == ("KOLKATA", "shoes and boots")
    assert a.additional_notes == "No claim is made on the word"
    assert str(a.application_day) == "2019-06-05"


def test_trading_as_and_second_pincode(rows):
    b = rows["112"]
    assert (b.company_name, b.legal_status, b.proprietor_name) == ("ANN trading as SHOP", "PROPRIETOR", "ANN")
    assert (b.address, b.entity_type) == ("PUNE MERCHANTS - 411 001", "OLD DEALERS - 411 002")
    # no disclaimer: goods end at the class line, notes are empty
    assert (b.goods_services, b.additional_notes) == ("hats", "")


def test_class_and_journal_carry(rows):
    assert rows["113"]["class"] == "25" and rows["113"].proprietor_name == "X, Y PRIVATE LIMITED"
    assert rows["113"].usage_details == "" and rows["113"].location_of_use == ""
    d = rows["114"]
    assert (d["class"], d.journal_no) == ("25", "2101") and d.address_for_service == ""


def test_start_page_and_kinds(spark):
    pages = [(1, 0, "Class 1\n5 01/01/2020\nA"), (1, 1, "applications advertised before registration"), (1, 2, "6 01/01/2020\nB")]
    pages += [(2, 0, "intro"), (2, 1, "CLASS 3\n 7 01/01/2020\nC"), (3, 0, "8 01/01/2020\nD")]
    lines = J.page_lines(spark.createDataFrame(pages, "doc_id int, page_no int, text string"))
    starts = {r.doc_id: r.start_page for r in J.start_pages(lines).collect()}
    assert starts == {1: 0, 2: 1, 3: 0}
    numbers = {r.application_number for r in J.extract_trademarks(lines, "journal").collect()}
    assert numbers == {"5", "6", "7", "8"}
    with pytest.raises(ValueError):
        J.extract_trademarks(lines, "other")


def test_logo_placeholder(spark):
    text = "1 01/01/2020\nA CO\nplain words\n2 01/01/2020\nB"
    after = "9 01/01/2020\nZ CO\nTEXT MARK"
    lines = J.page_lines(spark.createDataFrame([(1, 0, text), (1, 1, after)], "doc_id int, page_no int, text string"))
    images = spark.createDataFrame([(1, 0, 3), (1, 0, 2)], "doc_id int, page_no int, img_index int")
    got = {r.application_number: r.logo_path for r in J.extract_trademarks(lines, "client", images).collect()}
    assert got == {"1": "1_page_0_img_2.png", "2": "2_page_0_img_2.png", "9": None}


def test_lines_of_orders_equal_the_view(spark):
    from catalog.fixtures import view
    from catalog.journal import _lines

    folder = "/root/testdata/sf0.001"
    got, want = _lines(spark, folder), view(spark, folder, "journal_lines")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lines_are_shuffled_once_in_partitions_that_follow_them(spark, monkeypatch):
    """Values pass blocks without marks, and the only shuffle of lines has a part for each TASK_LINES."""
    monkeypatch.setattr(J, "PAGE_BLOCK", 2)
    monkeypatch.setattr(J, "TASK_LINES", 10)
    pages = [(1, 0, "Trade Marks Journal No: 7 , 01/01/2020 Class 4\n1 01/01/2020\nA CO\nClass 8")]
    pages += [(1, n, f"{n} 02/01/2020\nB CO\nUsed Since :01/01/2000") for n in range(1, 40)]
    pages += [(1, 40, "Class 9\n40 02/01/2020\nC"), (2, 0, "50 02/01/2020\nD")]
    lines = J.page_lines(spark.createDataFrame(pages, "doc_id int, page_no int, text string"))
    found = J.extract_trademarks(lines, "client")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # 125 lines are 13 parts; the other shuffle is that of the values of blocks
    assert plan.count("Exchange") == 2 and plan.count(", 13), REPARTITION_BY_NUM") == 2
    got = {(r.doc_id, r.application_number): (r["class"], r.journal_no) for r in found.collect()}
    want = {(1, str(n)): ("8", "7") for n in range(2, 40)} | {(1, "40"): ("9", "7"), (2, "50"): (None, None)}
    assert {k: v for k, v in got.items() if k != (1, "1")} == want
    both = sorted((r.page_no, r["class"]) for r in found.collect() if r.application_number == "1")
    assert both == [(0, "4"), (1, "8")]
