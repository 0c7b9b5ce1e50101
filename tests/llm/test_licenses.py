"""Licence texts in the forms in which files hold them, next to the SQL of the scan."""

import re
import textwrap

import duckdb
import pandas as pd
import pytest

from marklens.llm import licenses

HOLDERS = ("Copyright (c) 2019-2024 The Example Authors", "Copyright 2020 Some One <one@example.org>", "(c) 2001 A, 2002 B. All rights reserved.", "© Example GmbH")


def forms(name, text):
    """The same licence, wrapped, titled and marked in other ways."""
    words = " ".join(text.split())
    yield text
    yield textwrap.fill(words, 40, break_long_words=False)  # a line may begin with "copyright notice"
    for width in (29, 33, 57, 64, 90):
        yield textwrap.fill(words, width, break_long_words=False)
    yield words
    for holder in HOLDERS:
        yield holder + "\n\n" + text
        yield "/*\n * " + holder + "\n *\n * " + text.replace("\n", "\n * ") + "\n */"
    yield HOLDERS[0] + " " + words  # all in one line
    yield "\n".join(HOLDERS) + "\n" + text
    if name in ("MIT", "ISC", "Zlib", "Unlicense", "BSD-2-Clause", "BSD-3-Clause"):
        title = {"Unlicense": "The Unlicense"}.get(name, name.replace("-", " ") + " License")
        yield title + "\n\n" + HOLDERS[1] + "\n\n" + text
        yield title + " " + HOLDERS[0] + " " + words
        yield "# " + title + "\n" + text.upper()


def corpus():
    rows = []
    for name, text in licenses.known_texts():
        rows += [(form, name) for form in forms(name, text)]
        words = text.split()
        rows.append((" ".join(words[:-1]), None))
        rows.append((" ".join([*words[: len(words) // 2], "not", *words[len(words) // 2 :]]), None))
        rows.append((text + "\n\nand some more words", None))
    rows += [(None, None), ("", None), (" \n.", None), ("Copyright (c) 2020 A", None), ("mit license", None)]
    rows += [("x" * 200_000, None), ("copyright " + "word " * 100_000, None), ("copyright " + "y" * 200_000 + " z", None), ("\n" * 100_000, None)]
    return [(i, text, name) for i, (text, name) in enumerate(rows)]


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, digest string")
    return rows, licenses.scan(docs, licenses.known_licenses(spark)).toPandas()


def test_every_form_is_found(found):
    rows, got = found
    by_id = dict(zip(got.doc_id, got.license_id.where(got.license_id.notna(), None), strict=True))
    wrong = [(want, by_id[i], text[:80]) for i, text, want in rows if by_id[i] != want]
    assert not wrong


def test_sql_says_the_same(found):
    rows, got = found
    documents = pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(licenses.oracle()).df()
    key = ["doc_id", "digest", "license_id", "n_words"]
    a, b = (x[key].sort_values("doc_id").reset_index(drop=True).astype(object).where(lambda v: v.notna(), None) for x in (got, want))
    assert a.values.tolist() == b.values.tolist()


def test_texts_are_told_apart():
    texts = licenses.known_texts()
    assert len({" ".join(re.findall("[a-z0-9]+", t.lower())) for _, t in texts}) == len(texts)
    assert len({name for name, _ in texts}) >= 15
