import math
import random
import re
from collections import Counter

import pytest

from marklens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = set()
    for item, query in asked.items():
        rows = []
        for doc, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t, times in query.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        rows.sort(key=lambda r: r[:3])
        out |= {(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(rows[:k], 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "ñu", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, rng.choice((" ", "-", ". ")).join(rng.choices(vocabulary, weights, k=rng.choice((1, 2, 5, 5, 5, 20, 90))))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 8))))) for i in range(12)]
    return docs, items


def benchmark(spark, items):
    # names that the operator uses for columns of its own
    return spark.createDataFrame([(*row, 1, "x") for row in items], "item_id long, text string, score int, key string")


@pytest.mark.parametrize(("seed", "k", "postings"), [(1, 5, 1 << 19), (2, 3, 16), (3, 200, 64)])
def test_same_as_brute_force(spark, documents, monkeypatch, seed, k, postings):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    docs, items = corpus(seed)
    assert result(lexical.search(documents(docs), benchmark(spark, items), k)) == brute(docs, items, k)


def test_full_index_gives_the_same(spark, documents):
    docs, _ = corpus(4)
    counts = lexical.term_counts(documents(docs))
    index = lexical.build_index(counts, len(docs), sum(len(terms(t)) for _, t in docs))
    df = Counter(t for _, text in docs for t in set(terms(text)))
    held = Counter()
    for row in index.select("keys", "df").collect():
        held.update(dict(zip(row["keys"], row["df"], strict=True)))
    keys = lexical.TermKeys()
    assert held == {keys[t.encode()]: n for t, n in df.items()}


def test_nulls_empties_ties_and_repeated_rows(spark, documents):
    long = "needle " + "straw " * 300_000
    docs = [
        (1, None), (2, ""), (3, " .,\n"), (4, "Needle pin"), (5, "needle PIN"), (5, "needle pin"), (None, "needle pin"), (None, "pin"),
        (6, long), (7, "other"), (8, "other"), (9, "other words here"),
    ]
    items = [(1, "NEEDLE needle"), (2, None), (3, ""), (None, "pin"), (4, "unknown"), (5, "needle"), (5, "pin"), (6, "needle pin")]
    found = result_list = [tuple(r) for r in lexical.search(documents(docs), benchmark(spark, items), 20).collect()]
    assert sorted(map(repr, result_list)) == sorted(map(repr, [r for r in expected(docs, items)]))
    assert {r[0] for r in found} == {1, None, 5, 6}


def expected(docs, items):
    """Brute force with a row for each of the repeated ones."""
    counted = brute([(i, t) for i, (_, t) in enumerate(docs)], items, 100)
    out = []
    for item in {i for i, *_ in counted}:
        rows = sorted((-s, docs[d][0] is None, docs[d][0] or 0) for i, _, d, s in counted if i == item)
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(rows[:20], 1)]
    return out


def test_empty_tables(spark, documents):
    docs, items = corpus(5, 5)
    assert lexical.search(documents([]), benchmark(spark, items)).collect() == []
    assert lexical.search(documents(docs), benchmark(spark, [])).collect() == []
