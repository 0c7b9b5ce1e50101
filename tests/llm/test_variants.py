import random
import re
from collections import Counter
from zlib import crc32

import pytest

from marklens.llm import variants


def words_of(docs):
    total = Counter()
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    words = words_of(docs)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcé"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaab", "abababab"]
    pool = list(base)
    for word in base:
        for _ in range(6):
            at = rng.randrange(len(word) + 1)
            pool.append(word[:at] + rng.choice(["", *letters]) + word[at + rng.randrange(2) :])
    weights = [rng.choice((1, 1, 2, 5, 40)) for _ in pool]
    return [(i, rng.choice((" ", "-", "2")).join(w.capitalize() if rng.random() < 0.2 else w for w in rng.choices(pool, weights, k=60))) for i in range(60)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(documents, seed):
    docs = corpus(seed)
    found = result(variants.spelling_variants(documents(docs)))
    assert found == brute(docs)
    assert any(root != form and form for _, form, root, *_ in found)  # some path has two steps


def test_partial_counts_add_up(documents, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 5)
    docs = corpus(4)
    assert result(variants.spelling_variants(documents(docs, 2))) == brute(docs)


def test_nulls_empties_long_texts_and_repeated_rows(documents):
    docs = [
        (1, None), (2, ""), (3, " 12 .\n"), (None, "Planet planet PLANET"), (4, "plant " * 2), (4, "plant " * 2), (4, "plant " * 2),
        (5, "Éclair éclair éclair eclair Éclair Éclair " * 50_000), (6, "ab" * 400 + " " + "ab" * 400 + " " + "ab" * 400), (7, "日本planet語 planet×"),
    ]
    assert result(variants.spelling_variants(documents(docs))) == brute(docs)


def test_empty_table(documents):
    assert variants.spelling_variants(documents([])).collect() == []


def test_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "id long, up long")
    assert {tuple(r) for r in variants.follow(links).collect()} == {(i, 40) for i in range(40)}
