import random
import re

import numpy as np
import pytest
import xxhash

from marklens.llm import simhash


def code(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(codes):
    """Smallest member of each code's component, links at two bits or fewer."""
    up = {c: c for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ordered = sorted(up)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {c: root(c) for c in up}


def brute(docs):
    codes = [(i, code(t)) for i, t, *_ in docs]
    labels = joined(c for _, c in codes)
    least = {}
    for i, c in codes:
        if i is not None:
            least[labels[c]] = min(i, least.get(labels[c], i))
    return sorted(map(repr, ((i, f"{c:016x}", least.get(labels[c])) for i, c in codes)))


def result(df):
    return sorted(map(repr, map(tuple, df.select("doc_id", "fingerprint", "component_id").collect())))


def corpus(seed, n=150):
    rng = random.Random(seed)
    base, docs = [], []
    for i in range(n):
        if base and rng.random() < 0.7:
            words = list(rng.choice(base))
            words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        else:
            words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((1, 2, 3, 40, 300)))]
        base.append(words)
        docs.append((i, rng.choice((" ", "\n", " \t")).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return docs


@pytest.mark.parametrize(("seed", "leaf"), [(1, 256), (2, 4), (3, 1)])
def test_same_as_brute_force(documents, monkeypatch, seed, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    docs = corpus(seed)
    assert result(simhash.near_duplicates(documents(docs))) == brute(docs)


@pytest.mark.parametrize("leaf", [3, 16, 256])
def test_codes_at_all_distances(spark, monkeypatch, leaf):
    """Clusters of codes around a few centres: links through several leaves and levels."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(leaf)
    codes = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
            codes.add(centre ^ flips)
            centre = centre ^ flips if rng.random() < 0.2 else centre
    signed = {c: c - (1 << 64) if c >> 63 else c for c in codes}
    table = spark.createDataFrame([(s,) for s in signed.values()], "code long").repartition(4)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table).collect()]
    up = {c: c for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert {c: root(c) for c in codes} == joined(codes)


def test_gray_order(spark):
    codes = [r ^ (r >> 1) for r in range(64)] + [(1 << 63) | 5, (1 << 64) - 1]
    table = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    rank = simhash.gray_rank(table["code"])
    ordered = [r.code % (1 << 64) for r in table.orderBy(rank).collect()]
    assert ordered[:64] == codes[:64]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(ordered[:63], ordered[1:64], strict=True))


def test_nulls_empties_long_texts_and_repeated_rows(documents):
    rng = random.Random(9)
    long = " ".join(f"q{rng.randrange(10**6)}" for _ in range(40_000))
    docs = [
        (3, None), (2, ""), (None, " \n"), (4, "one"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "alone here"), (7, long), (8, long + " end"),
        (9, "É a b c"), (10, "é a b c"), (11, " "),
    ]
    assert result(simhash.near_duplicates(documents(docs))) == brute(docs)


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []


def test_majority():
    words = [f"v{i}" for i in range(1000)]
    assert simhash.fingerprint(" ".join(words).encode()) % (1 << 64) == code(" ".join(words))
    assert simhash.fingerprint(None) == simhash.fingerprint(b" ") == 0
    assert np.bitwise_count(np.uint64(code("a b c") ^ code("a b c"))) == 0
