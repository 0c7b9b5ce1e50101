import hashlib
import random
import re

import pytest

from marklens.llm.substring_dedup import DEPTH, WINDOW, dedup, repeats, without_repeats


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width=20):
    texts = {i: words_of(t) for i, t, *_ in rows}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - width + 1):
            first.setdefault(tuple(texts[i][p : p + width]), (i, p))
    out = set()
    for i, w in texts.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] != (i, p):
                gone.update(range(p, p + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def result(df):
    return {tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ABC", "abc"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice((19, 20, 21, 50)))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 5, 19, 20, 60)))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if rng.random() < 0.2:
            words += ["again", "and"] * rng.choice((9, 10, 25))
        rows.append((i * 3 + 1, rng.choice((" ", "\n\n")).join(words)))
    return rows


@pytest.mark.parametrize("seed,group", [(1, 1 << 20), (2, 4)])
def test_same_as_brute_force(documents, seed, group):
    rows = corpus(seed)
    assert result(dedup(documents(rows), group)) == brute(rows)


def brute_nodes(rows):
    """Inner nodes of the suffix tree of all texts, cut at DEPTH, from WINDOW on."""
    places, follow = {}, {}
    for i, text in rows:
        words = words_of(text)
        for p in range(len(words)):
            for d in range(WINDOW, min(DEPTH, len(words) - p) + 1):
                key = tuple(words[p : p + d])
                places.setdefault(key, []).append((i, p))
                follow.setdefault(key, []).append(words[p + d] if p + d < len(words) else (i, p))
    return sorted(
        (len(key), len(at), *min(at))
        for key, at in places.items()
        if len(at) > 1 and (len(key) == DEPTH or len(set(follow[key])) > 1)
    )


@pytest.mark.parametrize("seed", [3, 4])
def test_nodes_same_as_brute_force(documents, seed):
    rows = corpus(seed)
    copy = " ".join(f"c{i}" for i in range(70))
    rows += [(1001, copy), (1002, copy), (1003, copy + " end"), (1004, "x " + copy)]
    found = repeats(documents(rows).repartition(3)).select("depth", "occurrences", "doc", "pos").collect()
    assert sorted(tuple(r) for r in found) == brute_nodes(rows)
    assert repeats(documents([])).collect() == []


def test_edge_cases(documents):
    line = " ".join(f"x{i}" for i in range(20))
    long = " ".join(f"y{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, line), (4, line), (5, line + " tail"), (6, long), (7, long), (8, line[:-1])]
    assert result(dedup(documents(rows))) == brute(rows)
    # rows repeated with one id are one place
    again = [(3, line), (3, line), (9, line)]
    assert sorted(r.n_removed for r in dedup(documents(again)).collect()) == [0, 0, 20]
    # a null id comes last
    nulls = {r.doc_id: r.n_removed for r in dedup(documents([(None, line), (5, line)])).collect()}
    assert nulls == {None: 20, 5: 0}
    assert dedup(documents([])).collect() == []


def test_texts_without_repeats(documents):
    line = " ".join(f"x{i}" for i in range(20))
    docs = documents([(1, "a\nb " + line), (2, "c  " + line + "\nd"), (3, None)])
    out = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(docs).collect()}
    assert out == {1: ("a\nb " + line, len(line) + 4), 2: ("c d", 3), 3: (None, 0)}
    assert without_repeats(docs).columns == docs.columns
