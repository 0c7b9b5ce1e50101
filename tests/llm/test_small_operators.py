import base64
import hashlib
import random
import re

import numpy as np
import pytest

from marklens.llm import html_text, language, licenses, mixing, neighbours, quality, warc
from marklens.llm.common import n_words

# --- op1: vectors -----------------------------------------------------------------


def nearest(rows, every, k):
    out = set()
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q)
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])}
    return out


def test_vectors_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    data = [(i, (centres[i % 12] + 0.6 * rng.standard_normal(16)) * rng.uniform(0.5, 2)) for i in range(900)]
    data = [(i, x.astype(np.float32).astype(float)) for i, x in data]
    copy = data[7][1]
    data += [(1000 + i, copy) for i in range(60)]
    df = spark.createDataFrame([(i, x.tolist(), 1, 2.0) for i, x in data], "vec_id long, embedding array<double>, cls int, score double")
    found = neighbours.search(df.repartition(4), every=20, k=10).collect()
    got, want = {(r.query_id, r.rank, r.vec_id) for r in found}, nearest(data, 20, 10)
    assert len(got) == len(found) == len(want)
    pairs = lambda s: {(q, i) for q, _, i in s}
    assert len(pairs(got) & pairs(want)) >= 0.95 * len(want)
    vectors = dict(data)
    for r in found:
        assert r.score == pytest.approx(float(np.dot(vectors[r.query_id], vectors[r.vec_id])), abs=1e-12)
    copies = [r for r in found if r.query_id == 1000]
    assert {(r.rank, r.vec_id) for r in copies} == {t[1:] for t in want if t[0] == 1000}


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.search(df, 20, 20).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.search(df.where("vec_id > 10"), 20, 20).collect() == []


def test_vectors_alone_are_filled(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 16))
    data = [(i, centres[i % 12] + 0.05 * rng.standard_normal(16)) for i in range(1200)]
    # isolated queries between dense clusters: no row is within the radius fitted on the clusters
    data = [(i, 0.5 * rng.standard_normal(16) if i % 200 == 0 else x) for i, x in data]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in data], "vec_id long, embedding array<double>")
    found = neighbours.search(df.repartition(4), every=20, k=20).collect()
    got, want = {(r.query_id, r.rank, r.vec_id) for r in found}, nearest(data, 20, 20)
    assert {t[:2] for t in got} == {t[:2] for t in want} and len(found) == len(want)
    few = neighbours.search(df.where("vec_id < 11 OR vec_id = 200"), every=20, k=20).collect()
    assert {(r.query_id, r.rank) for r in few} == {(q, r) for q in (0, 200) for r in range(1, 12)}


def test_pigeonhole_radii():
    for radius in range(0, 60):
        allowed = neighbours.Coder(np.zeros(1), np.zeros((1, 1)), 1.0, radius).radii()
        # the least total distance that no substring lets through
        assert sum(a + 1 for a in allowed) == radius + 1


# --- op2: languages ---------------------------------------------------------------


def test_languages(documents, spark):
    rng = random.Random(5)
    words = {"en": "the and that with which", "de": "der und nicht auch schön", "fr": "le était dans que où", "es": "el año pero como niño"}
    text = lambda c: " ".join(rng.choice(words[c].split()) for _ in range(40))
    rows = [(i, text(c), c) for i, c in enumerate(list(words) * 25)]
    model = language.train(documents(rows))
    asked = [(1000 + i, text(c), c) for i, c in enumerate(list(words) * 10)]
    found = {r.doc_id: r for r in language.identify(documents(asked), model).collect()}
    assert all(found[i].lang_pred == c and 0 <= found[i].score <= 1 for i, _, c in asked)
    odd = {r.doc_id: r.lang_pred for r in language.identify(documents([(1, None), (2, "12 !?"), (3, "")]), model).collect()}
    assert set(odd.values()) == {"und"}
    assert language.train(documents([(1, "abc", None)])) is None
    assert language.identify(documents([(1, "abc")]), None).collect()[0].lang_pred == "und"
    one = language.train(documents([(1, "abc", "xx")]))
    assert language.identify(documents([(1, "def")]), one).collect()[0].lang_pred == "xx"
    assert language.identify(documents([]), model).collect() == []


# --- op4: licences ----------------------------------------------------------------


def test_licenses(documents, spark):
    mit = licenses.KNOWN["MIT"]
    varied = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace('"', "“").replace("\n", "\n * ")
    rows = [(1, mit), (2, varied), (3, mit + " more"), (4, None), (5, ""), (6, "..."), (7, licenses.KNOWN["ISC"]), (1, mit)]
    found = sorted((r.doc_id, r.license_id) for r in licenses.scan(documents(rows), licenses.known_licenses(spark)).collect())
    assert found == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "ISC")]


# --- op5: pages -------------------------------------------------------------------


def text_of(page):
    return html_text.main_text(page, html_text.grow(*html_text.labelled()))


def test_labelled_table_is_learned():
    x, y = html_text.labelled()
    assert (html_text.decide(html_text.grow(x, y), x) == (y > 0)).all()


def test_article_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page sidebar-left">
    <header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies to do
    many things on this page and that page</div><!-- x --><main><article class="post"><h1>Big&nbsp;title &amp; more</h1>
    <p>First   <b>bold<br>paragraph<p>Unclosed &lt;tag&gt; here</p><script>var t="</p>";</script><div class="ad">Buy now a thing</div>
    <ul><li>Item</li></ul><p>x</p><form><p>Your mail please</p></form><section class="comments"><p>A reader says a lot of words here, and more of it</p></section>
    </article></main><aside>Aside words</aside><div id="disqus_thread">talk</div><footer>&copy; Site</footer></body></html>"""
    want = ["Big title & more", "First bold paragraph", "Unclosed <tag> here", "Item", "x"]
    assert text_of(page) == "\n\n".join(want)


WRAPPERS = (
    'class="layout has-sidebar"', 'class="content-with-sidebar"', 'class="no-sidebar"', 'class="side-by-side"', 'class="post tags"',
    'class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', 'data-hidden="x"', 'class="overlay"', "class='content-sidebar-wrap'",
)


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ("main", "article"))
def test_wrappers_are_not_furniture(wrapper, inner):
    body = "word " * 60
    page = f"<body><div {wrapper}><{inner}><p>{body}</p></{inner}></div><div class='footer'>(c) Site</div>"
    assert text_of(page) == body.strip()


def test_furniture_stays_furniture():
    body, other = "word " * 60, "other " * 60
    for wrapper in ('hidden', 'style="color:red; display: none"', 'class="cookie-notice"', 'id="comments"', 'class="related_posts"', 'class="box sidebar"'):
        page = f"<body><main><p>{body}</p><div {wrapper}><p>{other}</p><article><p>{other}</p></article></div></main>"
        assert text_of(page) == body.strip()
    assert text_of(f"<body><form id='f'><article class='post comment-open'><p>{body}</p></article></form></body>") == body.strip()
    page = f"<body><article><p>{body}</p></article><div class='related'><article><p>{other}</p></article></div><div hidden><main><p>{other}</p></main></div>"
    assert text_of(page) == body.strip()


def test_pages_without_article():
    body = "word " * 40
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><p>{body}</p><p>{body}</p><div class='footer'>(c) Site</div>"
    assert text_of(page) == "\n\n".join([body.strip()] * 2)


def test_page_table(spark):
    rows = [(1, "u", "<article><p>a  b</p></article>"), (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut <b>of</b> &am"), (4, "u", "a plain page")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert found == [(1, "a b", 3), (2, "", 0), (3, "", 0), (4, "a plain page", 12), (4, "cut of &am", 10)]
    assert html_text.extract(df.limit(0)).collect() == []


# --- op6: quality -----------------------------------------------------------------


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def test_quality(documents, spark):
    rng = random.Random(6)
    good = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60)), "en") for i in range(150)]
    bad = [(200 + i, " ".join(f"w{rng.randrange(500)}### $$$" for _ in range(30)), "en") for i in range(150)]
    odd = [(500, None), (501, ""), (502, "é a b c d\né a b c d\n \n\n"), (503, "a\tb\x0bc " * 9000), (504, "x " * 12), (504, "x " * 12)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in good + bad], "doc_id long, quality int, toxic int")
    rows = good + bad + odd
    found = quality.judge(documents(rows), labels).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in found:
        if r.doc_id != 503:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in found if r.kept}
    assert len(kept & {i for i, *_ in good}) > 145 and len(kept & {i for i, *_ in bad}) < 5
    none = quality.judge(documents(good[:3] + odd), labels.limit(0)).collect()
    assert {r.doc_id for r in none if r.kept} == {0, 1, 2}
    assert quality.judge(documents([]), labels).collect() == []


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(800, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(size=800) < 0.2)).astype(float)
    model = quality.fit(x, y, (-1, 0, -1))
    for j in (0, 2):
        grid = np.repeat(x[:50], 30, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 30), 50)
        assert (np.diff(model.score(grid).reshape(50, 30), axis=1) <= 1e-12).all()


# --- op7: archives ----------------------------------------------------------------


def test_archives(spark):
    big = "<p>" + "é" * 200_000
    rows = [(1, "u", "same"), (5, None, "same"), (3, "a\nb", "same"), (2, "u", None), (4, "u", ""), (6, "u", big), (7, "u", "x"), (7, "u", "x"), (None, "u", "same")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    want = set()
    for page, _, html in rows:
        payload = (html or "").encode()
        first = max(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = page != first
        want.add((page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    found = warc.round_trip(df).collect()
    assert len(found) == len(rows) and {tuple(r) for r in found} == want
    assert warc.round_trip(df.limit(0)).collect() == []
    least = warc.with_revisits(df, least=5).where("revisit").collect()
    assert least == []


# --- op8: mixing ------------------------------------------------------------------


def cheapest(patterns, quotas, repeats):
    """Most words routed, by trying every amount (two patterns, two sources)."""
    best = 0
    (p1, n1), (p2, n2) = patterns.items()
    for a in range(repeats * n1 + 1):
        for b in range(repeats * n2 + 1):
            for x in range(a + 1):
                for y in range(b + 1):
                    s = {"a": 0, "b": 0}
                    ok = True
                    for pattern, first, total in ((p1, x, a), (p2, y, b)):
                        for source, words in (("a", first), ("b", total - first)):
                            ok &= words == 0 or source in pattern
                            s[source] += words
                    if ok and all(s[k] <= quotas[k] for k in s):
                        best = max(best, a + b)
    return best


def test_flow_is_maximal_and_spreads_repeats():
    patterns = {("a",): 3, ("a", "b"): 4}
    for quotas in ({"a": 4, "b": 5}, {"a": 9, "b": 1}, {"a": 0, "b": 9}):
        assert sum(mixing.route(patterns, quotas, 2).values()) == cheapest(patterns, quotas, 2)
    # first use of all words is cheaper than a second use of some
    assert mixing.route({("a",): 5, ("a", "b"): 5}, {"a": 10, "b": 0}, 2) == {("a",): 5, ("a", "b"): 5}


def test_targets():
    assert mixing.water_fill([10, 100, 100], [3, 1, 2], 210, 2) == [20, pytest.approx(190 / 3), pytest.approx(380 / 3)]
    assert mixing.water_fill([0, 0], [3, 1], 0, 2) == [0, 0]


def test_mix(documents):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 60), None, rng.choice(("a", "b", "ü", None))) for i in range(800)]
    rows += [(900, None, None, "a"), (901, "", None, None), (902, "w " * 5, None, "b"), (902, "w " * 5, None, "b")]
    found = mixing.mixed_documents(documents(rows)).collect()
    assert len(found) == len(rows)
    again = mixing.mixed_documents(documents(rows, 5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for s, size in sizes.items():
        own = [r for r in found if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert sum({r.source: r.target for r in found}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixing.mixed_documents(documents([])).collect() == []


def test_word_count(documents):
    df = documents([(1, None), (2, ""), (3, "a b c\td"), (4, " x ")]).select("doc_id", n_words().alias("n"))
    assert {r.doc_id: r.n for r in df.collect()} == {1: 0, 2: 0, 3: 3, 4: 1}
