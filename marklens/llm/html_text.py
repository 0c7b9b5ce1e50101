"""Main text of pages: flat text blocks and a trained decision tree.

A page becomes a flat list of text blocks. Each block has its number of words and its
link density, those of its neighbours, and what the mark-up around it says. A decision
tree grown on a small labelled table tells article text from the rest.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element kinds of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul caption".split()
)
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math object select head title button canvas audio video xmp noembed noframes".split())
#: Of these, what runs to the end of the page if it is not closed; others then hide nothing.
TO_THE_END = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Only elements of other languages close themselves with a slash.
FOREIGN_TAGS = frozenset("svg math".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTER_TAGS = frozenset("nav header footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
SCOPE_TAGS = frozenset("article main section nav header footer aside form menu dialog div ul ol dl table td figure details blockquote body".split())

# Words in class, id and role that name page furniture; each is a whole part of a name.
HINT = re.compile(
    r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|sidebar|side|widget|related|recommend\w*|share|sharing|social|comment\w*|"
    r"disqus|repl(?:y|ies)|respond|discussion|menu|nav\w*|breadcrumb\w*|pagination|pager|toolbar|footer|header|masthead|"
    r"copyright|navigation|complementary|contentinfo|search|tags|paywall|warning",
    re.I,
)
#: Furniture in which an <article> is a teaser or a comment, not the page's own.
FOREIGN = re.compile(r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|widget|related|recommend\w*|comment\w*|disqus|repl(?:y|ies)|respond|discussion", re.I)
#: Words that make a name say how a page is laid out ("has-sidebar", "side-by-side").
LAYOUT = frozenset("has no with without by layout".split())
#: Names of an article itself; beside one of them the WEAK words are subjects or styles ("post tags").
OWN, WEAK = frozenset("post article entry hentry story".split()), frozenset("tags side search notice alert warning".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outer", "hinted", "inside", "page_has_main")

# The labelled table: one block per row in the order of FEATURES, then 1 for main text.
# Links are shares of a block's words; outer, hinted, inside and page_has_main are 0 or 1.
LABELLED = """
6 0 6 1 60 0 0 0 1 1 1
60 0 6 0 80 0 0 0 1 1 1
1 0 40 0 35 0 0 0 1 1 1
1 0 1 0 1 0 0 0 1 1 1
12 0 1 0 90 0.1 0 0 1 1 1
90 0.1 12 0 2 0 0 0 1 1 1
150 0.02 30 0 8 0.9 0 0 1 1 1
3 1 50 0 60 0 0 0 1 1 1
20 0.6 50 0 60 0 0 0 1 1 1
40 0 0 0 0 0 0 0 1 1 1
2 0 0 0 0 0 0 0 1 1 1
25 0 80 0 7 0.3 0 0 1 1 1
7 0.2 25 0 5 0 1 0 0 1 0
5 1 5 1 5 1 1 0 0 1 0
1 1 0 0 1 1 1 0 0 1 0
9 0 1 1 6 0 0 1 0 1 0
30 0 4 1 50 0 0 1 0 1 0
80 0 20 0 10 0 0 1 0 1 0
14 0 70 0 0 0 1 0 0 1 0
60 0 90 0 2 1 1 0 0 1 0
22 0 80 0 3 0 0 1 1 1 0
45 0 45 0 45 0 0 1 1 1 0
4 1 45 0 60 0 0 1 1 1 0
8 0.5 60 0 9 0 1 0 1 1 0
50 0 70 0 30 0 1 0 1 1 0
18 0 6 1 30 0 0 0 0 1 0
70 0 60 0 12 0 0 0 0 1 0
3 0 60 0 0 0 0 0 0 1 0
2 1 2 1 2 1 0 0 0 1 0
6 1 6 1 6 1 0 0 0 0 0
2 1 3 1 2 1 0 0 0 0 0
1 1 0 0 1 1 0 0 0 0 0
4 0.8 2 1 40 0 0 0 0 0 0
12 0.9 14 0.8 10 1 0 0 0 0 0
30 0.7 12 0.9 60 0 0 0 0 0 0
3 0 3 1 2 1 0 0 0 0 0
2 0 0 0 1 1 0 0 0 0 0
60 0 5 0 80 0 0 0 0 0 1
80 0.05 60 0 4 1 0 0 0 0 1
40 0 5 1 35 0.1 0 0 0 0 1
9 0 60 0 50 0 0 0 0 0 1
2 0 45 0 45 0 0 0 0 0 1
6 0 3 1 55 0 0 0 0 0 1
7 0 70 0 2 1 0 0 0 0 1
5 0 0 0 32 0 0 0 0 0 1
4 0 6 1 25 0 0 0 0 0 1
3 0 8 0.9 40 0 0 0 0 0 1
6 0 9 1 9 0 0 0 0 0 1
32 0 5 0 32 0 0 0 0 0 1
32 0 32 0 32 0 0 0 0 0 1
32 0 32 0 3 0 0 0 0 0 1
25 0 25 0.1 5 1 0 0 0 0 1
20 0 0 0 20 0 0 0 0 0 1
20 0 20 0 20 0 0 0 0 0 1
20 0.2 20 0 0 0 0 0 0 0 1
60 0 1 1 60 0 0 0 0 0 1
60 0 60 0 60 0 0 0 0 0 1
60 0 60 0 40 0 0 0 0 0 1
14 0.3 20 0 20 0 0 0 0 0 1
10 0 30 0 30 0 0 0 0 0 1
9 0 9 0 9 0 0 0 0 0 1
4 0 22 0 24 0 0 0 0 0 1
2 0 30 0 18 0 0 0 0 0 1
1 1 0 0 60 0 0 0 0 0 0
2 1 0 0 20 0 0 0 0 0 0
2 1 0 0 40 0 0 0 0 0 0
3 1 0 0 120 0 0 0 0 0 0
1 1 2 0 8 0 0 0 0 0 0
2 1 60 0 0 0 0 0 0 0 0
3 1 120 0 2 1 0 0 0 0 0
2 1 40 0 30 0 0 0 0 0 0
40 0 2 1 40 0 0 0 0 0 1
60 0 60 0 0 0 0 0 0 0 1
60 0 0 0 60 0 0 0 0 0 1
120 0 130 0 0 0 0 0 0 0 1
120 0 1 1 100 0 0 0 0 0 1
150 0.05 3 0 140 0 0 0 0 0 1
15 0 14 0 0 0 0 0 0 0 1
15 0 1 1 14 0 0 0 0 0 1
8 0 8 0 3 1 0 0 0 0 1
8 0 4 0 7 0 0 0 0 0 1
5 0 9 0 2 0 0 0 0 0 1
4 1 60 0 3 1 0 0 0 0 0
5 0.8 32 0 0 0 0 0 0 0 0
7 0.9 1 1 30 0 0 0 0 0 0
20 0.9 20 0 20 0 0 0 0 0 0
20 0 0 0 0 0 0 0 0 0 1
3 0 0 0 0 0 0 0 0 0 1
30 0 40 0 40 0 1 0 0 0 0
8 0 5 1 5 1 1 0 0 0 0
30 0 40 0 40 0 0 1 0 0 0
5 0 5 1 70 0 0 1 0 0 0
2 0 40 0 0 0 0 1 0 0 0
3 0 60 0 0 0 1 0 0 0 0
9 0 30 0 20 0 0 1 0 0 0
12 0 45 0 60 0 1 0 0 0 0
"""  # fmt: skip


#: Features that are asked first: a block for which one holds is never main text. So the
#: tree is monotone in them, whatever the numbers around a block are.
FURNITURE = (FEATURES.index("outer"), FEATURES.index("hinted"))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> list[tuple]:
    """Decision tree by Gini impurity as a list of (feature, threshold, left, right, value)."""
    nodes: list[tuple] = []
    for j in FURNITURE:
        at = len(nodes)
        nodes += [(j, 0.5, at + 2, at + 1, 0.5), (-1, 0.0, -1, -1, 0.0)]
        x, y = x[x[:, j] == 0], y[x[:, j] == 0]

    def build(rows: np.ndarray, left_depth: int) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        best = None
        if left_depth and 0 < share < 1:
            for j in range(x.shape[1]):
                seen = np.unique(x[rows, j])
                for t in (seen[1:] + seen[:-1]) / 2:
                    side = x[rows, j] <= t
                    a, b = y[rows[side]], y[rows[~side]]
                    impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, j, float(t), side)
        if best:
            _, j, t, side = best
            nodes[at] = (j, t, build(rows[side], left_depth - 1), build(rows[~side], left_depth - 1), share)
        return at

    build(np.arange(len(y)), depth)
    return nodes


def decide(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """True for main text, per row of features."""
    table = np.array(nodes)
    at = np.zeros(len(x), np.int64)
    while True:
        feature = table[at, 0].astype(np.int64)
        inner = feature >= 0
        if not inner.any():
            return table[at, 4] >= 0.5
        value = x[np.arange(len(x)), np.maximum(feature, 0)]
        step = np.where(value <= table[at, 1], table[at, 2], table[at, 3]).astype(np.int64)
        at = np.where(inner, step, at)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line])
    return table[:, :-1], table[:, -1]


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """Flat text blocks: (text, linked words, outer, hinted, inside an article)."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    scopes: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    in_link = False
    unclosed: set[str] = set()

    def close() -> None:
        whole = " ".join("".join(text).split())
        if whole:
            _, outer, hinted, inside = scopes[-1]
            out.append((whole, len("".join(linked).split()), outer, hinted > 0, inside))
        text.clear()
        linked.clear()

    def add(chunk: str) -> None:
        if chunk:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            text.append(chunk)
            if in_link:
                linked.append(chunk)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW_TAGS and not closing:
            if name in FOREIGN_TAGS and attributes.rstrip().endswith("/"):
                continue
            close_tag = None if name in unclosed else _closing(name).search(page, at)
            if not close_tag:
                unclosed.add(name)  # nor is there one further on
            if name == "head" and not close_tag:
                close_tag = re.compile(r"(?=<body)", re.I).search(page, at)
            at = close_tag.end() if close_tag else end if name in TO_THE_END else at
            continue
        if name == "a":
            in_link = not closing
            linked.append(" ")  # neighbouring links are words of their own
        elif name == "br":
            text.append(" ")
            linked.append(" ")
        if name not in BLOCK_TAGS and name not in SCOPE_TAGS:
            if not closing and name not in VOID_TAGS and _hinted(attributes) and name != "a":
                close()  # furniture set in an inline element
                scopes.append((name, scopes[-1][1], max(_hinted(attributes), scopes[-1][2]), scopes[-1][3]))
            elif closing and scopes[-1][0] == name:
                close()
                scopes.pop()
            continue
        close()
        if name != "a" and name in SCOPE_TAGS:
            in_link = False
        if closing:
            for i in range(len(scopes) - 1, 0, -1):
                if scopes[i][0] == name:
                    del scopes[i:]
                    break
        elif name not in VOID_TAGS and (name in SCOPE_TAGS or _hinted(attributes)):
            _, outer, hinted, inside = scopes[-1]
            body = name in ("body", "html")
            own = 0 if body else _hinted(attributes)
            if name in MAIN_TAGS and not inside:
                # the page's own text: a wrapper counts if it is hidden or, for an article, holds those of others
                outer = name == "article" and any(s[0] in OUTER_TAGS and s[0] != "form" for s in scopes)
                hinted = hinted if hinted > (1 if name == "article" else 2) else 0
                own = own if own > 2 else 0
            scopes.append((name, outer or name in OUTER_TAGS, max(hinted, own), inside or name in MAIN_TAGS))
    close()
    return out


@functools.cache
def _closing(name: str) -> re.Pattern:
    """Closing tag of one of the RAW_TAGS."""
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


@functools.lru_cache(1 << 16)
def _hinted(attributes: str) -> int:
    """0: nothing said; 1: furniture; 2: furniture with articles of others; 3: hidden."""
    level = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NOT_SHOWN.search(value)):
            return 3
        if name in ("class", "id", "role"):
            tokens = value.lower().split()
            own = not OWN.isdisjoint(tokens)
            for token in tokens:
                parts = re.split("[_-]+", token)
                if not LAYOUT.isdisjoint(parts) or {"content", "wrap"} <= set(parts) or (own and token in WEAK):
                    continue
                if any(map(HINT.fullmatch, parts)):
                    level = max(level, 2 if any(map(FOREIGN.fullmatch, parts)) else 1)
    return level


def main_text(page: str, nodes: list[tuple]) -> str:
    found = blocks(page)
    if not found:
        return ""
    words = np.array([len(b[0].split()) for b in found], float)
    links = np.array([b[1] for b in found], float) / np.maximum(words, 1)
    flags = np.array([b[2:] for b in found], float)
    pad = lambda v: np.concatenate([[0.0], v, [0.0]])
    w, k = pad(words), pad(links)
    has_main = np.full(len(found), float(flags[:, 2].any()))
    x = np.column_stack([words, links, w[:-2], k[:-2], w[2:], k[2:], flags, has_main])
    keep = decide(nodes, x)
    return "\n\n".join(b[0] for b, yes in zip(found, keep.tolist(), strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page from its whole HTML.

    A null or empty page gives an empty text; mark-up cut off at the end of a page is
    dropped; repeated rows stay.
    """

    def run(batches):
        nodes = grow(*labelled())
        for batch in slices(batches, 128):
            texts = [main_text(p, nodes) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
