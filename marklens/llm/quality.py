"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled documents with histogram splits,
flattened into arrays (feature, threshold, leaf value) and scored for whole Arrow
batches at once. Chosen features carry monotonic constraints: with all else equal, more
repetition, symbols or repeated lines never raises the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, raw, slices, stored

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: Labelled documents used for training at most (those with the smallest key hashes).
TRAIN_ROWS = 20_000

FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share",
    "upper_share", "digit_share", "punct_share", "line_words", "type_share", "top_share",
)
#: -1: the score never rises with the feature, 0: free.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_PUNCT = b"!\"'(),-./:;?@[\\]^_`{}~+="


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: np.ndarray, width: int = WINDOW) -> int:
    """Words inside runs of ``width`` words that occur twice or more."""
    grams = gram_hashes(words, width)
    if not len(grams):
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes, chars: int, cache: WordHashes) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one text (``chars``: code points)."""
    words = text.split()
    n = len(words)
    hashes = cache.array(words)
    word_chars = chars - _without(text, SPACE)
    symbols = _without(text, SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(hashes)
    counts = np.unique(hashes, return_counts=True)[1] if n else np.zeros(0)
    w, c = max(n, 1), max(word_chars, 1)
    return [n, word_chars, symbols, dup_lines, repeats], [
        float(np.log1p(n)), word_chars / w, symbols / c, dup_lines / max(len(lines), 1), repeats / w,
        _without(text, _UPPER) / c, _without(text, _DIGIT) / c, _without(text, _PUNCT) / c,
        n / max(len(lines), 1), len(counts) / w, float(counts.max() if n else 0) / w,
    ]


def statistics(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts and ``features`` of every whole text.

    A null text counts as empty: all counts 0. ``carried`` names long columns to hand on.
    """

    def run(batches):
        cache = WordHashes()
        for batch in slices(batches):
            texts = [t or b"" for t in raw(batch, "text")]
            lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            found = [measure(t, k, cache) for t, k in zip(texts, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", *carried)),
                    *(pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))),
                    pa.array([f[1] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", *carried, *COUNTS, "features"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), *carried, F.col("text").cast("string"))
    kinds = ", ".join(f"{c} long" for c in ("doc_id", *carried, *COUNTS))
    return narrow.mapInArrow(run, f"{kinds}, features array<double>")


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth as node arrays; row per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality per row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: tuple[int, ...] = MONOTONE,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 32,
    ridge: float = 1.0,
) -> Trees:
    """Boosted trees for 0/1 labels under monotonic constraints.

    A split on a constrained feature is taken only if its two values stand in the
    asked order; their mean then bounds everything below either side.
    """
    if not len(y) or y.min() == y.max():
        base = 20.0 if not len(y) or y[0] else -20.0
        return Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, inner = np.full(len(y), base), 2**depth - 1
    out = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        leaf = np.zeros(inner + 1)
        rows, bound = {0: np.arange(len(y))}, {0: (-np.inf, np.inf)}
        for node in range(inner):
            own, (low, high) = rows[node], bound[node]
            best = (1e-6, None)
            g, h = grad[own].sum(), hess[own].sum()
            for j, cut in enumerate(cuts):
                if not len(cut) or not len(own):
                    continue
                gl = np.bincount(code[own, j], grad[own], len(cut) + 1).cumsum()[:-1]
                hl = np.bincount(code[own, j], hess[own], len(cut) + 1).cumsum()[:-1]
                left = np.clip(gl / (hl + ridge), low, high)
                right = np.clip((g - gl) / (h - hl + ridge), low, high)
                gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                ordered = (right - left) * monotone[j] >= 0
                gain = np.where(ordered & (hl > 1) & (h - hl > 1), gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, left[k], right[k]))
            if best[1]:
                j, k, left_value, right_value = best[1]
                feature[node], threshold[node] = j, cuts[j][k]
                goes = code[own, j] > k
                middle = (left_value + right_value) / 2
                left_bound, right_bound = (low, high), (low, high)
                if monotone[j]:
                    upper, lower = (low, middle), (middle, high)
                    left_bound, right_bound = (upper, lower) if monotone[j] > 0 else (lower, upper)
            else:
                goes, left_bound, right_bound = np.zeros(len(own), bool), (low, high), (low, high)
            for child, sel, limits in ((2 * node + 1, ~goes, left_bound), (2 * node + 2, goes, right_bound)):
                rows[child], bound[child] = own[sel], limits
        for k in range(inner + 1):
            own = rows[inner + k]
            low, high = bound[inner + k]
            value = float(np.clip(grad[own].sum() / (hess[own].sum() + ridge), low, high))
            leaf[k] = rate * value
            total[own] += leaf[k]
        out.append((feature, threshold, leaf))
    return Trees(*(np.stack([t[i] for t in out]) for i in range(3)), base)


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents, the smallest by key hash."""
    known = labels.select(F.col("doc_id").cast("long"), "quality").where("quality IN (0, 1)").distinct()
    sample = (
        known.join(stats.select("doc_id", "features"), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features")
        .limit(rows)
        .select("features", "quality")
        .collect()
    )
    x = np.array([r[0] for r in sample], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in sample], float))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, carried: tuple[str, ...] = ()) -> DataFrame:
    """Base counts, rule verdict, score and ``kept`` per document row.

    ``carried`` names long columns of ``docs`` to hand on.

    Edge cases: a null or empty text has no words and fails the base rules; repeated
    rows give repeated results; without labels of both kinds only the base rules (and
    the one label seen) decide; an empty table gives an empty result.
    """
    stats = stored(statistics(docs, carried), "quality-statistics")
    model = train(stats, labels)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "features"]
            names = [n for n in batch.schema.names if n != "features"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x))], [*names, "score"])

    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")
    )
    kinds = ", ".join(f"{c} long" for c in ("doc_id", *carried, *COUNTS))
    return (
        stats.mapInArrow(run, f"{kinds}, score double")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
