"""Language identification: family first, then pairwise separation inside it.

Texts become weighted character-gram vectors of fixed width. A linear classifier per
family picks the family; inside it one linear support vector machine per pair of
languages votes. Families come from a table of language codes, languages from the
labels seen in training.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

WIDTH = 4096
GRAMS = (1, 2, 3)
#: Training texts per language, and in all, at most (smallest key hashes).
PER_LANGUAGE = 400
TRAIN_ROWS = 4000

# ISO 639-1 codes by language family; other codes stand alone.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la co",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn mr gu pa ne si or as ur",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "semitic": "ar he am mt",
    "turkic": "tr az kk ky uz tk tt ug",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, f"only {lang}")


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def vector(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Unit vector of the text's character grams; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after each word
    codes = np.concatenate([np.array([32], np.uint32), codes[keep]])
    count = np.zeros(WIDTH)
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        count += np.bincount(h >> np.uint32(20), minlength=WIDTH)
    weight = np.log1p(count)
    return (weight / np.sqrt((weight * weight).sum())).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a squared-hinge machine for labels -1 and 1.

    Both classes weigh the same in all; accelerated gradient steps of fixed number.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1.0 / (1.0 + 2 * cost * 2.0)
    w = ahead = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = ahead - 2 * cost * (x.T @ (share * y * slack))
        new = ahead - step * gradient
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class Model:
    """Families with one classifier each, and pairs of languages inside a family."""

    families: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray
    pairs: tuple[tuple[str, str], ...]
    pair_weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score in 0..1 per row of unit vectors."""
        ones = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
        margin = ones @ self.family_weights.T
        pair_margin = ones @ self.pair_weights.T
        where = {p: i for i, p in enumerate(self.pairs)}
        names, scores = [], np.ones(len(x))
        best = margin.argmax(1)
        second = np.sort(margin, 1)[:, -2] if margin.shape[1] > 1 else margin[:, 0] - 10
        for i, f in enumerate(best.tolist()):
            members = self.families[f]
            wins = dict.fromkeys(members, (0, 0.0))
            for a, b in combinations(members, 2):
                m = pair_margin[i, where[a, b]]
                for lang, own in ((a, m), (b, -m)):
                    votes, total = wins[lang]
                    wins[lang] = (votes + (own > 0), total + own)
            lang = max(members, key=lambda c: (*wins[c], c))
            least = min((abs(pair_margin[i, where[tuple(sorted((lang, o)))]]) for o in members if o != lang), default=10.0)
            names.append(lang)
            scores[i] = 1 / (1 + np.exp(-2 * min(margin[i, f] - second[i], 50))) / (1 + np.exp(-2 * min(least, 50)))
        return names, scores


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """Train all classifiers; None without any label."""
    known = sorted(set(langs))
    if not known:
        return None
    lang = np.array(langs)
    groups: dict[str, list[str]] = {}
    for code in known:
        groups.setdefault(family_of(code), []).append(code)
    families = tuple(tuple(g) for _, g in sorted(groups.items()))
    zero = np.zeros(WIDTH + 1)
    one_against_rest = [
        linear_svm(x, np.where(np.isin(lang, f), 1.0, -1.0)) if len(families) > 1 else zero for f in families
    ]
    pairs = tuple(p for f in families for p in combinations(f, 2))
    weights = []
    for a, b in pairs:
        rows = np.isin(lang, (a, b))
        weights.append(linear_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0)))
    return Model(families, np.stack(one_against_rest), pairs, np.stack(weights) if pairs else np.zeros((0, WIDTH + 1)))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``per_language`` texts a language and ``rows`` in all.

    ``docs``: doc_id, text, lang. The texts with the smallest key hashes are taken;
    only lang is read to choose them.
    """
    spark = docs.sparkSession
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    keys = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    keys = keys.withColumn("_rank", rank).where(F.col("_rank") <= per_language).orderBy("_rank", "lang").limit(rows)
    chosen = [r[0] for r in keys.select("doc_id").distinct().collect()]  # at most ``rows``
    picked = F.broadcast(spark.createDataFrame([(c,) for c in chosen], "doc_id long"))

    def run(batches):
        letters = letter_table()
        for batch in slices(batches, 64):
            pairs = zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)
            found = [(v.tobytes(), lang) for v, lang in ((vector(t or "", letters), lang) for t, lang in pairs) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())],
                ["vector", "lang"],
            )

    sample = (
        docs.where("lang IS NOT NULL").select("doc_id", "text", "lang").join(picked, "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "lang"]).select("text", "lang")
        .mapInArrow(run, "vector binary, lang string").collect()
    )
    sample.sort(key=lambda r: (r[1], r[0]))
    x = np.frombuffer(b"".join(r[0] for r in sample), np.float32).reshape(-1, WIDTH)
    return fit(x, [r[1] for r in sample])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text (only the text is read).

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.
    """

    def run(batches):
        letters = letter_table()
        for batch in slices(batches, 256):
            found = [vector(t or "", letters) for t in batch.column("text").to_pylist()]
            rows = [i for i, v in enumerate(found) if v is not None and model is not None]
            names, scores = ["und"] * len(found), np.zeros(len(found))
            if rows:
                langs, values = model.predict(np.stack([found[i] for i in rows]))
                for i, lang, value in zip(rows, langs, values, strict=True):
                    names[i], scores[i] = lang, value
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
