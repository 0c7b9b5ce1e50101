"""Spelling variants by permuterm rotations.

A word is marked by a terminator and rotated in all ways. A rotation without its last
character is the word around one skipped character; words of one length that share it
differ by a replacement there, and a word one character shorter has it as a whole
rotation, which is an insertion or deletion. So every near pair meets in one group of
rotations with a common beginning. A group holds one word per skipped character, and a
character deleted from a run of equal ones counts at the run's start only: each pair
meets exactly once, and counts and best neighbours add up over groups without a list of
pairs.

Defined cases: null and empty texts hold no words; a null doc_id counts as an empty id in
the hash; repeated rows count again. Very long texts are read whole. An empty table has
no words. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHE_WORDS, slices, stored

#: Latin-1 letters stay, A-Z become a-z, the rest separates. One byte per code point.
LETTERS = bytes(
    b if 0x61 <= b <= 0x7A or b >= 0xC0 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: One occurrence in so many loses a code point.
THINNED = 97
LENGTH, OCCURRENCES = 5, 3
#: Words that a task counts before it hands them on.
HELD = 200_000


class Utf8(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = word.decode("latin-1").encode()
        return value


def _count(total: Counter, doc: str, text: str | None, utf8: Utf8) -> None:
    """Add a document's words; a run whose hash 97 divides loses a code point first."""
    words = (text or "").encode("latin-1", "replace").translate(LETTERS).split()
    total.update(words)
    runs = list(set(words))
    hashes = np.fromiter(map(crc32, map(utf8.__getitem__, runs), repeat(crc32(f"{doc}:".encode()))), np.int64, len(runs))
    hit = np.flatnonzero(hashes % THINNED == 0)
    if len(hit):
        times = Counter(words)
        for i in hit:
            run, at = runs[i], int(hashes[i]) % len(runs[i])
            total[run] -= times[run]
            total[run[:at] + run[at + 1 :]] += times[run]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with enough code points and occurrences."""

    def batch_of(total: Counter) -> pa.RecordBatch:
        kept = [(w.decode("latin-1"), n) for w, n in total.items() if n > 0 and len(w) >= LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches):
        total, utf8 = Counter(), Utf8()
        for batch in slices(batches, 128):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                _count(total, doc, text, utf8)
                if len(total) > HELD:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    counted = docs.select(doc, F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def ranked(words: DataFrame) -> DataFrame:
    """(id, word, n): a smaller id for a more frequent word, ties in code-point order."""
    ordered = stored(words, "variant-counts").orderBy(F.desc("n"), "word")
    return stored(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "variant-words")


def rotations(words: DataFrame) -> DataFrame:
    """(key, id, kind): whole rotations (0) and rotations without their last character,
    which is in a run of equal characters (1) or at a run's start (2)."""
    rotation = "substring(d, j + 1, l + 1)"
    skipped = "named_struct('key', substring(d, j + 1, l), 'kind', IF(j > 1 AND substring(d, j, 1) = substring(d, j - 1, 1), 1, 2))"
    whole = f"named_struct('key', {rotation}, 'kind', 0)"
    both = f"explode(flatten(transform(sequence(0, l), j -> IF(j = 0, array({whole}), array({whole}, {skipped})))))"
    doubled = words.select("id", F.concat("word", F.lit("$"), "word").alias("d"), F.length("word").alias("l"))
    return doubled.select("id", F.expr(both).alias("r")).select("id", "r.key", "r.kind")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): near words of every word that has any, and the first of them by id.

    ``best`` may leave out words that are not ahead of the word itself; it is the first
    near word whenever that one has a smaller id.
    """
    group = Window.partitionBy("key")
    among = rotations(words).withColumns({
        "skips": F.count(F.expr("IF(kind > 0, 1, NULL)")).over(group),
        "starts": F.count(F.expr("IF(kind = 2, 1, NULL)")).over(group),
        "whole": F.min(F.expr("IF(kind = 0, id, NULL)")).over(group),
        "first": F.min(F.expr("IF(kind > 0, id, NULL)")).over(group),
        "first_start": F.min(F.expr("IF(kind = 2, id, NULL)")).over(group),
    })
    met = among.select(
        "id",
        F.expr("IF(kind = 0, starts, skips - 1 + IF(kind = 2 AND whole IS NOT NULL, 1, 0))").alias("near"),
        F.expr("IF(kind = 0, first_start, least(IF(first <> id, first, NULL), IF(kind = 2, whole, NULL)))").alias("best"),
    )
    return met.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(id, root) for (id, up) links that form no circle: the last word reached.

    Each round doubles the steps taken. A form is at least twice as frequent as its word,
    so a path has at most 62 steps and six rounds follow all.
    """
    while True:
        further = links.select(F.col("id").alias("up"), F.col("up").alias("next"))
        links = stored(links.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not links.where("moved").head(1):
            return links.select("id", F.col("up").alias("root"))
        links = links.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = ranked(word_counts(docs))
    near = stored(near_words(words), "variant-near")
    ahead = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    forms = near.join(ahead, "best").join(words.select("id", "n"), "id").where("form_n >= 2 * n")
    forms = stored(forms.select("id", F.col("best").alias("up"), "form", "form_n"), "variant-forms")
    last = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    roots = follow(forms.select("id", "up")).join(last, "root").select("id", "root_word")
    out = words.join(near.drop("best"), "id", "left").join(forms, "id", "left").join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def oracle() -> str:
    """DuckDB SQL of the same; CRC-32 by the byte table of its polynomial."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
run AS MATERIALIZED (
  SELECT doc_id, r, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  GROUP BY doc_id, r),
hashed AS (
  SELECT r, c, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
                           lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295)) AS h
  FROM run, crc),
word AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
del AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word FROM del d JOIN word w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM del d JOIN word w ON d.rest = w.word),
best AS (
  SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS r
  FROM near JOIN word ON word.word = other),
form AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.n >= 2 * w.n THEN other END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM word w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
path(word, last) AS (SELECT word, word FROM form UNION ALL SELECT p.word, f.form FROM path p JOIN form f ON f.word = p.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.last AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM form f JOIN path p ON p.word = f.word JOIN form e ON e.word = p.last AND e.form IS NULL"""
