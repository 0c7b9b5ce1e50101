"""Ranked lexical search over an index stratified by document length.

Documents whose length gives the same normaliser m form a stratum. Within one, a term
weighs the same in all documents with the same tf, so its postings lie in blocks of one
tf and a block's impact is computed once. From the largest tf of each term in a stratum
follows what a document there can score at most: every item visits its most promising
strata first, and afterwards only those whose bound reaches the score of its k-th best
document so far.

Defined cases: a null or empty text (or one without a term) is no candidate and counts
in neither N nor L. Rows with a null doc_id count and rank like others, after equal
scores with an id; repeated rows are candidates each. Rows with one item_id (null
included) are one item with the terms of all of them. An item without a known term has no
rows; neither has an empty table. Very long texts are read whole. Terms are told apart by
their 64-bit hashes. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marklens.session import spread

from .common import CACHE_WORDS, raw, slices, stored

#: Bytes of a term stay (digits, letters, all beyond ASCII), A-Z become a-z, the rest separates.
TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
#: Bits of the filter of asked terms (a fixed size; a full one only keeps more postings).
FILTER_BITS = 1 << 22
#: Postings in a segment of a stratum, and terms in a block of items, about.
POSTINGS, ASKED = 1 << 19, 100_000
#: Parts of the term score.
SCALE, SLOPE = 1_000_000_000, 12


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


class TermKeys(dict):
    """Signed 64-bit key per term; 0 for terms that the filter rules out."""

    def __init__(self, mask: np.ndarray | None = None):
        self.mask = mask

    def __missing__(self, term: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        key = xxhash.xxh64_intdigest(term) or 1
        at = key % FILTER_BITS
        if self.mask is not None and not int(self.mask[at >> 5]) >> (at & 31) & 1:
            key = 0
        self[term] = key = key - (1 << 64) if key >> 63 else key
        return key

    def counts(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Terms in all; the kept keys with their number of occurrences."""
        terms = terms_of(text)
        keys = np.fromiter(map(self.__getitem__, terms), np.int64, len(terms))
        return len(terms), *np.unique(keys[keys != 0], return_counts=True)


def asked_terms(items: DataFrame) -> DataFrame:
    """(item, key, times): the terms of each item; a null item_id is ''."""

    def run(batches):
        for batch in slices(batches):
            keys, found = TermKeys(), []
            for item, text in zip(batch.column("item").to_pylist(), raw(batch, "text"), strict=True):
                _, own, times = keys.counts(text)
                found += [(item, int(k), int(c)) for k, c in zip(own, times, strict=True)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["item", "key", "times"]
            )

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    rows = items.select(item, F.col("text").cast("string")).mapInArrow(run, "item string, key long, times long")
    return rows.groupBy("item", "key").agg(F.sum("times").alias("times"))


def _filter(asked: DataFrame) -> np.ndarray:
    place = asked.select(F.pmod("key", F.lit(FILTER_BITS)).alias("bit")).groupBy(F.expr("bit DIV 32").alias("w"))
    mask = np.zeros(FILTER_BITS // 32, np.uint32)  # a fixed half megabyte
    for w, bits in place.agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 32 AS INT)))")).collect():
        mask[w] = bits
    return mask


def term_counts(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """doc_id, n and tf per kept term of every document with a term.

    With ``asked`` the postings of terms that no item asks for are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if asked is None else _filter(asked))

    def run(batches):
        cache = TermKeys(shared.value)
        for batch in slices(batches, 128):
            found = [cache.counts(t) for t in raw(batch, "text")]
            keep = pa.array([n > 0 for n, *_ in found], pa.bool_())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, *_ in found], pa.int64()), pa.array([k for _, k, _ in found], lists), pa.array([c for *_, c in found], lists)],
                ["doc_id", "n", "keys", "tfs"],
            ).filter(keep)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n long, keys array<long>, tfs array<long>")


_SEGMENT = (
    "m long, part long, docs array<long>, keys array<long>, term_at array<int>, tfs array<long>, "
    "block_at array<int>, postings array<int>, top_tf array<long>, df array<long>"
)


def _segment(table: pa.Table) -> pa.Table:
    """One segment: documents by id, postings by term and falling tf."""
    table = table.sort_by([("doc_id", "ascending")])  # nulls last
    keys, tfs = (table.column(c).combine_chunks() for c in ("keys", "tfs"))
    doc = np.repeat(np.arange(table.num_rows), np.diff(keys.offsets.to_numpy()))
    key, tf = keys.flatten().to_numpy(), tfs.flatten().to_numpy()
    order = np.lexsort((doc, -tf, key))
    key, tf, doc = key[order], tf[order], doc[order]
    new_key = np.append(True, key[1:] != key[:-1])
    block = np.flatnonzero(new_key | np.append(True, tf[1:] != tf[:-1]))
    term_at = np.append(np.flatnonzero(new_key[block]), len(block))
    block_at = np.append(block, len(key))
    cells = {
        "docs": (table.column("doc_id").to_pylist(), pa.int64()),
        "keys": (key[block][term_at[:-1]], pa.int64()),
        "term_at": (term_at, pa.int32()),
        "tfs": (tf[block], pa.int64()),
        "block_at": (block_at, pa.int32()),
        "postings": (doc, pa.int32()),
        "top_tf": (tf[block][term_at[:-1]], pa.int64()),
        "df": (np.diff(block_at[term_at]), pa.int64()),
    }
    lists = {c: pa.array([v if isinstance(v, list) else v.astype(t.to_pandas_dtype())], pa.list_(t)) for c, (v, t) in cells.items()}
    return pa.table({"m": table.column("m")[:1], "part": table.column("part")[:1], **lists})


def build_index(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Segments of all strata. A large stratum is split, so no segment grows with it."""
    normaliser = F.expr(f"75L + ((25L * n * {n_docs}L) DIV {n_terms}L)")
    rows = counts.where(F.size("keys") > 0).withColumn("m", normaliser)
    sizes = rows.groupBy("m").agg((F.sum(F.size("keys")) / POSTINGS + 1).cast("long").alias("parts"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).join(sizes, "m")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts"))).select("m", "part", "doc_id", "keys", "tfs")
    # dealt by stratum and part: the join's own partitioning would keep a stratum together
    return spread(rows, "m", "part").groupBy("m", "part").applyInArrow(_segment, _SEGMENT)


def _impact(tf, m):
    return f"(({SCALE}L * {tf}) DIV (1000L * {tf} + {SLOPE}L * {m}))"


def stratum_bounds(index: DataFrame, asked: DataFrame, n_docs: int) -> DataFrame:
    """Per item and stratum: its terms there, the most a document can score, and documents
    that certainly score."""
    held = index.select("m", F.explode(F.arrays_zip("keys", "top_tf", "df")).alias("t"))
    held = held.groupBy("m", F.col("t.keys").alias("key")).agg(F.max("t.top_tf").alias("tf"), F.sum("t.df").alias("df"))
    held = held.join(asked.select("key").distinct(), "key", "left_semi")
    held = stored(held, "lexical-strata")
    weights = held.groupBy("key").agg(F.sum("df").alias("df"))
    weights = weights.select("key", F.expr(f"CAST(floor(1000 * ln(CAST({2 * n_docs + 2} AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS LONG)").alias("w"))
    terms = asked.join(weights.where("w > 0"), "key").select("item", "key", (F.col("times") * F.col("w")).alias("w"))
    met = terms.join(held, "key").groupBy("item", "m").agg(
        F.expr(f"sum(w * {_impact('tf', 'm')})").alias("bound"),
        F.max("df").alias("certain"),
        F.collect_list(F.struct("key", "w")).alias("terms"),
    )
    return met


def _score(batches, k: int):
    """The best ``k`` documents of each segment for each of the items that visit it."""
    for batch in batches:
        for at in range(batch.num_rows):
            cell = lambda c, at=at: batch.column(c)[at].values
            m = batch.column("m")[at].as_py()
            docs = cell("docs")
            keys, term_at, tfs, block_at, postings = (cell(c).to_numpy() for c in ("keys", "term_at", "tfs", "block_at", "postings"))
            impact = (SCALE * tfs) // (1000 * tfs + SLOPE * m)  # once per term and tf
            of_posting = np.repeat(impact, np.diff(block_at))
            items, where, points = [], [], []
            for item in batch.column("asked")[at].as_py():
                asked = np.array([t["key"] for t in item["terms"]], np.int64)
                weight = np.array([t["w"] for t in item["terms"]], np.int64)
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                here = keys[place] == asked
                place, weight = place[here], weight[here]
                if int((weight * impact[term_at[place]]).sum()) < item["least"]:
                    continue
                score = np.zeros(len(docs), np.int64)
                for t, w in zip(place, weight, strict=True):
                    a, b = block_at[term_at[t]], block_at[term_at[t + 1]]
                    score[postings[a:b]] += w * of_posting[a:b]
                best = np.flatnonzero(score >= item["least"])
                if len(best) > k:
                    best = best[score[best] >= np.partition(score[best], -k)[-k]]
                best = best[np.lexsort((best, -score[best]))[:k]]
                items += [item["item"]] * len(best)
                where.append(best)
                points.append(score[best])
            where = np.concatenate([np.zeros(0, np.int64), *where])
            points = np.concatenate([np.zeros(0, np.int64), *points])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), docs.take(pa.array(where)), pa.array(points)], ["item", "doc_id", "score"])


def _visit(index: DataFrame, visits: DataFrame, blocks: int, k: int) -> DataFrame:
    """(item, doc_id, score) of the visited strata; ``visits`` has item, m, terms, least."""
    asked = visits.groupBy("m", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    asked = asked.agg(F.collect_list(F.struct("item", "least", "terms")).alias("asked"))
    both = index.drop("top_tf", "df", "part").join(asked.drop("block"), "m")
    return both.mapInArrow(lambda batches: _score(batches, k), "item string, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item."""
    asked = stored(asked_terms(items), "lexical-asked")
    counts = stored(term_counts(docs, asked), "lexical-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    index = stored(build_index(counts, n_docs, n_terms or 1), "lexical-index")
    bounds = stored(stratum_bounds(index, asked, n_docs), "lexical-bounds")
    blocks = asked.count() // ASKED + 1
    before = Window.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce(F.sum("certain").over(before), F.lit(0))
    order = stored(bounds.withColumn("first", sure < k), "lexical-order")
    found = _visit(index, order.where("first").withColumn("least", F.lit(1).cast("long")), blocks, k)
    found = stored(_best(found, k), "lexical-found")
    least = found.groupBy("item").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    more = order.where("NOT first").join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(1)).cast("long"))
    found = found.drop("rank").unionByName(_visit(index, more.where("bound >= least"), blocks, k))
    item_id = F.expr("nullif(item, '')").cast(items.schema["item_id"].dataType).alias("item_id")
    return _best(found, k).select(item_id, "rank", "doc_id", "score")


def oracle() -> str:
    """DuckDB SQL of the 20 best documents of every benchmark item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {terms} AS t FROM documents),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS t FROM d) GROUP BY doc_id, t),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
m AS MATERIALIZED (SELECT doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM d, size WHERE len(t) > 0),
w AS MATERIALIZED (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, size GROUP BY t),
q AS MATERIALIZED (
  SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark) GROUP BY item_id, t),
s AS (
  SELECT item_id, doc_id, CAST(sum(c * w * (({SCALE} * tf) // (1000 * tf + {SLOPE} * m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20"""
