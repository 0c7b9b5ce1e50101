"""SimHash near duplicates over a hierarchical index in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code, where neighbours share
most bits, and cut into leaves. A node keeps the bits that all of its fingerprints share
(mask and pattern); nodes above hold what their children share. Two nodes differ at least
by the bits in which their shared patterns disagree, and children add only the bits that
their parents did not share yet. Pairs of nodes are followed down from the root together;
a pair whose differences exceed the radius goes, with all that lies below. Only
fingerprints of the pairs of leaves that are left are compared.

Links within a leaf, and between the linked groups of two leaves, leave a task as a tree,
never as all pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw, slices, stored
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a leaf; children of an upper node.
LEAF, FAN = 256, 8
#: Shingles whose bits are counted together (255 fit a byte).
BLOCK = 255


def fingerprint(text: bytes | None) -> int:
    """SimHash of the word shingles, as a signed number."""
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    n = max(len(words) - SHINGLE + 1, min(len(words), 1))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[start : start + BLOCK].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code) of every row."""

    def run(batches):
        for batch in slices(batches):
            codes = [fingerprint(t) for t in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.int64())], ["doc_id", "code"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, code long")


def gray_rank(code):
    """Place of a code in the Gray code, as a signed number of the same order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _shared(mask, pattern) -> list:
    """Aggregates: bits set in all masks and equal in all patterns, and their values."""
    both = F.bit_and(mask).bitwiseAND(F.bitwise_not(F.bit_and(pattern).bitwiseXOR(F.bit_or(pattern))))
    return [both.alias("mask"), both.bitwiseAND(F.bit_and(pattern)).alias("pattern")]


def leaves(codes: DataFrame) -> DataFrame:
    """(node, mask, pattern, codes): runs of ``LEAF`` codes in Gray order."""
    ordered = codes.select("code").repartitionByRange(gray_rank(F.col("code"))).sortWithinPartitions(gray_rank(F.col("code")))
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id())
    ordered = stored(ordered.select("code", F.expr("_id DIV 8589934592").alias("part"), F.expr("_id % 8589934592").alias("at")), "simhash-order")
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # one row per partition
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    placed = ordered.join(F.broadcast(starts), "part").select("code", F.expr(f"(start + at) DIV {LEAF}").alias("node"))
    return placed.groupBy("node").agg(*_shared(F.lit(-1), F.col("code")), F.collect_list("code").alias("codes"))


def _children(nodes: DataFrame) -> DataFrame:
    """Parents of ``nodes`` with their children nested."""
    kids = F.collect_list(F.struct("node", "mask", "pattern")).alias("kids")
    return nodes.groupBy(F.expr(f"node DIV {FAN}").alias("node")).agg(*_shared(F.col("mask"), F.col("pattern")), kids)


#: Pairs of children whose differences, those of the parents included, stay in the radius.
_BELOW = f"""inline(flatten(transform(x, a -> transform(
  filter(y, b -> (l < r OR a.node <= b.node) AND
    difference + bit_count((a.pattern ^ b.pattern) & a.mask & b.mask & ~seen) <= {RADIUS}),
  b -> struct(a.node, b.node, difference + bit_count((a.pattern ^ b.pattern) & a.mask & b.mask & ~seen), a.mask & b.mask)))))"""


def close_leaves(blocks: DataFrame) -> DataFrame:
    """(l, r), l <= r: pairs of leaves that may hold codes within the radius."""
    levels = [blocks.select("node", "mask", "pattern")]
    n = blocks.count()
    while n > 1:
        levels.append(stored(_children(levels[-1].select("node", "mask", "pattern")), "simhash-nodes"))
        n = -(-n // FAN)
    pairs = blocks.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r"), F.lit(0).alias("difference"), F.lit(0).cast("long").alias("seen")
    )
    for level in reversed(levels[1:]):
        left = level.select(F.col("node").alias("l"), F.col("kids").alias("x"))
        right = level.select(F.col("node").alias("r"), F.col("kids").alias("y"))
        below = pairs.join(left, "l").join(right, "r").selectExpr(f"{_BELOW} AS (l2, r2, difference2, seen2)")
        pairs = stored(below.toDF("l", "r", "difference", "seen"), "simhash-pairs")
    return pairs.select("l", "r")


def _tree(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join groups not joined before."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _within(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unlike = (x[:, None] ^ y[None, :]).view(np.uint64)  # of a signed number numpy counts the magnitude's bits
    return np.nonzero(np.bitwise_count(unlike) <= RADIUS)


def _inner(batches):
    """Leaves with the group of every code: the smallest code linked to it in the leaf."""
    for batch in slices(batches, 64):
        groups = []
        for at in range(batch.num_rows):
            codes = batch.column("codes")[at].values.to_numpy()
            i, j = _within(codes, codes)
            group = codes.copy()
            while True:
                least = np.full(len(codes), np.iinfo(np.int64).max)
                np.minimum.at(least, i, group[j])
                if (least == group).all():
                    break
                group = least
            groups.append(group)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("codes"), pa.array(groups, pa.list_(pa.int64()))], ["node", "codes", "groups"])


def _between(batches):
    """Links (a, b) between the groups of two leaves."""
    for batch in slices(batches, 64):
        found = []
        x, p, y, q = (batch.column(c) for c in ("x", "p", "y", "q"))
        for at in range(batch.num_rows):
            i, j = _within(x[at].values.to_numpy(), y[at].values.to_numpy())
            if len(i):
                pairs = np.stack([p[at].values.to_numpy()[i], q[at].values.to_numpy()[j]], 1)
                found += _tree(np.unique(pairs, axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def links(codes: DataFrame) -> DataFrame:
    """Links (a, b) between codes with the components of all pairs within the radius."""
    blocks = stored(leaves(codes), "simhash-leaves")
    grouped = stored(blocks.mapInArrow(_inner, "node long, codes array<long>, groups array<long>"), "simhash-groups")
    own = grouped.select(F.explode(F.arrays_zip("codes", "groups")).alias("c")).select(F.col("c.codes").alias("a"), F.col("c.groups").alias("b")).where("a <> b")
    pairs = close_leaves(blocks).where("l < r")
    left = grouped.select(F.col("node").alias("l"), F.col("codes").alias("x"), F.col("groups").alias("p"))
    right = grouped.select(F.col("node").alias("r"), F.col("codes").alias("y"), F.col("groups").alias("q"))
    met = pairs.join(left, "l").join(right, "r").select("x", "p", "y", "q")
    return stored(own.union(met.mapInArrow(_between, "a long, b long")), "simhash-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Null and empty texts and texts without words have fingerprint zero and are linked
    with each other and with fingerprints near zero. Repeated rows share their component.
    A null doc_id counts as no candidate for the smallest id; a component of null ids has
    none. Very long texts are read whole; an empty table has no rows; other columns are
    not looked at.
    """
    found = stored(fingerprints(docs), "simhash-codes")
    codes = stored(found.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = components(links(codes)).select(F.col("node").alias("code"), "label")
    linked = stored(codes.join(labels, "code"), "simhash-labels")
    # a written side lets Spark split the other one where a component is large
    first = stored(linked.groupBy("label").agg(F.min("least").alias("first")), "simhash-first")
    named = linked.join(first, "label").select("code", "first")
    alone = codes.join(labels, "code", "left_anti").select("code", F.col("least").alias("first"))
    named = stored(named.union(alone), "simhash-named")
    out = found.join(named, "code")
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))
