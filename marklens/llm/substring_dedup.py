"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat is an inner node of depth WINDOW or more in the suffix tree of all texts; below
such a node all leaves but the earliest are removed. The tree is never built whole:

* Equal windows of WINDOW words share their smallest 5-gram (the anchor). A first pass
  keeps the anchors that occur twice; only suffixes whose window has one can repeat.
* Suffixes that follow each other under one anchor travel as one stretch of words, to
  the group of that anchor. Suffixes of very frequent anchors travel alone, to the group
  of their whole window, and end there: their nodes have depth WINDOW.
* In a group, prefixes of one, two or more words split the suffixes until each part fits
  SUBTREE. A part's suffixes are sorted by their words; the common prefix lengths of
  neighbours give its inner nodes.

Suffixes end after DEPTH words, so longer repeats are chains of nodes of that depth. Each
suffix of a longer repeat has its own node, so the removed words are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, mixed, packed, parallelism, raw, slices, stored

WINDOW = 20
#: Words of a suffix; nodes have depths from WINDOW to DEPTH.
DEPTH = 32
ANCHOR = 5
#: Groups of anchors as written (powers of two), anchors in a group about, and bits of the
#: filter of repeated ones at least and at most (8 to 64 MB). A filter that fills up only
#: lets more windows through.
ANCHOR_GROUPS, ANCHORS, FILTER_LOW, FILTER_HIGH = 8, 1 << 21, 26, 29
#: Suffixes in a group, about, and in a subtree; longer prefixes split larger ones.
GROUP, SUBTREE = 1 << 20, 1 << 16
SLOTS = 1 << 20
FLUSH = 1 << 19
LAST = (1 << 63) - 1
#: Place of a stretch's first word, places with the same stretch, suffixes, words.
_STRETCH = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("count", "<u4"), ("n", "<u2"), ("size", "<u2")])
#: Windows removed: the first one's place and how many follow each other.
_MARK = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("n", "<u4")])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def read_words(texts: list[bytes | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of several texts in a row, each word's text number and place there."""
    parts = [cache.array((t or b"").split()) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    which = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(parts), which, place


def windows(words: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, place and hash of each one's anchor."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words, ANCHOR)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1).argmin(1)
    starts = np.flatnonzero(which[: len(least)] == which[WINDOW - 1 :])
    at = starts + least[starts]
    return starts, at, grams[at]


def _first_pass(docs: DataFrame) -> DataFrame:
    """Anchors of all windows by group, and slots of frequent anchors (grp -1)."""

    def run(batches):
        cache, held, size = WordHashes(), [], 0
        counts, total = np.zeros(SLOTS, np.int64), 0

        def flush():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            value = np.repeat(value, np.minimum(n, 2))  # twice is all that matters
            grp = (value >> np.uint64(64 - ANCHOR_GROUPS)).astype(np.int32)
            which, blobs = packed(value, grp)
            return pa.RecordBatch.from_arrays(
                [pa.array(which), pa.array(blobs, pa.binary()), *[pa.nulls(len(which), pa.int64())] * 2], ["grp", "data", "slot", "count"]
            )

        for batch in slices(batches, 128):
            words, which, _ = read_words(raw(batch, "text"), cache)
            starts, at, least = windows(words, which)
            if not len(starts):
                continue
            # neighbouring windows mostly have one anchor: count each place once
            held.append(least[np.unique(at, return_index=True)[1]])
            size += len(held[-1])
            counts += np.bincount((least >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
            total += len(starts)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        hot = np.flatnonzero(counts >= 4 * total / SLOTS + 16)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(hot), -1, np.int32)), pa.nulls(len(hot), pa.binary()), pa.array(hot, pa.int64()), pa.array(counts[hot])],
            ["grp", "data", "slot", "count"],
        )

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "grp int, data binary, slot long, count long")


def _finer(anchors: DataFrame, bits: int) -> DataFrame:
    """The anchors cut into 2 ** bits groups instead of 2 ** ANCHOR_GROUPS."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("data").to_pylist():
                value = np.frombuffer(blob, np.uint64)
                which, blobs = packed(value, (value >> np.uint64(64 - bits)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(blobs, pa.binary())], ["grp", "data"])

    anchors = anchors.select("grp", "data")
    return anchors.mapInArrow(run, "grp int, data binary") if bits > ANCHOR_GROUPS else anchors


def _filter_piece(bits: int, groups: int):
    """Function over a group of anchors (of 2 ** groups): its stretch of the filter, and sums."""

    def run(table: pa.Table) -> pa.Table:
        values = np.sort(np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint64))
        again = np.unique(values[1:][values[1:] == values[:-1]])
        piece = np.zeros(1 << (bits - groups), np.uint8)
        piece[(again >> np.uint64(64 - bits)).astype(np.int64) & (len(piece) - 1)] = 1
        held = int(np.isin(values, again).sum())
        return pa.table({
            "grp": table.column("grp")[:1], "piece": pa.array([np.packbits(piece, bitorder="little").tobytes()], pa.binary()),
            "held": pa.array([held], pa.int64()),
        })

    return run


def _spans(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words of the stretches one after another, and each one's place inside."""
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(begin, size) + inside, inside


def _marks(doc: np.ndarray, pos: np.ndarray, n: np.ndarray | int, groups: int) -> tuple[np.ndarray, list[bytes]]:
    """Removed windows packed by group of documents, numbered from below zero.

    Windows that follow each other become one mark.
    """
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    n = np.broadcast_to(n, len(order))[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
    m = np.zeros(int(new.sum()), _MARK)
    m["doc"], m["pos"] = doc[new], pos[new]
    if len(m):
        m["n"] = np.add.reduceat(n, np.flatnonzero(new))
    which, blobs = packed(m, (mixed(m["doc"].view(np.uint64)) % np.uint64(groups)).astype(np.int64))
    return -1 - which, blobs


def _stretches(docs: DataFrame, filter_, bits: int, long, groups: int, doc_groups: int) -> DataFrame:
    """Stretches of suffixes that may repeat by group (grp >= 0), and marks found on the way.

    Of equal stretches a task passes on only the earliest, with their number, so a passage
    that many documents share arrives once per task.
    """

    def run(batches):
        cache, held, size = WordHashes(), [], 0

        def flush():
            s, key, digest, words = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((s["pos"], s["doc"], digest))
            start = (np.cumsum(s["size"], dtype=np.int64) - s["size"])[order]
            s, key, digest = s[order], key[order], digest[order]
            new = np.ones(len(s), bool)
            new[1:] = digest[1:] != digest[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            moved = np.ones(len(s), bool)  # another place than the one before
            moved[1:] = new[1:] | (s["doc"][1:] != s["doc"][:-1]) | (s["pos"][1:] != s["pos"][:-1])
            later = moved & ~new
            marks = _marks(s["doc"][later], s["pos"][later], s["n"][later], doc_groups)
            s["count"] = np.bincount(first[moved], minlength=len(s))
            s, key, start = s[new], key[new], start[new]
            grp = (mixed(key) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(grp, kind="stable")
            s, start, grp = s[order], start[order], grp[order]
            which, heads = packed(s, grp)
            sizes = s["size"].astype(np.int64)
            words = words[_spans(start, sizes)[0]]
            ends = np.cumsum(sizes)[np.append(np.flatnonzero(grp[1:] != grp[:-1]), len(grp) - 1)]
            blobs = [words[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([which, marks[0]]).astype(np.int32)),
                    pa.array(heads + marks[1], pa.binary()),
                    pa.array(blobs + [b""] * len(marks[1]), pa.binary()),
                ],
                ["grp", "heads", "words"],
            )

        for batch in slices(batches, 128):
            words, which, place = read_words(raw(batch, "text"), cache)
            starts, at, least = windows(words, which)
            bit = least >> np.uint64(64 - bits)
            likely = filter_.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
            starts, at, least = starts[likely], at[likely], least[likely]
            if not len(starts):
                continue
            alone = long.value[least >> np.uint64(44)]
            new = np.ones(len(starts), bool)
            new[1:] = alone[1:] | (at[1:] != at[:-1])
            first = np.flatnonzero(new)
            begin, alone = starts[first], alone[first]
            n = np.diff(np.append(first, len(starts)))
            end = np.searchsorted(which, which[begin], "right")
            sizes = np.where(alone, WINDOW, np.minimum(n - 1 + DEPTH, end - begin))
            span, inside = _spans(begin, sizes)
            digest = mixed(words[span] + inside.astype(np.uint64) * _STEP)
            digest = np.add.reduceat(digest, np.cumsum(sizes) - sizes) + (sizes * 64 + n).astype(np.uint64) * _STEP
            s = np.zeros(len(begin), _STRETCH)
            s["doc"] = batch.column("doc_id").to_numpy(zero_copy_only=False)[which[begin]]
            s["pos"], s["n"], s["size"] = place[begin], n, sizes
            key = np.where(alone, digest, least[first])
            held.append((s, key, digest, (words[span] >> np.uint64(32)).astype(np.uint32)))
            size += len(starts)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "grp int, heads binary, words binary")


def _prefix_parts(words: np.ndarray, begin: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Suffixes (by number) split by prefixes of as many words as it takes.

    A part holds all suffixes of its prefixes. Only suffixes that agree in a whole window
    stay together whatever their number.
    """
    left = [(np.arange(len(begin)), 0)]
    while left:
        part, depth = left.pop()
        if len(part) <= most or depth == WINDOW:
            yield part
            continue
        word = words[begin[part] + depth]
        order = np.argsort(word, kind="stable")
        part, word = part[order], word[order]
        cuts = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(part))
        at = 0
        while at < len(cuts) - 1:
            # several short prefixes make one part
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1)
            left.append((part[cuts[at] : cuts[to]], depth + (to == at + 1)))
            at = to


class Subtree:
    """Suffixes of some prefixes as the leaves of their suffix tree.

    ``lcp[i]``: words that leaf i shares with the one before it. ``size``: a leaf's words.
    """

    def __init__(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, pos: np.ndarray, count: np.ndarray):
        inside = np.arange(DEPTH)
        text = words[np.minimum(begin[:, None] + inside, len(words) - 1)]
        text[inside >= size[:, None]] = 0
        pairs = text[:, 0::2].astype(np.uint64) << np.uint64(32) | text[:, 1::2]
        order = np.lexsort(pairs.T[::-1])
        text, self.size, self.doc, self.pos, self.count = text[order], size[order], doc[order], pos[order], count[order]
        differ = text[1:] != text[:-1]
        same = np.where(differ.any(1), differ.argmax(1), DEPTH)
        self.lcp = np.append(0, np.minimum(same, np.minimum(self.size[1:], self.size[:-1])))
        place = np.lexsort((self.pos, self.doc))
        self.rank = np.empty(len(place), np.int64)
        self.rank[place] = np.arange(len(place))
        self.place = place

    def below(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First leaf of each stretch of leaves that share ``depth`` words, and its earliest leaf."""
        start = np.flatnonzero(self.lcp < depth)
        return start, self.place[np.minimum.reduceat(self.rank, start)]

    def later(self) -> np.ndarray:
        """Whether a leaf below an inner node of depth WINDOW or more has an earlier one beside it."""
        start, earliest = self.below(WINDOW)
        first = np.repeat(earliest, np.diff(np.append(start, len(self.lcp))))
        return (self.doc != self.doc[first]) | (self.pos != self.pos[first])

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Inner nodes by depth: depth, occurrences, earliest document and place."""
        for depth in range(WINDOW, DEPTH + 1):
            start, earliest = self.below(depth)
            # leaves part here, or several places end here
            parts = (self.lcp == depth) | (self.size == depth) & (self.count > 1)
            node = np.maximum.reduceat(parts & ((self.lcp >= depth) | (self.count > 1)), start)
            yield depth, np.add.reduceat(self.count, start)[node], self.doc[earliest][node], self.pos[earliest][node]


def _subtrees(table: pa.Table, most: int = SUBTREE) -> Iterator[Subtree]:
    """The suffix trees of one group of stretches."""
    s = np.frombuffer(b"".join(table.column("heads").to_pylist()), _STRETCH)
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint32)
    sizes = s["size"].astype(np.int64)
    of = np.repeat(np.arange(len(s)), s["n"])
    inside = _spans(np.zeros(len(s), np.int64), s["n"].astype(np.int64))[1]
    begin = (np.cumsum(sizes) - sizes)[of] + inside
    size = np.minimum(DEPTH, sizes[of] - inside)
    pos = s["pos"].astype(np.int64)[of] + inside
    for part in _prefix_parts(words, begin, most):
        stretch = of[part]
        yield Subtree(words, begin[part], size[part], s["doc"][stretch], pos[part], s["count"].astype(np.int64)[stretch])


def _trees(doc_groups: int, most: int):
    """Function over a group of stretches: marks of its repeats. Groups of marks pass through."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("grp")[0].as_py() < 0:
            return table.select(["grp", "heads"])
        doc, pos = [], []
        for tree in _subtrees(table, most):
            later = tree.later()
            doc.append(tree.doc[later])
            pos.append(tree.pos[later])
        which, blobs = _marks(np.concatenate(doc), np.concatenate(pos), 1, doc_groups)
        return pa.table({"grp": pa.array(which.astype(np.int32)), "heads": pa.array(blobs, pa.binary())})

    return run


def _nodes(most: int):
    """Function over a group of stretches: its inner nodes of depth WINDOW and more."""

    def run(table: pa.Table) -> pa.Table:
        out = [node for tree in _subtrees(table, most) for node in tree.nodes()]
        depth = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
        columns = [depth, *(np.concatenate([x[i] for x in out]) for i in (1, 2, 3))]
        return pa.table([pa.array(c.astype(np.int64), pa.int64()) for c in columns], ["depth", "occurrences", "doc", "pos"])

    return run


def _runs(table: pa.Table) -> pa.Table:
    """Per document the stretches of removed words as first and end places."""
    m = np.frombuffer(b"".join(table.column("heads").to_pylist()), _MARK)
    m = m[np.lexsort((m["pos"], m["doc"]))]
    pos = m["pos"].astype(np.int64)
    number = np.cumsum(np.append(True, m["doc"][1:] != m["doc"][:-1])) - 1  # of the document
    shift = number << 34
    until = np.maximum.accumulate(pos + m["n"] + WINDOW - 1 + shift)
    new = np.append(True, pos[1:] + shift[1:] > until[:-1])
    end = np.append(np.flatnonzero(new)[1:], len(m)) - 1
    pair = np.stack([pos[new], (until - shift)[end]], 1).astype(np.uint32)
    docs, blobs = packed(pair, m["doc"][new])
    return pa.table({"_doc": pa.array(docs, pa.int64()), "_runs": pa.array(blobs, pa.binary())})


def _grouped(docs: DataFrame, group: int) -> tuple[DataFrame, int]:
    """Stretches and marks by group (grp, heads, words), and the groups of marks."""
    spark = docs.sparkSession
    first = stored(_first_pass(docs), "substring-anchors")
    anchors = first.where("grp >= 0")
    n = anchors.agg(F.sum(F.length("data") / 8)).first()[0] or 0
    bits = min(FILTER_HIGH, max(FILTER_LOW, int(4 * n).bit_length()))
    parts = min(bits - 3, max(ANCHOR_GROUPS, int(n / ANCHORS).bit_length()))
    pieces = _finer(anchors, parts).groupBy("grp").applyInArrow(_filter_piece(bits, parts), "grp int, piece binary, held long")
    filter_, held = np.zeros(1 << (bits - 3), np.uint8), 0
    size = len(filter_) >> parts
    for grp, piece, repeated in pieces.toLocalIterator():  # together the filter, of bounded size
        filter_[grp * size : (grp + 1) * size] = np.frombuffer(piece, np.uint8)
        held += repeated
    frequent = first.where("grp < 0").groupBy("slot").agg(F.sum("count").alias("count")).where(F.col("count") > group)
    long = np.zeros(SLOTS, bool)
    for slot, _ in frequent.collect():  # at most SLOTS rows
        long[slot] = True
    likely = held * (WINDOW - ANCHOR + 2) // 2  # windows of the repeated anchors
    groups = max(parallelism(spark), likely // group + 1)
    doc_groups = max(parallelism(spark), likely // (4 * group) + 1)
    share = spark.sparkContext.broadcast
    return _stretches(docs, share(filter_), bits, share(long), groups, doc_groups), doc_groups


def removed_runs(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(_doc, _runs): the removed stretches of words of each document that has any."""
    found, doc_groups = _grouped(docs, group)
    marks = found.groupBy("grp").applyInArrow(_trees(doc_groups, min(group, SUBTREE)), "grp int, heads binary")
    return marks.groupBy("grp").applyInArrow(_runs, "_doc long, _runs binary")


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The deep inner nodes: depth (words), occurrences, and the earliest one's doc and pos.

    A node is a sequence of WINDOW to DEPTH words found at several places and not followed
    by the same word at all of them (at DEPTH: by whatever words). Sequences of an anchor
    with over ``group`` windows are given at depth WINDOW alone. Rows repeated with one
    doc_id are one place where they meet in one task; a null doc_id is the largest long.
    """
    found, _ = _grouped(docs, group)
    return found.where("grp >= 0").groupBy("grp").applyInArrow(_nodes(min(group, SUBTREE)), "depth long, occurrences long, doc long, pos long")


def kept_words(text: bytes, runs: bytes | None) -> tuple[list[bytes], int]:
    """Words that stay, and the number of words before."""
    words = text.split()
    if not runs:
        return words, len(words)
    out, at = [], 0
    for begin, end in np.frombuffer(runs, np.uint32).reshape(-1, 2).tolist():
        out += words[at:begin]
        at = end
    return out + words[at:], len(words)


def _joined(docs: DataFrame, rows: DataFrame, group: int) -> DataFrame:
    """``rows`` (with the document's number ``_doc``) and the runs removed there."""
    return rows.join(removed_runs(docs, group), "_doc", "left").drop("_doc")


def _number():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc")


def dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document row.

    A null text has no words; texts under WINDOW words lose nothing. Rows repeated with
    one doc_id are the same place, so none is earlier than the other; a null doc_id
    comes after all others. An empty table gives an empty result.
    """

    def run(batches):
        for batch in slices(batches, 256):
            rows = []
            for text, runs in zip(raw(batch, "text"), batch.column("_runs").to_pylist(), strict=True):
                kept, n = kept_words(text or b"", runs)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = narrow.select("doc_id", "text", _number())
    return _joined(narrow, rows, group).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The documents with repeats taken out of ``text``; other columns stay.

    A text that loses words becomes its kept words joined by blanks, others stay as they
    are. ``n_chars``, where there is such a column, is counted again.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in slices(batches, 256):
            columns = batch.column("_row").flatten()
            texts = []
            for text, runs in zip(columns[at].cast(pa.binary()).to_pylist(), batch.column("_runs").to_pylist(), strict=True):
                texts.append(text if not runs else b" ".join(kept_words(text or b"", runs)[0]))
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.struct(*names).alias("_row"), _number())  # no name of the caller's meets one of ours
    out = _joined(docs.select("doc_id", "text"), rows, group).select("_row", "_runs").mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out
