"""Best-fit packing of tokenised documents with certified bin counts.

Pieces are dealt at random to partitions of bounded size. Each partition runs best-fit
decreasing and compares its bins with a lower bound from dual feasible functions. A
partition that meets its bound cannot be packed better and is final. The others give
up the bins that still have room; these pieces are dealt anew, across partitions, and
packed again as long as that saves bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

CAPACITY = 2048
#: Pieces in a partition, on average.
PARTITION = 32_768
ROUNDS = 3


# How the byte-level tokenizer cuts text into units before merging. Where
# no two white-space characters meet, the shorter pattern cuts alike and is faster.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNITS_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
# ASCII white space, and byte sequences that other white space starts with.
_ASCII_SPACE = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_OTHER_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _bytes_of() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level tokenizer file, as little-endian unsigned 32-bit.

    The file's own vocabulary is put behind a faster merge loop. Texts that hold one of
    its special tokens go through the file's tokenizer itself, and so do those on which
    the fast loop gives up (a run of about a million blanks).
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        table = _bytes_of()
        ranks = {
            bytes(table[c] for c in word): i
            for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if i not in added
        }
        self.any, self.single = (
            tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (UNITS, UNITS_SINGLE)
        )

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._plainly(text)
        data = text.encode()
        gaps = sum(map(data.count, _ASCII_SPACE))
        single = gaps == len(data.split()) - 1 and not any(s in data for s in _OTHER_SPACE)
        try:
            ids = (self.single if single else self.any).encode_ordinary(text)
        except BaseException as error:  # the loop's panic is no Exception
            if type(error).__name__ != "PanicException":
                raise
            return self._plainly(text)
        return np.array(ids, "<u4").tobytes()

    def _plainly(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document with an end id 0.

    Only documents over ``capacity`` are cut; the first piece takes the remainder.
    Null and empty texts give one piece that holds the end id alone.
    """

    def run(batches):
        encode = Encoder(tokenizer_path)
        for batch in slices(batches, 256):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                total = len(ids) // 4
                start, length = 0, (total - 1) % capacity + 1
                for k in range(-(-total // capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length = start + length, capacity
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins that any packing needs, by dual feasible functions."""
    return _bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def fewest_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The same bound over all pieces together; the driver sees one count per length."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        count[length] = n
    return _bound(count, capacity)


def _bound(count: np.ndarray, capacity: int) -> int:
    """Bound for so many lengths of each size."""
    number = np.concatenate([[0], np.cumsum(count)])
    volume = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    # Martello and Toth: over capacity - a counts as a whole bin, below a as nothing
    a = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - a + 1]
    middle = volume[capacity - a + 1] - volume[a]
    best = int((large - (-middle // capacity)).max())
    # Fekete and Schepers: sizes rounded to multiples of 1 / k
    size = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -int(-(count * value).sum() // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin (best-fit decreasing)."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    open_ = 0  # bit r: some bin has r places left
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left > n:
            room[left - n].append(b)
            open_ |= 1 << (left - n)
    return bins, offsets, np.array(fill, np.int64)


_KEYS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _packed(rows: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """Pack ``rows`` in ``parts`` partitions; adds part, bin, offset, fill, gap."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        out = table.select([f.name for f in table.schema if f.name != "_row"])
        for name, values in (("bin", bins), ("offset", offsets), ("fill", fill[bins]), ("gap", np.full(len(bins), gap))):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    # rows come from files, so their numbers are the same in a repeated task
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("_row", F.lit(round_)), F.lit(parts))).drop("_row")
    return dealt.groupBy("part").applyInArrow(
        run, f"{_KEYS}, part long, bin long, offset long, fill long, gap long"
    )


def pack(
    found: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION, rounds: int = ROUNDS
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of a stored table of pieces.

    A partition holds about ``partition`` pieces, dealt by row number, so that equal
    documents and hot sources spread. In each round only bins with room in partitions
    above their bound are opened; the round counts only if it needs fewer bins.
    """
    done: list[DataFrame] = []
    rest, n = found, found.count()
    for round_ in range(rounds):
        parts = max(1, -(-n // partition))
        now = stored(_packed(rest, parts, round_, capacity), "packing-round")
        now = now.withColumn("round", F.lit(round_))
        bins = F.count_distinct("part", "bin")
        if round_:
            used = now.agg(bins).first()[0]
            if used >= opened:  # noqa: F821 - set in the round before
                done.append(last)  # noqa: F821
                break
        movable = (F.col("gap") > 0) & (F.col("fill") < capacity)
        last = now.where(movable)
        n, opened = last.agg(F.count(F.lit(1)), bins).first()
        done.append(now.where(~movable))
        if opened < 2 or round_ == rounds - 1:
            done.append(last)
            break
        rest = last.select(*found.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    number = F.shiftleft(F.col("round").cast("long"), 60) + F.shiftleft("part", 28) + F.col("bin")
    return out.withColumn("sequence_id", number).drop("part", "bin", "fill", "gap", "round")


def packed_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents with their sequence and place there.

    Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    return pack(stored(pieces(docs, tokenizer_path), "packing-pieces"))
