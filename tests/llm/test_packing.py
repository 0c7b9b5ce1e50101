import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marklens.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "a  b", "a\nb c", "\n", "x \n y", "it's I'LL we've 12 34.5 é ü 漢字 漢字  x", "<|endoftext|> x",
    "a\tb\t\tc d", " lead", "trail ", "\x00 \x1c a \x85 b", "a　b　c", "a  b\x1cc", "a  b　c", "end\n\n",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    encode = packing.Encoder(PATH)
    for text in ODD:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(ids, "<u4").tobytes(), repr(text)


def best_known(lengths, capacity):
    """Fewest bins by trying all placements (small cases)."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(lengths):
            best = len(fill)
            return
        for b in {f: j for j, f in enumerate(fill)}.values():
            if fill[b] + lengths[i] <= capacity:
                fill[b] += lengths[i]
                place(i + 1, fill)
                fill[b] -= lengths[i]
        fill.append(lengths[i])
        place(i + 1, fill)
        fill.pop()

    place(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        optimum = best_known(lengths, 20)
        array = np.array(lengths)
        bins, offsets, fill = packing.best_fit(array, 20)
        assert packing.lower_bound(array, 20) <= optimum <= len(fill)
        for b in range(len(fill)):
            own = sorted(zip(offsets[bins == b], array[bins == b], strict=True))
            assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1])
            assert sum(n for _, n in own) == fill[b] <= 20


def test_whole_packing(documents, tokenizer, spark):
    rng = random.Random(1)
    words = "the of and thorn éclair ndre 42 x".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 50, 400, 1200))))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "go " * 6000), (203, "same"), (203, "same"), (None, "no id")]
    found = packing.packed_documents(documents(rows), PATH).collect()
    ids = defaultdict(list)
    for doc, text in rows:
        ids[doc].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    assert sum(r.length for r in found) == sum(len(x) for v in ids.values() for x in v)
    for r in found:
        whole = ids[r.doc_id][0]
        part = whole[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert len(whole) <= 2048 and r.piece == 0 or r.piece == 0 or r.length == 2048
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= packing.lower_bound(np.array([r.length for r in found])) + 1


def test_partitions_exchange_documents(documents, spark):
    rng = random.Random(2)
    lengths = [rng.choice((700, 1000, 1040, 400, 330)) for _ in range(300)]
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    one = packing.pack(table, partition=20, rounds=1).select("sequence_id").distinct().count()
    more = packing.pack(table, partition=20, rounds=4)
    assert more.count() == 300
    assert packing.lower_bound(np.array(lengths)) <= more.select("sequence_id").distinct().count() <= one


def test_empty_table(documents):
    assert packing.packed_documents(documents([]), PATH).collect() == []


def test_very_long_runs(tokenizer):
    encode = packing.Encoder(PATH)
    for text in (" " * 2_000_000 + "x", "\u3000" * 1_500_000 + "x", "a" * 300_000):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


def test_bound_over_all_pieces(documents):
    docs = documents([(i, "word " * (i * 37 % 900)) for i in range(300)])
    packed = packing.packed_documents(docs, PATH).cache()
    least = packing.fewest_sequences(packed)
    assert least == packing.lower_bound(np.array([r.length for r in packed.collect()]))
    assert least <= packed.select("sequence_id").distinct().count() <= 1.02 * least + 1
