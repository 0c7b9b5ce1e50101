from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marklens.llm import mixing
from marklens.llm.common import n_words
from marklens.llm.ngram_join import keep_one


def line(word, n=40):
    return " ".join(f"{word}{i}" for i in range(n))


def seen(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_rules_act_by_row(spark, documents, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = [(None, line("a")), (None, line("b")), (1, line("c")), (2, line("d")), (2, line("d"))]
    bad = [(None, ""), (None, None), (1, "x"), (3, "same " * 60)]
    docs = documents(good + bad)
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert seen(kept) == Counter(good) and kept.columns == docs.columns


def test_one_row_of_each_component(documents):
    near = line("w", 60)
    rows = [
        (None, near), (None, near + " more"), (5, near + " end"), (4, line("other")),  # three near copies, least id 5
        (5, line("p")), (5, line("q")), (3, line("q") + " z"),  # id 5 again: alone, and near to 3
        (None, line("r")), (None, line("r") + " s"), (7, line("t")), (7, line("t")), (None, line("u")), (None, None), (8, None),
    ]
    kept = seen(keep_one(documents(rows)))
    rest = kept - Counter({(None, line("r")): 1}) - Counter({(None, line("r") + " s"): 1})
    assert sum(kept.values()) == sum(rest.values()) + 1
    assert rest == Counter([
        (5, near + " end"), (4, line("other")), (5, line("p")), (3, line("q") + " z"), (7, line("t")), (None, line("u")), (None, None), (8, None),
    ])


def test_mix_takes_no_row_more_than_twice(spark, documents):
    rows = [(None, line(f"n{i}_", 10 + i % 7), "en", f"s{i % 3}") for i in range(60)]
    rows += [(i // 2, line(f"m{i}_", 12 + i % 5), "en", f"s{i % 3}") for i in range(60)]
    docs = documents(rows)
    taken = seen(corpus_pipeline.source_mix(spark, docs, ""))
    assert set(taken) <= {r[:2] for r in rows} and set(taken.values()) == {1, 2}
    words = Counter()
    for (_, text), n in taken.items():
        words[next(r[3] for r in rows if r[1] == text)] += n * len(text.split())
    targets = {r.source: r.target for r in mixing.mixed_documents(docs).select("source", "target").distinct().collect()}
    assert all(abs(words[s] - t) <= 16 for s, t in targets.items())


#: Names that the stages and their operators use for columns of their own.
OWN_NAMES = "_key _r _row _copy _times _runs _doc _id _in _pattern label node n taken kept piece offset part".split()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_columns_of_any_name(spark, documents, tmp_path, name, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, line(f"a{i}_", 30 + i), "en", f"s{i % 3}") for i in range(12)] + [(20, line("a3_", 33) + " b", "en", "s0"), (None, None), (21, "")]
    docs = documents(rows)
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in OWN_NAMES})
    plain, out = stage(spark, docs, str(tmp_path)), stage(spark, wide, str(tmp_path))
    if name == corpus_pipeline.STAGES[-1][0]:
        keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert sorted(map(str, plain.select(keys).collect())) == sorted(map(str, out.select(keys).collect()))
        return
    assert out.columns == wide.columns
    found = out.collect()
    assert Counter((r.doc_id, r.text) for r in found) == seen(plain)
    assert all(r[c] == (None if r.doc_id is None else f"{c}-{r.doc_id}") for r in found for c in OWN_NAMES)
    assert stage(spark, wide.limit(0), str(tmp_path)).collect() == []


def test_whole_pipeline_by_its_parts(spark, documents, tmp_path):
    """Each stage against what it must do to its own input, on the rows of a small corpus."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    passage = line("shared", 60)
    rows = [(i, line(f"t{i}x", 40 + i) + (f" {passage}" if i % 5 == 0 else ""), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, line(f"t{i}x", 40 + i) + (f" {passage}" if i % 5 == 0 else "") + " end", "en", "s1") for i in range(0, 30, 4)]
    rows += [(200, "same " * 60, "en", "s0"), (201, "few words", "en", "s0"), (202, None, "en", "s0")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if r[0] < 100]  # junk and near copies go, least ids stay
    texts = {i: " ".join(w for w in t.split() if i == 0 or not w.startswith("shared")) for i, t, *_ in kept}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id: r.text for r in docs.collect()} == texts
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r.doc_id for r in packed if r.piece == 0)
    assert set(times) <= set(texts) and set(times.values()) <= {1, 2}
    sizes = Counter({s: sum(len(texts[i].split()) for i, _, _, t in kept if t == s) for s in ("s0", "s1", "s2")})
    targets = mixing.water_fill([sizes[s] for s in sorted(sizes)], [3.0, 1.0, 2.0], 1.5 * sizes.total(), 2.0)
    for source, target in zip(sorted(sizes), targets, strict=True):
        assert abs(sum(times[i] * len(texts[i].split()) for i, _, _, t in kept if t == source) - target) <= 70
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert (o2 == o + n) if s == s2 else o2 == 0


def test_mix_of_overlapping_sources(spark):
    """Documents of several sources: the flow's words per pattern, chosen to within a document."""
    rows = [(i, ["a"] if i % 4 == 0 else ["b"] if i % 4 == 1 else ["b", "a"], "w " * (3 + i % 9)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, tags array<string>, text string").repartition(3)
    quotas = {"a": 1500, "b": 2300}
    out = mixing.mix(docs, F.col("tags"), n_words(), quotas).collect()
    sums = Counter()
    for _, tags, text in rows:
        sums[tuple(sorted(tags))] += len(text.split())
    # cheapest split by trying all: each word of a pattern costs 0 the first time and 1 the second
    both = sums[("a", "b")]
    best = min(
        (sum(max(0, used - have) for used, have in ((quotas["a"] - x, sums[("a",)]), (quotas["b"] - y, sums[("b",)]), (x + y, both))), x + y)
        for x in range(0, 1501, 10) for y in range(0, 2301, 10)
        if 0 <= quotas["a"] - x <= 2 * sums[("a",)] and 0 <= quotas["b"] - y <= 2 * sums[("b",)] and x + y <= 2 * both
    )
    taken = Counter()
    for r in out:
        taken[tuple(sorted(r.tags))] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    again = sum(max(0, n - sums[p]) for p, n in taken.items())
    assert abs(sum(taken.values()) - sum(quotas.values())) <= 18 and again <= best[0] + 36


def test_mix_of_repeated_rows(documents):
    rows = [(i % 2, "w " * 20, "en", "s") for i in range(300)] + [(9, "w " * 5, "en", "t")]
    out = mixing.mixed_documents(documents(rows, 7)).collect()
    own = [r for r in out if r.source == "s"]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    assert {r.taken for r in own} <= {0, 20, 40} and len(out) == len(rows)
