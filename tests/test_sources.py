"""Files, archives, caches, stores and the stream."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from marklens.operators import dedup as D
from marklens.operators import reporting as R
from marklens.plans import index as I
from marklens.plans.projection import project_vectors
from marklens.sources import cache, files, index_store, sorted_pages, trademarks
from marklens.streaming.index_stream import index_stream


def png(width, height, pixels):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + b"".join(bytes(p) for p in pixels[y * width : (y + 1) * width]) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_scan_files_and_pixels(spark, tmp_path):
    image = png(2, 2, [(255, 0, 10), (0, 200, 0), (1, 2, 3), (250, 251, 252)])
    (tmp_path / "a.PNG").write_bytes(image)
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jpeg").write_bytes(b"broken")
    folder = str(tmp_path)
    assert files.scan_files(spark, folder).count() == 1
    assert files.scan_files(spark, folder, case_sensitive=True).count() == 0
    assert files.scan_files(spark, folder, recursive=True).count() == 2
    assert files.cap_inputs(files.scan_files(spark, folder, recursive=True), 1).first().path.endswith("a.PNG")
    with pytest.raises(ValueError):
        files.require_nonempty(files.scan_files(spark, folder, ("webp",)), "logos")
    got = sorted((r.y, r.x, r.r, r.g, r.b, r.a) for r in files.scan_pixels(spark, str(tmp_path / "a.PNG")).collect())
    assert got == [(0, 0, 255, 0, 10, None), (0, 1, 0, 200, 0, None), (1, 0, 1, 2, 3, None), (1, 1, 250, 251, 252, None)]
    total = files.dataset_footprint(spark, folder).filter("file IS NULL").first()
    assert total["files"] == 3


def test_explode_archive(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("xl/media/image2.png", b"two")
        archive.writestr("xl/media/image1.jpeg", b"one")
        archive.writestr("xl/sheet.xml", b"no")
    (tmp_path / "book.xlsx").write_bytes(buffer.getvalue())
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    listing = files.scan_files(spark, str(tmp_path), ("xlsx",), content=True)
    got = sorted((r.image_name, bytes(r.image)) for r in files.explode_archive(listing).collect())
    assert got == [("image_1.jpeg", b"one"), ("image_2.png", b"two")]


def test_feature_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    listing = spark.createDataFrame([(f"/f/{i}", i) for i in range(6)], "path string, length long")
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.select("signature", "path", (F.col("length") * 2).alias("feature"))

    columns = ("path", "length")
    first = cache.with_feature_cache(listing.filter("length < 4"), path, compute, columns)
    assert first.count() == 4
    again = cache.with_feature_cache(listing, path, compute, columns)
    assert sorted(r.feature for r in again.collect()) == [0, 2, 4, 6, 8, 10]
    assert seen == [4, 2]
    stats = cache.cache_stats(spark, path).first()
    assert stats.files >= 2 and stats.bytes > 0
    # hits are not written again, an earlier version stays as it was
    assert cache.read_cache(spark, path, 0).count() == 4 and cache.read_cache(spark, path, 1).count() == 6
    third = cache.with_feature_cache(listing, path, compute, columns)
    assert third.count() == 6 and seen == [4, 2, 0] and cache.cache_version(spark, path) == 1
    cache.compact_cache(spark, path)
    assert sorted(r.feature for r in cache.read_cache(spark, path).collect()) == [0, 2, 4, 6, 8, 10]
    cache.clear_cache(spark, path)
    assert cache.read_cache(spark, path).count() == 0 and cache.read_cache(spark, path, 1).count() == 6
    assert cache.cache_stats(spark, path).first().files == 0
    assert cache.with_feature_cache(listing, path, compute, columns).count() == 6


@pytest.mark.parametrize("descending", [True, False])
def test_sorted_pages(spark, tmp_path, descending):
    # half of the rows share one score, some have none
    rows = [(i % 7, i, None if i % 10 == 0 else 50.0 if i % 2 else float(i % 13)) for i in range(230)]
    frame = spark.createDataFrame(rows, "ref_id long, cmp_id long, final_similarity double").repartition(5)
    path = str(tmp_path / "pages")
    sorted_pages.save_sorted(frame, path, descending=descending)
    pages = sorted_pages.open_sorted(spark, path)
    key = lambda r: ((r[2] or 0.0) * (-1 if descending else 1), r[0], r[1])
    expected = [(*r, i) for i, r in enumerate(sorted(rows, key=key), 1)]
    assert pages.total == 230 and pages.page_count(20) == 12
    for number in (1, 2, 7, 12, 13):
        assert [tuple(r) for r in pages.page(number, 20).collect()] == expected[(number - 1) * 20 : number * 20]
    assert [tuple(r) for r in pages.page(1, 1000).collect()] == expected
    scan = pages.page(12, 20)._jdf.queryExecution().executedPlan().toString()
    assert "_page_range" in scan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        pages.page(0)


def test_sorted_pages_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], "ref_id long, cmp_id long, final_similarity double")
    sorted_pages.save_sorted(frame, str(tmp_path / "none"))
    pages = sorted_pages.open_sorted(spark, str(tmp_path / "none"))
    assert pages.page_count() == 0 and pages.page(1).collect() == []


def test_dedup_stages(spark):
    big = "a" * 9000
    changed = big[:8192] + "b" + big[8193:]
    rows = [("/b/x.png", "one"), ("/a/x.png", "one"), ("/c/y.png", "one"), ("/c/z.png", "two"), ("/d/1", big), ("/d/2", big), ("/d/3", changed)]
    listing = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content string")
    kept = D.dedup_files(listing)
    assert sorted(r.path for r in kept.collect()) == ["/a/x.png", "/c/z.png", "/d/1", "/d/3"]
    report = D.dedup_report(listing).first()
    assert (report.files, report.signature_duplicates, report.content_duplicates, report.unique_files) == (7, 1, 2, 4)


def test_index_store_and_stream(spark, tmp_path):
    rows = [(f"/p/{i:03d}", [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [("/p/zero", [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "path string, embedding array<float>")
    built = I.build_vector_index(frame, lists=4)
    index_store.save_index(built, str(tmp_path / "store"))
    loaded = index_store.load_index(spark, str(tmp_path / "store"))
    assert loaded.vectors.count() == 40 and loaded.centroids.count() == 4
    flat = I.build_vector_index(frame)
    index_store.save_index(flat, str(tmp_path / "flat"))
    assert index_store.load_index(spark, str(tmp_path / "flat")).centroids is None
    features, out, progress = (str(tmp_path / n) for n in ("features", "index", "progress"))
    frame.filter("path < '/p/020'").write.parquet(features)
    index_stream(spark, features, out, progress).awaitTermination()
    frame.write.mode("append").parquet(features)  # half of it was there before
    index_stream(spark, features, out, progress).awaitTermination()
    rows = index_store.load_index(spark, out).vectors.collect()
    streamed = {r.path: list(r.embedding) for r in rows}
    batch = {r.path: list(r.embedding) for r in flat.vectors.collect()}
    assert streamed == batch and sorted(r.index_id for r in rows) == list(range(40))
    # one index for both: the stream goes on where the batch build ended
    index_store.append_vectors(spark, str(tmp_path / "store"), spark.createDataFrame([("/q/1", [1.0, 2.0, 3.0])], "path string, embedding array<float>"))
    grown = index_store.load_index(spark, str(tmp_path / "store")).vectors
    assert grown.where("path = '/q/1'").first().index_id == 40 and grown.count() == 41
    index_store.remove_gone(spark, str(tmp_path / "store"), frame.where("path <> '/p/005'"))
    left = {r.path for r in index_store.load_index(spark, str(tmp_path / "store")).vectors.collect()}
    assert len(left) == 39 and not left & {"/q/1", "/p/005"}
    index_store.append_vectors(spark, str(tmp_path / "store"), frame)
    index_store.compact(spark, str(tmp_path / "store"))
    rows = index_store.load_index(spark, str(tmp_path / "store")).vectors
    assert rows.where("path = '/p/005'").first().index_id == 41 and rows.count() == 40


def test_search_reads_the_probed_lists_only(spark, tmp_path):
    rows = [(f"/p/{i:03d}", [float(i % 7) - 3, 1.0, float(i % 3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "path string, embedding array<float>")
    index_store.save_index(I.build_vector_index(frame, lists=5), str(tmp_path / "store"))
    index = index_store.load_index(spark, str(tmp_path / "store"))
    queries = frame.limit(1).select(F.lit(1).cast("long").alias("query_id"), "embedding")
    hits = I.search_index(index, queries, 3, probes=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [centroid_id" in plan.replace("isnotnull(", "") or "centroid_id#" in plan.split("PartitionFilters", 1)[1][:80]
    assert [r.path for r in hits.orderBy("rank").collect()][0] == "/p/000"


def test_trademark_sink(spark, tmp_path):
    record = spark.createDataFrame([tuple("x" for _ in trademarks.COLUMNS)], ", ".join(f"`{c}` string" for c in trademarks.COLUMNS))
    path = str(tmp_path / "marks")
    for kind in ("journal", "client", "client"):
        trademarks.write_trademarks(record, path, kind)
    counts = {r.db_type: r["count"] for r in trademarks.read_trademarks(spark, path).groupBy("db_type").count().collect()}
    assert counts == {"journal": 1, "client": 2}
    with pytest.raises(ValueError):
        trademarks.write_trademarks(record, path, "other")


def test_projection(spark):
    rows = [(i, [float(i), float(2 * i), 0.5]) for i in range(1, 6)] + [(9, [0.0, 0.0, 0.0])]
    coordinates, variance = project_vectors(spark.createDataFrame(rows, "image_id long, embedding array<double>"), 2)
    assert coordinates.count() == 5 and variance[0] == pytest.approx(1)
    assert sum(r.pc1 for r in coordinates.collect()) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        project_vectors(spark.createDataFrame(rows[-1:], "image_id long, embedding array<double>"), 2)


def test_reports(spark, tmp_path):
    rows = [(1, 10, "Ring", "a", "b", 80.0, True), (1, 11, "rod", "a", None, None, False), (2, 10, "Bolt", "x", "ring", 40.0, False)]
    schema = "ref_id long, cmp_id long, logo_name string, text1 string, text2 string, final_similarity double, infringement_detected boolean"
    res = spark.createDataFrame(rows, schema)
    assert R.search(res, "RING").count() == 2
    assert R.filter_min_similarity(res, 1.0).count() == 2
    assert R.filter_status(res, "clear").count() == 2
    assert R.on_failure(res, ["final_similarity"]).count() == 2
    assert R.on_failure(res, ["final_similarity"], "keep", "text2").filter("text2 = 'PROCESSING FAILED' AND final_similarity = 0").count() == 1
    parts = R.to_report(res, part_rows=1)
    assert sum(len(r.results) for r in parts.collect()) == 3
    assert {r.result_count for r in parts.filter("ref_id = 1").collect()} == {2}
    report = R.to_report(res)
    R.write_report(report, str(tmp_path / "report"))
    nested = spark.read.schema(report.schema).json(str(tmp_path / "report"))
    assert sorted(map(str, R.flatten_report(nested).select(*res.columns).collect())) == sorted(map(str, res.collect()))
    R.export_csv(res, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    observed, metrics = R.run_metrics(res)
    observed.collect()
    assert metrics.get == {"comparisons": 3, "infringements": 1}
    assert R.speed(10, 2, 4.0)["images_per_second"] == 2.5
