"""Image files, pixels and archives as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.functions.text import base_name

# Extension sets of the listings.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp")
PHOTOS = ("png", "jpg", "jpeg", "bmp", "tiff", "tif")
PHOTOS_WEB = (*PHOTOS, "webp")
IMAGES_RECURSIVE = ("png", "jpg", "jpeg", "gif", "bmp", "tiff")


def scan_files(
    spark: SparkSession,
    folder: str,
    extensions: Sequence[str] | None = IMAGES,
    recursive: bool = False,
    case_sensitive: bool = False,
    content: bool = False,
) -> DataFrame:
    """Listing ``path, modificationTime, length`` of a folder; content only on demand."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    if extensions is not None:
        ending = F.regexp_extract("path", r"\.([^./]+)$", 1)
        files = files.filter((ending if case_sensitive else F.lower(ending)).isin(*extensions))
    columns = ["path", "modificationTime", "length"]
    return files.select(*columns, "content") if content else files.select(*columns)


def cap_inputs(files: DataFrame, n: int | None, order: str = "path") -> DataFrame:
    """At most ``n`` inputs in a fixed order; ``None`` keeps all."""
    return files if n is None else files.orderBy(order).limit(n)


def require_nonempty(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows in {name}")
    return df


def scan_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """``image_id, x, y, r, g, b, a`` of every image Spark can decode (a: null without alpha)."""
    image = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    size = F.col("height") * F.col("width")
    position = F.col("i") * F.col("nChannels") + 1

    def byte(at: int):
        # one byte as an unsigned number; channel order is B, G, R, A
        return F.conv(F.hex(F.substr("data", position + at, F.lit(1))), 16, 10).cast("int")

    pixels = image.filter(size > 0).withColumn("i", F.explode(F.sequence(F.lit(0), size - 1)))
    gray = F.col("nChannels") == 1
    return pixels.select(
        F.col("origin").alias("image_id"),
        (F.col("i") % F.col("width")).alias("x"),
        F.floor(F.col("i") / F.col("width")).cast("int").alias("y"),
        F.when(gray, byte(0)).otherwise(byte(2)).alias("r"),
        F.when(gray, byte(0)).otherwise(byte(1)).alias("g"),
        byte(0).alias("b"),
        F.when(F.col("nChannels") == 4, byte(3)).alias("a"),
    )


@F.udtf(returnType="member string, number int, image binary")
class _ZipMembers:
    """Numbered members of a zip container under a prefix; broken ones are skipped."""

    def eval(self, content: bytes, prefix: str):
        import io
        import zipfile
        import zlib

        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            return
        with archive:
            number = 0
            for name in sorted(archive.namelist()):
                if not name.startswith(prefix) or name.endswith("/"):
                    continue
                try:
                    image = archive.read(name)
                except (zipfile.BadZipFile, NotImplementedError, OSError, zlib.error):
                    continue
                number += 1
                yield name, number, image


def explode_archive(files: DataFrame, prefix: str = "xl/media/") -> DataFrame:
    """Images inside spreadsheet archives as ``path, member, image_name, image``."""
    members = _ZipMembers(F.col("content").outer(), F.lit(prefix))
    rows = files.select("path", "content").lateralJoin(members).drop("content")
    ending = F.regexp_extract("member", r"\.([^./]+)$", 1)
    name = F.concat(F.lit("image_"), F.col("number").cast("string"), F.lit("."), ending)
    return rows.select("path", "member", name.alias("image_name"), "image")


def dataset_footprint(spark: SparkSession, folder: str) -> DataFrame:
    """MB per file and in total (``file`` null) with the number of files."""
    files = scan_files(spark, folder, extensions=None, recursive=True)
    return (
        files.withColumn("file", base_name(F.col("path")))
        .rollup("file")
        .agg(F.count("*").alias("files"), F.round(F.sum("length") / 1048576.0, 2).alias("mb"))
    )
