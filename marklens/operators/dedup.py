"""Duplicate removal over file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.functions.text import base_name
from marklens.operators.grouping import first_per_group


def content_key(content: Column) -> Column:
    """Digest of the whole content; only equal contents are taken as copies."""
    return F.sha2(content, 256)


def file_signature(*columns: str) -> Column:
    """Digest of listing columns such as path, modification time and length."""
    return F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in columns]))


def with_keys(files: DataFrame, signature: Sequence[str]) -> DataFrame:
    """``path, length, _name, _key`` and the signature columns; content is left behind."""
    content = F.col("content").cast("binary")
    keyed = files.withColumns(
        {
            "_name": base_name(F.col("path")),
            "_key": content_key(content),
        }
    )
    wanted = ["path", "length", "_name", "_key", *signature]
    return keyed.select(*dict.fromkeys(wanted))


def dedup_files(files: DataFrame, signature: Sequence[str] = ("length", "_name")) -> DataFrame:
    """One path per distinct file, the first in path order.

    Files of equal signature and content collapse first, then equal content among files
    of one size; a signature never decides alone. Both are aggregates: copies fold together before each shuffle, and only the
    digest travels, never the content.
    """
    keyed = with_keys(files, signature)
    by_signature = first_per_group(keyed, [*signature, "_key"], ["path"])
    by_content = first_per_group(
        by_signature.select("path", "length", "_key"), ["length", "_key"], ["path"]
    )
    return by_content.select("path", "length")


def dedup_report(files: DataFrame, signature: Sequence[str] = ("length", "_name")) -> DataFrame:
    """Number of files and of duplicates removed per stage."""
    keyed = with_keys(files, signature)
    by_signature = first_per_group(keyed, [*signature, "_key"], ["path"])
    groups = by_signature.groupBy("length", "_key").agg(F.count("*").alias("n"))
    after = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("_kept"), F.count("*").alias("unique_files")
    )
    return (
        keyed.agg(F.count("*").alias("files"))
        .withColumn("_one", F.lit(1))
        .join(after.withColumn("_one", F.lit(1)), "_one")
        .select(
            "files",
            (F.col("files") - F.col("_kept")).alias("signature_duplicates"),
            (F.col("_kept") - F.col("unique_files")).alias("content_duplicates"),
            "unique_files",
        )
    )
