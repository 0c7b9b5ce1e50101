"""Incremental index: new feature files are added once, to the index that batches use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marklens.sources.index_store import append_vectors

FEATURES = "path string, embedding array<float>"


def _append(index_path: str):
    def write(batch: DataFrame, _: int) -> None:
        append_vectors(batch.sparkSession, index_path, batch)

    return write


def index_stream(
    spark: SparkSession, features: str, index_path: str, checkpoint: str
) -> StreamingQuery:
    """Process all feature files not seen yet, then stop.

    A replayed batch finds its own paths in the index and adds nothing, so a
    restart after a lost driver leaves every path once.
    """
    stream = spark.readStream.schema(FEATURES).parquet(features)
    return (
        stream.writeStream.foreachBatch(_append(index_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
