"""Session helpers: checkpoint location and size-checked broadcasts."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a partition that is grouped several times: its hash tables stay small at any size of the table.
PART_ROWS = 1 << 17


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the cluster.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a folder of its own; a cluster session without it
    is an error, because a machine-local folder would not survive an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="marklens-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_fits(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when the row bound holds, else leave the join to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows that are small now but costly later on their keys.

    Takes the session's shuffle partitions as the number, which AQE then keeps:
    it would fold a few hundred thousand narrow rows into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash-partition ``rows`` rows on ``keys`` once, for groupings that all hold these keys.

    Partitions have about ``PART_ROWS`` rows, so their number follows the table; the
    session's number is the least.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, math.ceil(rows / PART_ROWS)), *keys)
