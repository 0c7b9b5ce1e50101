"""Connected components of a link table, in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: longs); label: smallest node.

    Each round takes the smallest label among neighbours and then the label's own label,
    so paths halve. Labels are written between rounds.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = stored(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_seen"))
        near = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("_old"), F.least("label", "_seen").alias("_new"))
        up = labels.select(F.col("node").alias("_new"), F.col("label").alias("_up"))
        new = stored(near.join(up, "_new", "left").select("node", F.coalesce(F.least("_new", "_up"), "_new").alias("label"), (F.coalesce(F.least("_new", "_up"), "_new") != F.col("_old")).alias("_changed")), "labels")
        labels = new.select("node", "label")
        if not new.where("_changed").head(1):
            return labels
