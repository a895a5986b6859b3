"""Connected components by label propagation with shortcuts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges (a, b), itself included.

    Every round takes the smallest label among neighbours and then the label's own label, so paths
    halve; each round is written to the shared folder, which keeps lineage short. No edges, no rows.
    The result is one of `scratch`'s tables.
    """
    both = scratch.written(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = scratch.written(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "was")
        before, labels = labels, scratch.written(step, "labels")
        scratch.drop(before)
        if labels.filter(F.col("was") != F.col("label")).isEmpty():
            scratch.drop(both)
            return labels
