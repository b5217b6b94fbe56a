"""Connected components of an edge table, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, then the
    label of its label (pointer jumping); rounds grow with the logarithm of the
    longest path. Rounds are written to the shared folder.
    """
    both = common.stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = common.stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        after = common.stash(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "next", F.col("comp").alias("was")), "labels")
        labels = after.select("node", "comp")
        if not after.where("comp <> was").limit(1).count():
            return labels
    raise RuntimeError(f"no fixed point after {most} rounds")
