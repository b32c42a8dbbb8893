"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges (columns a, b of long).

    Rounds of least label among the neighbours and the node itself, then the label's own label, until no label falls; each round is a table in the shared folder.
    """
    ends = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    both = settled(ends.select("e.a", "e.b").distinct(), "edges")
    labels = settled(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total or now is None:
            return labels
        total = now
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        lower = near.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        own = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = settled(lower.join(own, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
