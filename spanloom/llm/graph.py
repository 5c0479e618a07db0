"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(a, b)`` reaches.

    Each round takes the smallest label among a node's neighbours (a hash aggregation that
    folds a hub's edges on the map side), then jumps to that label's own label, so that chains
    halve.  Rounds end when no label changes; every round is a written table.  Repeated edges
    and self-loops change nothing, an empty table gives an empty one.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = written(e.union(e.selectExpr("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        step = written(low.join(jump, "low", "left").select("node", "was", F.least("low", F.coalesce("up", "low")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels
