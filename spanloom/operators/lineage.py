"""Following parent pointers to their root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut_lineage


def resolve_roots(nodes: DataFrame, keys: Sequence[str], node: str, parent: str, is_root: Column, name: str) -> DataFrame:
    """Root of every node as ``name``; NULL on a missing parent or a cycle.

    Each round replaces a pointer by the pointer of its target, so depth d takes about
    log2(d) joins.  Only pointers that have not reached a root take part.  When a round
    settles none of them, what is left runs in cycles.

    No side is broadcast: stored ids compress so well that millions of rows look small.  Rows are sorted by the id first,
    as the keys may have few values.
    """
    keys = list(keys)
    on = ["__to", *keys[::-1]]
    start = nodes.select(*keys, F.col(node).alias("__id"), F.when(is_root, F.col(node)).otherwise(F.col(parent)).alias("__to"), is_root.alias("__done"))
    done = start.where("__done").select(*keys, "__id", F.col("__id").alias("__root"))
    step = cut_lineage(start.where("not __done and __to is not null").select(*keys, "__id", "__to"))
    settled = done
    left = step.count()
    while left:
        hop = step.select(*keys, F.col("__id").alias("__to"), F.col("__to").alias("__next"))
        ends = settled.select(*keys, F.col("__id").alias("__to"), "__root")
        moved = cut_lineage(step.join(ends.hint("merge"), on, "left").join(hop.hint("merge"), on, "left"))
        settled = settled.unionByName(moved.where("__root is not null").select(*keys, "__id", "__root"))
        step = moved.where("__root is null and __next is not null").select(*keys, "__id", F.col("__next").alias("__to"))
        now = step.count()
        if now >= left and moved.where("__root is not null").isEmpty():
            break
        left = now
    return nodes.join(
        settled.select(*keys, F.col("__id").alias(node), F.col("__root").alias(name)).hint("merge"), [node, *keys[::-1]], "left"
    ).select(*nodes.columns, name)
