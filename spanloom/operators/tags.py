"""Tag log replay and tag reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION = ["platform", "session_id"]
ANCHOR = [*SESSION, "seq"]


def effective_tags(tag_ops: DataFrame) -> DataFrame:
    """Live tags: the last add or remove of (anchor, tag) decides; other ops are inert."""
    last = F.max_by("op", "pos").alias("op")
    return (
        tag_ops.where(F.col("op").isin("add", "remove"))
        .groupBy(*ANCHOR, "tag")
        .agg(last)
        .where(F.col("op") == "add")
        .drop("op")
    )


def tag_inventory(live: DataFrame) -> DataFrame:
    """Tagged anchors and sessions per tag, busiest first."""
    return (
        live.groupBy("tag", *SESSION)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tag")
        .agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.col("events").desc(), "tag")
    )


def tagged_seq_count(live: DataFrame) -> DataFrame:
    """Anchors with at least one live tag, per session."""
    return live.select(*ANCHOR).distinct().groupBy(*SESSION).agg(F.count(F.lit(1)).alias("tagged"))


def inventory_tags(live: DataFrame) -> DataFrame:
    return live.select("tag").distinct().orderBy("tag")


def events_with_tags(events: DataFrame, live: DataFrame) -> DataFrame:
    """Events joined to their live tags; one row per (event, tag)."""
    return events.join(live, ANCHOR)


def anchors_with_all(live: DataFrame, tags: list[str]) -> DataFrame:
    """Anchors that each carry every tag themselves."""
    wanted = sorted(set(tags))
    return (
        live.where(F.col("tag").isin(wanted))
        .groupBy(*ANCHOR)
        .agg(F.count_distinct("tag").alias("n"))
        .where(F.col("n") == len(wanted))
        .select(*ANCHOR)
    )
