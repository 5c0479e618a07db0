"""Jobs that put several tables of a session side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.turns import elide_middle, timeline_text
from spanloom.operators.usage import usage_summary

SESSION = ["platform", "session_id"]
ANCHOR = [*SESSION, "seq"]


def annotated_events(events: DataFrame, findings: DataFrame, live_tags: DataFrame) -> DataFrame:
    """Events with the number of findings and live tags anchored to each."""
    found = findings.where("seq is not null").groupBy(*ANCHOR).agg(F.count(F.lit(1)).alias("findings"))
    tagged = live_tags.groupBy(*ANCHOR).agg(F.count(F.lit(1)).alias("tags"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("findings", "tags")}
    return events.join(found, ANCHOR, "left").join(tagged, ANCHOR, "left").withColumns(zero)


def session_context(sessions: DataFrame, events: DataFrame, calls: DataFrame, line: Column) -> DataFrame:
    """Per session: catalog row, usage summary and elided timeline."""
    timeline = timeline_text(elide_middle(events, line))
    summary = usage_summary(calls)
    return sessions.join(summary, SESSION, "left").join(timeline, SESSION, "left")
