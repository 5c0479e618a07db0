"""Event scans, point lookups and text search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import scan
from spanloom.functions.text import snippet
from spanloom.functions.times import bound
from spanloom.operators.catalog import list_sessions
from spanloom.operators.tags import anchors_with_all

SESSION = ["platform", "session_id"]


def scan_events(
    events: DataFrame, *, types: list[str] | None = None, first: int | None = None, before: int | None = None
) -> DataFrame:
    """Events in session order, optionally of some types and a half-open seq range."""
    if types is not None:
        events = events.where(F.col("t").isin(types))
    if first is not None:
        events = events.where(F.col("seq") >= first)
    if before is not None:
        events = events.where(F.col("seq") < before)
    return events.orderBy(*SESSION, "seq")


def event_field(name: str, column: str = "data") -> Column:
    return F.try_variant_get(F.col(column), f"$.{name}", "string")


def get_event(events: DataFrame, platform: str, session_id: str, seq: int, *, field: str | None = None) -> DataFrame:
    """One event by seq, or one field of it; an absent seq is an error."""
    if seq < 0:
        raise IndexError(f"seq {seq} is negative")
    hit = events.where(
        (F.col("platform") == platform) & (F.col("session_id") == session_id) & (F.col("seq") == seq)
    )
    if hit.isEmpty():
        raise IndexError(f"{platform}:{session_id} has no event {seq}")
    return hit.select("seq", event_field(field).alias(field)) if field else hit


def tail(events: DataFrame, n: int) -> DataFrame:
    """Last ``n`` events of each session (0 = none)."""
    if n < 0:
        raise ValueError("n must not be negative")
    from_end = scan(events, SESSION, "seq", sums={"from_end": F.lit(1)}, reverse=True)
    return from_end.where(F.col("from_end") <= n)


def contains_text(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())


def search_events(
    events: DataFrame,
    needle: str,
    *,
    sessions: DataFrame | None = None,
    live_tags: DataFrame | None = None,
    tags: list[str] | None = None,
    platform: str | None = None,
    cwd: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    event_since: datetime | str | None = None,
    event_until: datetime | str | None = None,
) -> DataFrame:
    """Case-insensitive substring search over whole event texts, with a snippet.

    ``since``/``until``/``cwd`` choose sessions; ``event_since``/``event_until`` choose events.  With
    tags, one event must carry all of them; tags and sessions join only when asked for.
    """
    hits = events.where(contains_text(F.col("event_text"), needle))
    if platform is not None:
        hits = hits.where(F.col("platform") == platform)
    if event_since is not None:
        hits = hits.where(F.col("ts") >= bound(hits, "ts", event_since))
    if event_until is not None:
        hits = hits.where(F.col("ts") <= bound(hits, "ts", event_until))
    if sessions is not None and (cwd or since or until):
        kept = list_sessions(sessions, platform=platform, cwd=cwd, since=since, until=until)
        hits = hits.join(kept.select(*SESSION), SESSION, "left_semi")
    if tags:
        if live_tags is None:
            raise ValueError("tags need the live tag table")
        hits = hits.join(anchors_with_all(live_tags, tags), [*SESSION, "seq"], "left_semi")
    return hits.select(*SESSION, "seq", "t", snippet(F.col("event_text"), needle).alias("snippet"))
