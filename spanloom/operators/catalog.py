"""Session catalog: list, resolve, summarise."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.times import bound

SESSION = ["platform", "session_id"]


def list_sessions(
    sessions: DataFrame,
    *,
    platform: str | None = None,
    cwd: str | None = None,
    status: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """AND of the filters; a session without a readable time passes both bounds."""
    if platform is not None:
        sessions = sessions.where(F.col("platform") == platform)
    if cwd is not None:
        sessions = sessions.where(F.col("cwd") == cwd)
    if status is not None:
        sessions = sessions.where(F.col("status") == status)
    if since is not None:
        active = F.coalesce(F.col("last_ts"), F.col("started_at"))
        sessions = sessions.where(active.isNull() | (active >= bound(sessions, "started_at", since)))
    if until is not None:
        began = F.col("started_at")
        sessions = sessions.where(began.isNull() | (began <= bound(sessions, "started_at", until)))
    return sessions.orderBy(*SESSION)


def sessions_with_tags(sessions: DataFrame, live_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Sessions whose events together carry every tag."""
    wanted = sorted(set(tags))
    if not wanted:
        return sessions
    holders = (
        live_tags.where(F.col("tag").isin(wanted))
        .groupBy(*SESSION)
        .agg(F.count_distinct("tag").alias("n"))
        .where(F.col("n") == len(wanted))
    )
    return sessions.join(holders, SESSION, "left_semi")


def resolve_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The one session named by ``[platform:]prefix``; fails on none or several, with all of them as the error's ``candidates``."""
    platform, _, bare = prefix.rpartition(":")
    found = sessions.where(F.col("session_id").startswith(bare)).select(*SESSION)
    if platform:
        found = found.where(F.col("platform") == platform)
    head = found.limit(2).count()
    if head != 1:
        error = LookupError(f"{prefix!r} names {'several sessions' if head else 'no session'}")
        error.candidates = found.orderBy(*SESSION)
        raise error
    return found


def resolve_prefixes(sessions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Batch form: every prefix with its number of matches and, when unique, the session.

    Joins on equality with each leading part of the session id as long as some prefix,
    so no pair of unrelated rows is ever formed.
    """
    size = prefixes.agg(F.min(F.length("prefix")).alias("lo"), F.max(F.length("prefix")).alias("hi")).first()
    lo, hi = size.lo or 0, size.hi or 0
    leads = sessions.where(F.length("session_id") >= lo).select(
        *SESSION, F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.length("session_id")))).alias("n")
    )
    leads = leads.withColumn("prefix", F.expr("substring(session_id, 1, n)"))
    leads = leads.join(prefixes.select("prefix").distinct(), "prefix", "left_semi")
    hits = leads.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("matches"), F.min(F.struct(*SESSION)).alias("hit")
    )
    unique = F.col("matches") == 1
    return prefixes.join(hits, "prefix", "left").select(
        "prefix",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(unique, F.col("hit.platform")).alias("platform"),
        F.when(unique, F.col("hit.session_id")).alias("session_id"),
    )


def suggest_sessions(sessions: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    return sessions.where(F.col("session_id").startswith(prefix)).orderBy(*SESSION).limit(n)


def newest_sessions(sessions: DataFrame, *, oldest_first: bool = False) -> DataFrame:
    by = F.col("started_at").asc_nulls_first() if oldest_first else F.col("started_at").desc_nulls_last()
    return sessions.orderBy(by, *SESSION)


def store_stats(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events")
    )


def vocabulary(sessions: DataFrame, live_tags: DataFrame, *, cwds: int = 20, tags: int = 50) -> DataFrame:
    """Platforms, the last-listed working folders and the tags on most sessions, as (kind, rank, value)."""
    platforms = sessions.groupBy("platform").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("platform").alias("kind"), F.col("platform").alias("value"), F.lit(0).cast("bigint").alias("weight")
    )
    recent = (
        sessions.where("cwd is not null")
        .groupBy("cwd")
        .agg(F.max(F.struct(*SESSION)).alias("listed"))
        .orderBy(F.col("listed").desc())
        .limit(cwds)
        .select(F.lit("cwd").alias("kind"), F.col("cwd").alias("value"), F.lit(0).cast("bigint").alias("weight"))
    )
    return platforms.unionByName(recent).unionByName(
        top_tags(live_tags, tags).select(F.lit("tag").alias("kind"), F.col("tag").alias("value"), F.col("sessions").alias("weight"))
    )


def recent_cwds(sessions: DataFrame, n: int = 20) -> DataFrame:
    """Working folders by the position of their last session in the listing."""
    return (
        sessions.where("cwd is not null")
        .groupBy("cwd")
        .agg(F.max(F.struct(*SESSION)).alias("listed"))
        .orderBy(F.col("listed").desc())
        .limit(n)
        .select("cwd", F.col("listed.platform").alias("platform"), F.col("listed.session_id").alias("session_id"))
    )


def top_tags(live_tags: DataFrame, n: int = 50) -> DataFrame:
    """Tags by number of sessions, ties by name."""
    return (
        live_tags.groupBy("tag", *SESSION)
        .agg(F.count(F.lit(1)).alias("anchors"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.col("sessions").desc(), "tag")
        .limit(n)
    )


def cohort(sessions: DataFrame, *, more_than: int = 20, cwd_like: str | None = None) -> DataFrame:
    """Substantive sessions, optionally only those whose folder matches a pattern."""
    picked = sessions.where(F.col("event_count") > more_than)
    return picked.where(F.col("cwd").rlike(cwd_like)) if cwd_like else picked

