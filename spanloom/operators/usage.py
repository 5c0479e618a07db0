"""Model-call usage: deduplication, totals, daily report, rollups, pricing."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import latest, scan, telling
from spanloom.functions.times import bound, parse_ts

CALL_KEY = ["platform", "session_id", "call_id"]
SESSION = ["platform", "session_id"]


#: The one schema of usage rows, whatever platform they come from.
USAGE = {
    "platform": "string", "session_id": "string", "pos": "bigint", "call_id": "string", "ts": "timestamp", "provider_name": "string", "response_model": "string", "operation_name": "string",
    "input_tokens": "bigint", "output_tokens": "bigint", "cache_read_input_tokens": "bigint", "cache_creation_input_tokens": "bigint", "reasoning_output_tokens": "bigint",
}
DEFAULTS = {"operation_name": "chat"}


def typed_usage(*sources: DataFrame) -> DataFrame:
    """Usage rows of several sources in one schema.

    Text times are read here, once: with ``Z`` or an offset, as UTC without, NULL if
    unreadable.  A source without ``pos`` is ordered by ``seq``; columns it lacks are NULL, or ``chat`` for the
    operation.  Other columns of a source are left out.
    """
    out = None
    for df in sources:
        have = {f.name: f.dataType.simpleString() for f in df.schema}

        def column(name: str, kind: str) -> Column:
            if name == "pos" and name not in have:
                name = "seq"
            if name not in have:
                return F.lit(DEFAULTS.get(name)).cast(kind)
            if name == "ts" and have[name] == "string":
                return parse_ts(F.col(name))
            value = F.col(name).cast(kind)
            return F.coalesce(value, F.lit(DEFAULTS[name])) if name in DEFAULTS else value

        part = df.select(*[column(n, k).alias(n) for n, k in USAGE.items()])
        out = part if out is None else out.unionByName(part)
    return out


def dedup_calls(usage: DataFrame) -> DataFrame:
    """One row per call: the last occurrence, with ``first_pos`` of the first one.

    One shuffle: repeats fold on the map side.  A position can occur twice, in two files of a
    session; then the later file (column ``file``, if there is one) and at last a digest
    of the row decide, so the answer never depends on input order.
    """
    return newest(usage, CALL_KEY)


def newest(rows: DataFrame, keys: list[str], columns: Collection[str] | None = None) -> DataFrame:
    """The last row of each key by (pos, file, digest), with ``first_pos``.

    The digest is of whole rows; of the columns beside the keys only ``columns`` are shuffled and returned, if given.
    """
    order = F.struct("pos", *(c for c in ("file",) if c in rows.columns), F.xxhash64(*rows.columns).alias("digest"))
    kept = [c for c in rows.columns if columns is None or c in columns or c in keys]
    rest = [c for c in kept if c not in keys]
    found = rows.groupBy(*telling(keys)).agg(F.max_by(F.struct(*rest), order).alias("row"), F.min("pos").alias("first_pos"))
    return found.select(*[c if c in keys else f"row.{c}" for c in kept], "first_pos")


def with_total(calls: DataFrame) -> DataFrame:
    """``total_tokens`` is always derived, never stored."""
    return calls.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def call_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def usage_filter(
    usage: DataFrame,
    *,
    platform: str | None = None,
    model: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """AND of the given filters; a bound drops rows without a readable time."""
    if platform is not None:
        usage = usage.where(F.col("platform") == platform)
    if model is not None:
        usage = usage.where(F.col("response_model").contains(model))
    if since is not None:
        usage = usage.where(F.col("ts") >= bound(usage, "ts", since))
    if until is not None:
        usage = usage.where(F.col("ts") <= bound(usage, "ts", until))
    return usage


def _session_days(calls: DataFrame) -> DataFrame:
    """Sums per (day, session): the only shuffle that sees every call."""
    return (
        calls.where(F.col("ts").isNotNull())
        .groupBy(F.to_date("ts").alias("day"), *SESSION)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
        )
    )


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sessions"),
        F.sum("events").alias("events"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ]


def usage_by_day(
    calls: DataFrame,
    *,
    platform: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """Contiguous UTC days with distinct sessions, calls and token sums.

    Bounds apply to each call.  Distinct sessions are counted as rows of the (day,
    session) sums, so no day is expanded.  Days run from the earlier of data and
    ``since`` to the later of data and ``until``.
    """
    calls = usage_filter(calls, platform=platform, since=since, until=until)
    days = _session_days(calls).groupBy("day").agg(*_measures())
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    if since is not None:
        lo = F.least(lo, F.to_date(F.lit(since).cast("timestamp")))
    if until is not None:
        hi = F.greatest(hi, F.to_date(F.lit(until).cast("timestamp")))
    if since is not None and until is None:
        hi = F.coalesce(hi, lo)
    if until is not None and since is None:
        lo = F.coalesce(lo, hi)
    calendar = bounds.select(lo.alias("lo"), hi.alias("hi")).where("lo is not null").select(
        F.explode(F.sequence("lo", F.greatest("lo", "hi"))).alias("day")
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("sessions", "events", "input_tokens", "output_tokens")}
    return with_total(calendar.join(days, "day", "left").withColumns(zero))


def usage_totals(calls: DataFrame) -> DataFrame:
    """One TOTAL row; sessions are distinct over all days."""
    per_session = (
        calls.where(F.col("ts").isNotNull())
        .groupBy(*SESSION)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
        )
    )
    out = per_session.agg(*_measures())
    return with_total(out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in out.columns}))


def usage_rollup(calls: DataFrame) -> DataFrame:
    return with_total(
        calls.groupBy(*SESSION).agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
        )
    )


SORTS = {"total": "total_tokens", "input": "input_tokens", "output": "output_tokens"}


def top_sessions(rollup: DataFrame, n: int | None, sort: str = "total") -> DataFrame:
    """First ``n`` sessions; ``ts`` sorts by session id, ties by (platform, session)."""
    if n is not None and n < 0:
        raise ValueError("n must not be negative")
    if sort == "ts":
        ordered = rollup.orderBy("session_id", "platform")
    else:
        ordered = rollup.orderBy(F.col(SORTS[sort]).desc(), "platform", "session_id")
    return ordered if n is None else ordered.limit(n)


def session_usage(calls: DataFrame, session_id: str, sort: str = "total") -> DataFrame:
    """Calls of one session, sorted; equal keys keep order of first appearance."""
    rows = with_total(calls.where(F.col("session_id") == session_id))
    first = F.col("ts").asc() if sort == "ts" else F.col(SORTS[sort]).desc()
    return rows.orderBy(first, "first_pos")


def session_footer(calls: DataFrame) -> DataFrame:
    """Footer sums of every session in one pass."""
    return usage_rollup(calls)


def ranked_calls(calls: DataFrame, sort: str = "total") -> DataFrame:
    """Globally sorted calls with the session's tie rule."""
    first = F.col("ts").asc() if sort == "ts" else F.col(SORTS[sort]).desc()
    return with_total(calls).orderBy(*SESSION, first, "first_pos")


def usage_summary(calls: DataFrame) -> DataFrame:
    """Per session: calls, models by frequency, token sums.

    Models are counted first, so the list that is sorted holds distinct names only.
    """
    models = calls.groupBy(*SESSION, "response_model").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("first_pos").alias("seen"),
        F.sum("input_tokens").alias("i"),
        F.sum("output_tokens").alias("o"),
    )
    named = F.when(F.trim("response_model") != "", F.struct((-F.col("n")).alias("n"), "seen", "response_model"))
    out = models.groupBy(*SESSION).agg(
        F.sum("n").alias("turns"),
        F.sort_array(F.collect_list(named)).alias("m"),
        F.sum("i").alias("input_tokens"),
        F.sum("o").alias("output_tokens"),
    )
    text = F.array_join(
        F.transform("m", lambda x: F.concat(x["response_model"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(" turns)"))),
        ", ",
    )
    return with_total(out.select(*SESSION, "turns", text.alias("models"), "input_tokens", "output_tokens"))


def cache_hit_ratio(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cached reads over fresh input plus cached reads (stored input includes both caches)."""
    read = F.coalesce(F.col("cache_read_input_tokens"), F.lit(0))
    wrote = F.coalesce(F.col("cache_creation_input_tokens"), F.lit(0))
    out = calls.groupBy(*keys).agg(
        F.sum(F.col("input_tokens") - read - wrote).alias("fresh_input"),
        F.sum(read).alias("cached_read"),
        F.sum(wrote).alias("cache_write"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    return out.withColumn(
        "cache_hit_ratio", F.col("cached_read") / (F.col("fresh_input") + F.col("cached_read") + F.lit(0.0001))
    )


def token_spikes(calls: DataFrame, *, output_over: int = 4000, input_over: int = 80000) -> DataFrame:
    """Calls above either bound, with the call that came just before in the session."""
    out = scan(
        calls,
        SESSION,
        "first_pos",
        befores={"prev": F.struct(F.col("call_id").alias("call_id"))},
    ).withColumn("prev_call_id", F.col("prev.call_id")).drop("prev")
    return out.where((F.col("output_tokens") > output_over) | (F.col("input_tokens") > input_over))


def spike_events(calls: DataFrame, events: DataFrame, *, output_over: int = 4000, input_over: int = 80000) -> DataFrame:
    """Calls above either bound with the event just before them in their session: the result that fed them.

    ``calls`` and ``events`` share the order ``seq``; one scan over both finds the events.
    """
    over = calls.where((F.col("output_tokens") > output_over) | (F.col("input_tokens") > input_over))
    cell = F.struct("call_id", "response_model", "input_tokens", "output_tokens")
    spikes = over.select(*SESSION, (F.col("seq") * 2 - 1).alias("at"), cell.alias("call"), F.lit(None).cast("string").alias("t"))
    marks = events.select(*SESSION, (F.col("seq") * 2).alias("at"), F.lit(None).cast(spikes.schema["call"].dataType).alias("call"), "t")
    event = F.when(F.col("call").isNull(), F.struct(((F.col("at")) / 2).cast("bigint").alias("seq"), F.col("t").alias("t")))
    out = scan(spikes.unionByName(marks), SESSION, "at", befores={"event": event}).where("call is not null")
    return out.select(*SESSION, ((F.col("at") + 1) / 2).cast("bigint").alias("seq"), "call.*", F.col("event.seq").alias("event_seq"), F.col("event.t").alias("event_t"))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per call from a price table (model, four prices per million tokens).

    Stored input includes both caches, so fresh input is what is left after them.
    Unknown models and rows with native billing units get NULL.  How the price table is
    joined is left to adaptive execution.
    """
    read = F.coalesce(F.col("cache_read_input_tokens"), F.lit(0))
    wrote = F.coalesce(F.col("cache_creation_input_tokens"), F.lit(0))
    fresh = F.col("input_tokens") - read - wrote
    cost = (
        fresh * F.col("input_price")
        + F.col("output_tokens") * F.col("output_price")
        + read * F.col("read_price")
        + wrote * F.col("write_price")
    ) / F.lit(1_000_000)
    if "total_nano_aiu" in calls.columns:
        cost = F.when(F.col("total_nano_aiu").isNull(), cost)
    return calls.join(prices, "response_model", "left").withColumn("cost", F.when(fresh >= 0, cost)).drop(
        "input_price", "output_price", "read_price", "write_price"
    )


def turn_model(calls: DataFrame, keys: Sequence[str], order: str, *, fallback: Column | None = None) -> DataFrame:
    """Most frequent model per group, the earliest one on a tie.

    ``fallback`` names the model of groups whose calls name none; without it they are left out.
    """
    counted = (
        calls.where(F.coalesce(F.col("response_model"), F.lit("")) != "")
        .groupBy(*keys, "response_model")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    )
    out = counted.groupBy(*keys).agg(
        F.max_by("response_model", F.struct(F.col("n"), (-F.col("seen")).alias("s"))).alias("model"),
        F.sum("n").alias("calls"),
    )
    if fallback is None:
        return out
    groups = calls.groupBy(*keys).agg(F.max(fallback).alias("fallback"))
    return groups.join(out, list(keys), "left").select(*keys, F.coalesce("model", "fallback").alias("model"), F.coalesce("calls", F.lit(0)).alias("calls"))


def usage_labels(calls: DataFrame, native: DataFrame) -> DataFrame:
    """Calls with the native billing and latency columns joined by call."""
    return calls.join(native, CALL_KEY, "left")


def upsert_calls(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Call table after new rows: per call the row with the highest position wins."""
    columns = existing.columns
    both = existing.unionByName(incoming.select(*columns))
    return latest(both, CALL_KEY, "pos").select(*columns)


def reload_sessions(existing: DataFrame, incoming: DataFrame, shrunk: DataFrame) -> DataFrame:
    """Drop the rows of sessions whose file shrank, then upsert."""
    kept = existing.join(shrunk.select(*SESSION).distinct(), SESSION, "left_anti")
    return upsert_calls(kept, incoming)

