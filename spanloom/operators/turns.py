"""Turns: slices of a session that start at a prompt or at an agent-turn marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import CHUNK_ROWS, scan
from spanloom.operators.search import contains_text
from spanloom.session import cut_lineage

SESSION = ["platform", "session_id"]
TURN = [*SESSION, "turn_no"]


def prompt_turn_events(events: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Events inside prompt turns with ``turn_no``.

    A turn opens at a user message and ends with the first assistant message after it;
    a new user message ends an open turn; events outside any turn are left out.
    """
    user, reply = F.col("t") == "user_message", F.col("t") == "assistant_message"
    marked = scan(
        events,
        SESSION,
        "seq",
        sums={"turn_no": F.when(user, 1).otherwise(0)},
        lasts={"__opened": F.when(user, F.col("seq"))},
        befores={"__replied": F.when(reply, F.col("seq"))},
        width=width,
    )
    inside = (F.col("turn_no") > 0) & (F.col("__replied").isNull() | (F.col("__replied") < F.col("__opened")))
    return marked.where(inside).drop("__opened", "__replied")


def marker_turn_events(events: DataFrame, marker: str = "agent_turn", *, width: int = CHUNK_ROWS) -> DataFrame:
    """Events from each marker to the next one."""
    marked = scan(
        events, SESSION, "seq", sums={"turn_no": F.when(F.col("t") == marker, 1).otherwise(0)}, width=width
    )
    return marked.where(F.col("turn_no") > 0)


def turn_events(events: DataFrame, *, marker_platforms: tuple[str, ...] = ("codex",)) -> DataFrame:
    """Both kinds of turns in one table; the platform decides which rule applies."""
    by_marker = F.col("platform").isin(*marker_platforms)
    return prompt_turn_events(events.where(~by_marker)).unionByName(marker_turn_events(events.where(by_marker)))


def turns(turn_rows: DataFrame, turn_id: Column | None = None) -> DataFrame:
    """One row per turn; its id is ``session:`` and the first event's turn id or seq."""
    own = F.col("seq").cast("string") if turn_id is None else F.coalesce(turn_id, F.col("seq").cast("string"))
    has_ts = "ts" in turn_rows.columns
    times = [F.min_by("ts", "seq").alias("start_ts"), F.max_by("ts", "seq").alias("end_ts")] if has_ts else []
    out = turn_rows.groupBy(*TURN).agg(
        F.min("seq").alias("start_seq"),
        F.max("seq").alias("end_seq"),
        F.count(F.lit(1)).alias("events"),
        F.min_by(own, "seq").alias("turn_id"),
        *times,
    )
    return out.withColumn("id", F.concat_ws(":", "session_id", "turn_id"))


def payload_turn_id(column: str = "data") -> Column:
    """Turn id of a payload under any of its spellings."""
    read = [F.try_variant_get(F.col(column), path, "string") for path in ("$.turn_id", "$['turn-id']", "$.turnId")]
    return F.coalesce(*[F.nullif(r, F.lit("")) for r in read])


def filter_turns(turn_rows: DataFrame, *, turn_id: str | None = None, query: str | None = None) -> DataFrame:
    """Turns named by full or bare id whose events contain every comma-separated term.

    Each term is tested on each event, so no turn's text is ever put together.
    """
    out = turns(turn_rows)
    terms = [t.strip() for t in (query or "").split(",") if t.strip()]
    if terms:
        seen = turn_rows.groupBy(*TURN).agg(
            *[F.max(contains_text(F.col("event_text"), t)).alias(f"__t{i}") for i, t in enumerate(terms)]
        )
        for i in range(len(terms)):
            seen = seen.where(F.col(f"__t{i}"))
        out = out.join(seen.select(*TURN), TURN, "left_semi")
    if turn_id is not None:
        out = out.where((F.col("id") == turn_id) | (F.col("turn_id") == turn_id))
    return out


def sessions_by_turn(sessions: DataFrame, matching_turns: DataFrame, *, oldest_first: bool = False) -> DataFrame:
    """Sessions with at least one matching turn, by start time."""
    kept = sessions.join(matching_turns.select(*SESSION), SESSION, "left_semi")
    by = F.col("started_at").asc() if oldest_first else F.col("started_at").desc()
    return kept.orderBy(by, *SESSION)


def turn_lower_bounds(events: DataFrame, marker: str = "agent_turn") -> DataFrame:
    """Each marker with the first seq that belongs to its turn: one past the marker before it."""
    marks = events.where(F.col("t") == marker)
    out = scan(marks, SESSION, "seq", befores={"__prev": F.col("seq")})
    return out.withColumn("seq_from", F.coalesce(F.col("__prev") + 1, F.lit(0))).drop("__prev")


def unmatched_prompts(events: DataFrame) -> DataFrame:
    """Prompts that no assistant message or error follows before the next prompt or the end.

    For each session this is the open prompt at every later point until something closes
    it; the row carries the seq that closes it (NULL while it stays open).
    """
    kinds = events.where(F.col("t").isin("user_message", "assistant_message", "error"))
    nxt = scan(
        kinds, SESSION, "seq", befores={"__next": F.struct(F.col("t").alias("t"), F.col("seq").alias("seq"))}, reverse=True
    )
    return nxt.where(
        (F.col("t") == "user_message") & (F.col("__next").isNull() | (F.col("__next.t") == "user_message"))
    ).drop("__next")


def open_prompt_at(events: DataFrame, stop_type: str) -> DataFrame:
    """For each stop event, the open user message just before it, if any."""
    seen = events.where(F.col("t").isin("user_message", "assistant_message", "error", stop_type))
    closing = F.col("t").isin("user_message", "assistant_message", "error")
    out = scan(
        seen, SESSION, "seq", befores={"__last": F.when(closing, F.struct(F.col("t").alias("t"), F.col("seq").alias("seq")))}
    )
    return (
        out.where(F.col("t") == stop_type)
        .withColumn("prompt_seq", F.when(F.col("__last.t") == "user_message", F.col("__last.seq")))
        .drop("__last")
    )


def runs(events: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """Run lengths of equal neighbours, like counting repeats of adjacent lines."""
    marked = scan(events, SESSION, order, befores={"__prev": F.struct(F.col(value).alias("v"))})
    changed = F.col("__prev").isNull() | ~F.col("__prev.v").eqNullSafe(F.col(value))
    narrow = marked.select(*SESSION, order, value, changed.alias("__new"))
    marked = scan(
        cut_lineage(narrow), SESSION, order, sums={"run_no": F.when(F.col("__new"), 1).otherwise(0)}
    )
    return marked.groupBy(*SESSION, "run_no").agg(
        F.first(value).alias(value), F.count(F.lit(1)).alias("length"), F.min(order).alias("first_seq")
    )


def elide_middle(events: DataFrame, line: Column, *, read: int = 500, keep: int = 200) -> DataFrame:
    """At most ``read`` lines per session; above ``keep`` the head, an elision row and the tail."""
    head, tail = keep // 2, keep - keep // 2 - 1
    numbered = scan(events, SESSION, "seq", sums={"n": F.lit(1)})
    lines = numbered.where(F.col("n") <= read).withColumn("line", line)
    sizes = lines.groupBy(*SESSION).agg(F.max("n").alias("total"))
    joined = lines.join(sizes, SESSION)
    kept = joined.where((F.col("total") <= keep) | (F.col("n") <= head) | (F.col("n") > F.col("total") - tail))
    gap = sizes.where(F.col("total") > keep).select(
        *SESSION,
        F.lit(head + 1).cast("bigint").alias("n"),
        F.format_string("... (%d lines elided) ...", F.col("total") - head - tail).alias("line"),
    )
    return kept.select(*SESSION, "n", "line").unionByName(gap)


def timeline_text(lines: DataFrame) -> DataFrame:
    """The elided lines of a session as one text; they are bounded by ``keep``."""
    ordered = F.sort_array(F.collect_list(F.struct("n", "line")))
    return lines.groupBy(*SESSION).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("timeline"))
