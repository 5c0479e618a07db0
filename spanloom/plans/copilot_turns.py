"""Turns, calls, tools and open items of the copilot platform, from its normal events.

Every rule of the state the events describe is a keyed aggregation or a scan over
narrow rows; an item is one (session, interaction, agent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import CHUNK_ROWS, scan, walk, whole_keys
from spanloom.functions.payload import get
from spanloom.operators.lineage import resolve_roots
from spanloom.session import cut_lineage

# The session comes first, as rows are sorted by leading bytes of the first key.
SESSION = ["session_id", "platform"]
ITEM = [*SESSION, "interaction_id", "agent"]
ENDS = ("assistant_turn_end", "abort", "error")
OPENERS = ("user_prompt", "assistant_turn_start", "assistant_message", "permission_request", "permission_decision")


def narrow(events: DataFrame, source_key: Column) -> DataFrame:
    """Transcript events with the fields the rules read; raw payloads stay behind."""
    d = F.col("data")
    kept = events.where((F.col("source_kind") == "transcript") & ~F.coalesce(F.col("native_type").startswith("tool.") & (F.col("kind") == "error"), F.lit(False)))
    return kept.where("kind not in ('notification', 'unknown', 'auxiliary_model_call', 'compaction')").select(
        *SESSION,
        "pos",
        "source_id",
        source_key.alias("source_key"),
        "ts",
        "kind",
        "interaction_id",
        F.coalesce("agent_id", F.lit("")).alias("agent"),
        F.col("native_turn_id").alias("native_turn"),
        "tool_call_id",
        "parent_tool_call_id",
        "model",
        "tool_name",
        F.nullif(get(d, "content"), F.lit("")).alias("content"),
        (get(d, "phase") == "final_answer").alias("final"),
        get(d, "decision").alias("decision"),
    )


def _walk_ends() -> tuple:
    """Owner of each end when some ends of an (agent, native turn) name no interaction."""
    live: dict[str, None] = {}

    def on_row(row) -> list[tuple]:
        if row.kind not in ENDS:
            live[row.interaction_id] = None
            return []
        named = row.interaction_id if isinstance(row.interaction_id, str) else None
        owner = (named if named in live else None) if named else (next(iter(live)) if len(live) == 1 else None)
        live.pop(owner, None)
        return [(owner, int(row.pos))]

    return on_row, list


def end_owners(rows: DataFrame, *, width: int = CHUNK_ROWS, whole: bool = False) -> DataFrame:
    """Interaction that each turn end, abort or error belongs to.

    A start or message binds (agent, interaction, native turn) until an end takes it.  An
    end that names no interaction takes the only bound one of its agent and native turn.
    """
    turn = [*SESSION, "agent", "native_turn"]
    named = rows.where(F.col("native_turn").isNotNull())
    binds = named.where("kind in ('assistant_turn_start', 'assistant_message') and interaction_id is not null")
    ends = named.where(F.col("kind").isin(*ENDS))
    both = binds.unionByName(ends).select(*turn, "interaction_id", "pos", "kind")
    vague = ends.where("interaction_id is null").select(*turn).distinct()
    plain = both.join(vague, turn, "left_anti")
    plain = scan(plain, [*turn, "interaction_id"], "pos", befores={"prev": F.struct(F.col("kind").alias("k"))}, width=width, whole=whole)
    bound = F.coalesce(~F.col("prev.k").isin(*ENDS), F.lit(False))
    direct = plain.where(F.col("kind").isin(*ENDS)).select(*SESSION, "pos", F.when(bound, F.col("interaction_id")).alias("owner"))
    walked = walk(
        both.join(vague, turn, "left_semi"), turn, "pos",
        rows.select(*turn, F.col("interaction_id").alias("owner"), "pos").schema, _walk_ends,
    ).select(*SESSION, "pos", "owner")
    return direct.unionByName(walked)


def finishes(calls: DataFrame, ends: DataFrame, *, width: int = CHUNK_ROWS, whole: bool = False) -> DataFrame:
    """Call each end finishes: the only open one of its item and native turn.

    An end matches when exactly one call came since the end before it; after a gap with
    two or more calls the native turn never has a single open call again.
    """
    key = [*ITEM, "native_turn"]
    cells = calls.where("native_turn is not null").select(*key, "pos", F.lit(True).alias("is_call")).unionByName(
        ends.where("native_turn is not null").select(*key, "pos", F.lit(False).alias("is_call"))
    )
    rows = scan(cells, key, "pos", sums={"n": F.when(F.col("is_call"), 1).otherwise(0)}, lasts={"call_pos": F.when(F.col("is_call"), F.col("pos"))}, width=width, whole=whole)
    # Without counts in between, the three scans share one shuffle and one sort.
    cut = (lambda df: df) if whole else cut_lineage
    rows = cut(rows.where("not is_call"))
    rows = scan(rows, key, "pos", befores={"before": F.col("n")}, width=width, whole=whole)
    gap = F.col("n") - F.coalesce("before", F.lit(0))
    rows = cut(rows.select(*key, "pos", "call_pos", gap.alias("gap")))
    rows = scan(rows, key, "pos", sums={"wide": F.when(F.col("gap") > 1, 1).otherwise(0)}, width=width, whole=whole)
    return rows.where("gap = 1 and wide = 0").select(*SESSION, F.col("pos").alias("end_pos"), "call_pos")


def build(events: DataFrame, source_key: Column | None = None) -> dict[str, DataFrame]:
    """Tables of whole sessions: ``turns``, ``calls``, ``call_tools``, ``tools``, ``permissions``, ``pending`` and their sources, ``ends`` with their interactions.

    A turn hangs under the completed turn whose tool call started its agent.  One that does not
    lead to a completed main turn is lost: its calls keep no turn.
    """
    return assemble(cut_lineage(narrow(events, F.lit("key") if source_key is None else source_key)))


def assemble(rows: DataFrame) -> dict[str, DataFrame]:
    """``build`` from ``narrow`` rows, such as a stream carries.

    Every scan is over some rows of a session, so if no session is large they need not look for large keys.
    """
    whole = whole_keys(rows, SESSION)
    opened = rows.where(F.col("kind").isin(*OPENERS) & F.col("interaction_id").isNotNull())
    messages = opened.where("kind = 'assistant_message'")
    requests = rows.where("kind = 'tool_request'")

    owners = end_owners(rows, whole=whole)
    first_open = opened.groupBy(*ITEM).agg(F.min("pos").alias("first_pos"))
    ends = rows.where(F.col("kind").isin(*ENDS)).join(owners, [*SESSION, "pos"], "left")
    late = ends.withColumn("named", F.col("interaction_id")).drop("interaction_id").join(
        first_open.withColumnRenamed("interaction_id", "named"), [*SESSION, "agent", "named"], "left"
    )
    known = F.when((F.col("kind") != "assistant_turn_end") & (F.col("first_pos") < F.col("pos")), F.col("named"))
    ends = cut_lineage(late.withColumn("interaction_id", F.coalesce("owner", known)).drop("owner", "named", "first_pos"))
    owned = ends.where("interaction_id is not null")

    wanted = requests.select(*SESSION, F.col("source_id"), "tool_call_id")
    asks = wanted.groupBy(*SESSION, "source_id").agg(F.count(F.lit(1)).alias("tools"))
    finish = finishes(messages, owned, whole=whole)
    calls = messages.join(asks, [*SESSION, "source_id"], "left").withColumn("tools", F.coalesce("tools", F.lit(0)))
    end_facts = owned.select(*SESSION, F.col("pos").alias("end_pos"), F.col("ts").alias("end_ts"), F.col("kind").alias("finish_kind"))
    done = finish.join(end_facts, [*SESSION, "end_pos"]).withColumnRenamed("call_pos", "pos")
    calls = cut_lineage(calls.join(done, [*SESSION, "pos"], "left"))

    kids = _parents(rows, requests, whole)
    items = _items(rows, opened, owned, calls, whole)
    items = cut_lineage(items.join(kids, [*SESSION, "agent"], "left"))
    name = F.concat_ws(":", F.lit("copilot"), F.lit("turn"), "source_key", "session_id", "interaction_id", F.nullif(F.col("agent"), F.lit("")))
    parent = F.concat_ws(":", F.lit("copilot"), F.lit("turn"), "source_key", "session_id", "parent_interaction", F.nullif(F.col("parent_agent"), F.lit("")))
    turns = items.withColumns({"turn_id": name, "parent_turn_id": F.when(F.col("parent_interaction").isNotNull(), parent)})
    done = turns.where("complete").select(*SESSION, "turn_id", "parent_turn_id", "agent")
    rooted = resolve_roots(done, SESSION, "turn_id", "parent_turn_id", F.col("agent") == "", "main_turn_id")
    turns = turns.join(rooted.select(*SESSION, "turn_id", "main_turn_id"), [*SESSION, "turn_id"], "left")
    turns = cut_lineage(turns.withColumn("lost", F.col("complete") & F.col("main_turn_id").isNull()))
    sources = opened.select(*ITEM, "source_id").unionByName(owned.select(*ITEM, "source_id")).distinct()
    sources = sources.join(turns.select(*ITEM, "turn_id"), ITEM).select(*SESSION, "turn_id", "source_id")
    named_calls = calls.join(turns.select(*ITEM, "turn_id", "lost"), ITEM, "left").select(
        *SESSION, "pos", F.concat(F.lit("copilot:call:"), "source_id").alias("call_id"), F.when(~F.col("lost"), F.col("turn_id")).alias("stored_turn_id"),
        "interaction_id", F.nullif(F.col("agent"), F.lit("")).alias("agent_id"), "parent_tool_call_id", F.col("native_turn").alias("native_turn_id"), "model",
        F.col("ts").alias("start_ts"), F.coalesce("end_ts", "ts").alias("end_ts"), "source_id", "tools", "finish_kind",
        F.col("finish_kind").isNotNull().alias("has_finish"),
    )
    return {
        "turns": turns,
        "calls": named_calls,
        "call_tools": requests.select(*SESSION, F.concat(F.lit("copilot:call:"), "source_id").alias("call_id"), "tool_call_id"),
        "tools": tool_spans(rows, requests),
        "permissions": permissions(opened, whole),
        "turn_sources": sources,
        "ends": ends.select(*SESSION, "pos", F.col("interaction_id").alias("owner")),
        **pending(rows, turns, owned, ends, finish, requests, calls, sources),
    }


def _parents(rows: DataFrame, requests: DataFrame, whole: bool) -> DataFrame:
    """Item and tool call each child agent hangs under: the last link whose request came before it."""
    linked = rows.where("agent <> '' and kind in ('subagent_started', 'subagent_completed', 'assistant_message') and parent_tool_call_id is not null")
    linked = linked.where("kind <> 'assistant_message' or interaction_id is not null")
    tool = [*SESSION, "tool"]
    ask = requests.where("interaction_id is not null").select(
        *SESSION, F.col("tool_call_id").alias("tool"), (F.col("pos") * 2 + 1).alias("at"), F.struct(F.col("interaction_id").alias("i"), F.col("agent").alias("a")).alias("owner"), F.lit(None).cast("string").alias("child")
    )
    link = linked.select(*SESSION, F.col("parent_tool_call_id").alias("tool"), (F.col("pos") * 2).alias("at"), F.lit(None).cast(ask.schema["owner"].dataType).alias("owner"), F.col("agent").alias("child"))
    seen = scan(ask.unionByName(link), tool, "at", befores={"held": F.col("owner")}, whole=whole).where("child is not null and held is not null")
    return seen.groupBy(*SESSION, F.col("child").alias("agent")).agg(F.max_by(F.struct("held", "tool"), "at").alias("p")).select(
        *SESSION, "agent", F.col("p.held.i").alias("parent_interaction"), F.col("p.held.a").alias("parent_agent"), F.col("p.tool").alias("parent_tool")
    )


def _items(rows: DataFrame, opened: DataFrame, owned: DataFrame, calls: DataFrame, whole: bool) -> DataFrame:
    """One row per item with window, texts, status and whether it is complete."""
    pos = F.col("pos")
    base = opened.groupBy(*ITEM).agg(
        F.min_by("source_key", "pos").alias("source_key"),
        F.min("pos").alias("first_pos"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), pos)).alias("start_ts"),
        F.max_by("content", F.when((F.col("kind") == "user_prompt") & F.col("content").isNotNull(), pos)).alias("input"),
        F.max_by("content", F.when((F.col("kind") == "assistant_message") & F.col("content").isNotNull(), pos)).alias("output"),
        F.min(F.when((F.col("kind") == "assistant_message") & F.col("final"), pos)).alias("final_pos"),
        F.max(F.when((F.col("kind") == "assistant_message") & F.col("final"), pos)).alias("last_final"),
    )
    closing = calls.where("finish_kind = 'assistant_turn_end' and tools = 0 and final").groupBy(*ITEM).agg(F.min("end_pos").alias("closed_pos"), F.max("end_pos").alias("closed_last"))
    stops = owned.groupBy(*ITEM).agg(
        F.min(F.when(F.col("kind") == "abort", pos)).alias("abort_pos"),
        F.min(F.when(F.col("kind") != "assistant_turn_end", pos)).alias("bad_pos"),
        F.max_by(F.struct("kind", "pos"), F.when(F.col("kind") != "assistant_turn_end", pos)).alias("bad"),
        F.max_by(F.struct("ts", "pos"), F.when(F.col("kind") != "error", pos)).alias("ended"),
    )
    items = base.join(closing, ITEM, "left").join(stops, ITEM, "left")
    own_close = F.least("closed_pos", "abort_pos")
    ready = F.least("final_pos", "bad_pos")
    shut = rows.where("kind in ('session_shutdown', 'session_end')")
    by_session = _next_after(items.withColumn("at", ready), shut, SESSION, "shut", whole)
    done = rows.where("kind = 'subagent_completed' and agent <> ''")
    by_child = _next_after(items.where("agent <> ''").withColumn("at", F.col("first_pos")), done, [*SESSION, "agent"], "kid", whole)
    items = items.join(by_session, ITEM, "left").join(by_child, ITEM, "left")
    outer = F.least("shut.pos", "kid.pos")
    outer_ts = F.when(F.col("shut.pos") == outer, F.col("shut.ts")).otherwise(F.col("kid.ts"))
    complete = F.least(own_close, outer).isNotNull()
    counts = outer.isNotNull() & (own_close.isNull() | (outer < own_close))
    end_ts = F.when(counts & (F.col("ended").isNull() | (outer > F.col("ended.pos"))), F.coalesce(outer_ts, "ended.ts")).otherwise(F.col("ended.ts"))
    status = F.when(F.col("bad").isNotNull() & (F.col("last_final").isNull() | (F.col("bad.pos") > F.col("last_final"))), F.when(F.col("bad.kind") == "abort", "interrupted").otherwise("errored"))
    return items.select(
        *ITEM, "source_key", "first_pos", F.coalesce("start_ts", F.lit("")).alias("start_ts"), F.coalesce(end_ts, "start_ts", F.lit("")).alias("end_ts"),
        F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"),
        F.coalesce(status, F.lit("completed")).alias("status"), complete.alias("complete"),
    )


def _next_after(items: DataFrame, marks: DataFrame, keys: list[str], name: str, whole: bool) -> DataFrame:
    """First mark of the key after ``at`` for each item, by one backward scan over both."""
    ident = F.struct(F.col("interaction_id").alias("i"), F.col("agent").alias("a"))
    left = items.where("at is not null").select(*keys, (F.col("at") * 2 + 1).alias("place"), ident.alias("item"), F.lit(None).cast("struct<pos:bigint,ts:string>").alias("mark"))
    right = marks.select(*keys, (F.col("pos") * 2).alias("place"), F.lit(None).cast(left.schema["item"].dataType).alias("item"), F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("ts").cast("string").alias("ts")).alias("mark"))
    seen = scan(left.unionByName(right), keys, "place", befores={name: F.col("mark")}, reverse=True, whole=whole).where(f"item is not null and {name} is not null")
    return seen.select(*SESSION, F.col("item.i").alias("interaction_id"), F.col("item.a").alias("agent"), name)


def tool_spans(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """One span per requested tool: last request, last start, last result."""
    key = [*SESSION, "tool_call_id"]
    asked = requests.groupBy(*key).agg(F.max_by(F.struct("source_id", "tool_name", "ts", "pos"), "pos").alias("ask"))
    kinds = {"started": ("tool_execution_start",), "result": ("tool_execution_complete", "tool_execution_failure")}
    out = asked
    for name, wanted in kinds.items():
        part = rows.where(F.col("kind").isin(*wanted) & F.col("tool_call_id").isNotNull()).join(asked.select(*key, F.col("ask.pos").alias("asked_at")), key).where("pos > asked_at")
        out = out.join(part.groupBy(*key).agg(F.max_by(F.struct("ts", "source_id", "kind"), "pos").alias(name)), key, "left")
    return out.select(
        *key, F.coalesce("ask.tool_name", F.lit("")).alias("name"), F.coalesce("started.ts", "ask.ts", F.lit("")).alias("start_ts"), F.coalesce("result.ts", F.lit("")).alias("end_ts"),
        F.col("ask.source_id").alias("request_source_id"), F.col("started.source_id").alias("start_source_id"), F.col("result.source_id").alias("result_source_id"),
        (F.col("result.kind") == "tool_execution_failure").alias("failed"),
    )


def permissions(opened: DataFrame, whole: bool = False) -> DataFrame:
    """Requests with the last decision that named them: the latest request of that tool before it."""
    rows = opened.where("kind in ('permission_request', 'permission_decision')").select(*ITEM, "pos", "kind", "tool_name", "decision", "source_id", "ts")
    asked = F.when(F.col("kind") == "permission_request", F.col("pos"))
    named = F.coalesce(F.col("tool_name") != "", F.lit(False))
    by_tool = scan(rows.where(named), [*ITEM, "tool_name"], "pos", befores={"request_pos": asked}, whole=whole).where("kind = 'permission_decision'")
    bare = rows.where((F.col("kind") == "permission_request") | ~named)
    by_any = scan(bare, ITEM, "pos", befores={"request_pos": asked}, whole=whole).where("kind = 'permission_decision'")
    decided = by_tool.unionByName(by_any.select(*by_tool.columns)).where("request_pos is not null")
    last = decided.groupBy(*ITEM, F.col("request_pos").alias("pos")).agg(F.max_by(F.struct("decision", "source_id"), "pos").alias("d"))
    return rows.where("kind = 'permission_request'").join(last, [*ITEM, "pos"], "left").select(
        *ITEM, "pos", "ts", F.coalesce("tool_name", F.lit("")).alias("tool_name"), F.col("d.decision").alias("decision"), F.col("d.source_id").alias("decision_source_id")
    )


PENDING = [*SESSION, "kind", "id", "reason", "evidence"]
# Reasons for items without an interaction, by the kind of their record, and its native name.
NAMELESS = {
    "user_prompt": ("user message has no interactionId", "user.message"),
    "assistant_turn_start": ("assistant turn has no interactionId", "assistant.turn_start"),
    "assistant_message": ("assistant message has no interactionId", "assistant.message"),
}


def _named(values: dict[str, str], by: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[by]


def _note(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), F.coalesce(value, F.lit("None")))


def pending(
    rows: DataFrame, turns: DataFrame, owned: DataFrame, ends: DataFrame, finish: DataFrame, requests: DataFrame, calls: DataFrame, sources: DataFrame
) -> dict[str, DataFrame]:
    """``pending``: open or unresolved things, one row per id; ``pending_sources``: their source records.

    A tool named by several records without a request before them is one thing, with the last
    record's reason; it stays one when a request without result comes as well.
    """

    def out(df: DataFrame, kind: str, ident: Column, reason: Column, *evidence: Column) -> DataFrame:
        return df.select(*SESSION, F.lit(kind).alias("kind"), ident.alias("id"), reason.alias("reason"), F.array(*evidence).alias("evidence"), "source_id")

    by_source = F.concat(F.lit("pending:identity:"), F.col("source_id"))
    cycle = _note("turn_id", F.col("native_turn"))
    nameless = rows.where(F.col("interaction_id").isNull() & F.col("kind").isin(*NAMELESS))
    result = out(
        nameless, "missing_identity", by_source, _named({k: v[0] for k, v in NAMELESS.items()}, F.col("kind")), _note("native_type", _named({k: v[1] for k, v in NAMELESS.items()}, F.col("kind")))
    )
    homeless = ends.where("interaction_id is null and kind = 'assistant_turn_end'")
    result = result.unionByName(out(homeless, "missing_identity", by_source, F.lit("assistant.turn_end has no matching open model cycle"), cycle))
    unmatched = owned.join(finish.select(*SESSION, F.col("end_pos").alias("pos")), [*SESSION, "pos"], "left_anti")
    result = result.unionByName(out(unmatched, "missing_identity", by_source, F.concat("kind", F.lit(" has no uniquely matching open model cycle")), cycle))

    key = [*SESSION, "tool_call_id"]
    asked = requests.groupBy(*key).agg(F.min("pos").alias("asked_at"), F.max_by("source_id", "pos").alias("asked_by"))
    runs = rows.where(F.col("kind").isin("tool_execution_start", "tool_execution_complete", "tool_execution_failure") & F.col("tool_call_id").isNotNull())
    early = runs.join(asked, key, "left").where("asked_at is null or pos < asked_at")
    early = early.groupBy(*key).agg(F.max_by(F.struct("kind", "source_id"), "pos").alias("r")).select(*key, "r.*")
    by_tool = F.concat(F.lit("pending:tool:"), F.col("tool_call_id"))
    what = F.when(F.col("kind") == "tool_execution_start", "tool execution start").otherwise("tool result")
    result = result.unionByName(out(early, "incomplete_tool_pair", by_tool, F.concat(what, F.lit(" has no requesting assistant message")), _note("tool_call_id", F.col("tool_call_id"))))
    answered = runs.where("kind <> 'tool_execution_start'").join(asked, key).where("pos > asked_at").select(*key)
    waiting = asked.join(answered, key, "left_anti").join(early, key, "left_anti").withColumnRenamed("asked_by", "source_id")
    result = result.unionByName(out(waiting, "incomplete_tool_pair", by_tool, F.lit("tool request has no execution result"), _note("tool_call_id", F.col("tool_call_id"))))
    single = result

    ended = calls.where("finish_kind is not null").select(*ITEM).distinct().withColumn("ended", F.lit(True))
    facts = turns.where("lost or not complete").join(ended, ITEM, "left")
    agent = F.nullif(F.col("agent"), F.lit(""))
    parts = facts.select(
        *SESSION,
        F.when(F.col("lost"), "missing_identity").otherwise("open_interaction").alias("kind"),
        F.concat(F.when(F.col("lost"), "pending:identity:").otherwise("pending:"), "turn_id").alias("id"),
        F.when(F.col("lost"), "completed child interaction has no resolved parent tool call")
        .when(F.col("ended"), "user interaction has no completed final assistant turn")
        .otherwise("user interaction has no assistant.turn_end").alias("reason"),
        F.when(F.col("lost"), F.array(_note("interaction_id", F.col("interaction_id")), _note("agent_id", agent))).otherwise(F.array(_note("interaction_id", F.col("interaction_id")))).alias("evidence"),
        "turn_id",
    )
    of_turns = parts.join(sources, [*SESSION, "turn_id"]).select(*SESSION, "id", "source_id")
    return {
        "pending": single.select(*PENDING).unionByName(parts.select(*PENDING)),
        "pending_sources": single.select(*SESSION, "id", "source_id").unionByName(of_turns),
    }


def main_turns(turns: DataFrame) -> DataFrame:
    """Completed turns of the main agent in order."""
    return turns.where("complete and agent = '' and status = 'completed'").orderBy(*SESSION, "start_ts", "turn_id")
