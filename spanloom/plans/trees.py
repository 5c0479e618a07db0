"""Turn trees of each platform as flat tables, and the review report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import scan
from spanloom.operators import pairing, review, usage
from spanloom.operators.catalog import cohort
from spanloom.session import cut_lineage
from spanloom.sources import claude, codex

SESSION = ["platform", "session_id"]


def claude_tree(events: DataFrame, frames: DataFrame, turn_rows: DataFrame) -> dict[str, DataFrame]:
    """Turns, calls, tools, permissions and child windows of claude sessions.

    ``turn_rows``: events with their ``turn_no``.  Tools and permissions inside a child's window belong to the child;
    the others hang under the call that asked for them, or under the turn.
    """
    grouped = claude.grouped_frames(frames)
    calls = cut_lineage(claude.calls(grouped))
    parts = claude.parts(frames, grouped)
    mentions = claude.tool_mentions(parts)
    windows = cut_lineage(pairing.subagent_windows(events))
    kinds = events.where(F.col("t").isin("tool_call", "tool_result", "permission_request", "permission_denied"))
    owners = pairing.owning_agent(kinds, windows)
    pairs = pairing.pair_tools_by_id(events, ["tool_name", "ts"])
    pairs = pairs.select(*SESSION, "tool_use_id", F.col("call.seq").alias("call_seq"), "seq", F.col("call.tool_name").alias("name"), F.col("call.ts").alias("start_ts"), F.col("ts").alias("end_ts"))
    tools = pairs.join(owners, [*SESSION, "seq"], "left").join(pairing.requesting_call(mentions), [*SESSION, "tool_use_id"], "left")
    place = turn_rows.select(*SESSION, F.col("seq").alias("call_seq"), "turn_no")
    tools = tools.join(place, [*SESSION, "call_seq"], "left")
    asked = kinds.where(F.col("t").isin("permission_request", "permission_denied")).join(owners, [*SESSION, "seq"], "left")
    return {"calls": calls, "tools": tools, "permissions": asked, "subagents": windows, "outputs": claude.fallback_output(parts)}


def _nodes(rows: DataFrame, kind: str, node: Column, parent: Column, **columns: Column | str) -> DataFrame:
    """Tree rows of one kind; absent columns are NULL."""
    types = {"turn_id": "string", "name": "string", "start_seq": "bigint", "end_seq": "bigint", "start_ts": "timestamp", "end_ts": "timestamp"}
    shown = [(F.col(c) if isinstance(c, str) else c) if (c := columns.get(n)) is not None else F.lit(None) for n in types]
    return rows.select(
        *SESSION, F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}/"), node.cast("string")).alias("node_id"), parent.alias("parent_id"),
        *[c.cast(t).alias(n) for c, (n, t) in zip(shown, types.items(), strict=True)],
    )


def _under(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), key.cast("string"))


def codex_turn_tree(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Codex sessions as one flat tree: kind, node_id, parent_id, turn_id, name, start_seq, end_seq, start_ts, end_ts.

    ``frames`` are a session's rollout; ``events`` its stored events, in which a turn ends at an
    ``agent_turn`` marker that names it.  Turns are roots; calls, permission requests and
    children hang under their turn, tools under the call that asked for them.  Requests and
    children belong to the turn of the next marker: a request if its time fits as
    well, children paired inside that turn only.  Markers of a turn without frames count for nothing.
    """
    messages = codex.normal_messages(codex.turn_frames(frames))
    rows = cut_lineage(codex.call_frames(messages))
    turns = cut_lineage(codex.turns(messages))
    stamp = events.schema["ts"].dataType
    marks = events.where("t = 'agent_turn'").join(turns.select(*SESSION, "turn_id", "start_ts", "end_ts"), [*SESSION, "turn_id"])
    marks = cut_lineage(marks.select(*SESSION, "seq", "turn_id", F.col("start_ts").cast(stamp).alias("start_ts"), F.col("end_ts").cast(stamp).alias("end_ts")))
    asked = pairing.permissions_in_turn(events, marks).join(marks.select(*SESSION, F.col("seq").alias("turn_seq"), "turn_id"), [*SESSION, "turn_seq"])
    kin = events.where("t in ('subagent_start', 'subagent_message')").select(*SESSION, "seq", "t", "agent_id", F.lit(None).cast("string").alias("turn_id"))
    both = kin.unionByName(marks.select(*SESSION, "seq", F.lit("agent_turn").alias("t"), F.lit(None).cast("string").alias("agent_id"), "turn_id"))
    ending = F.when(F.col("t") == "agent_turn", F.struct("seq", "turn_id"))
    placed = scan(both, SESSION, "seq", befores={"ends": ending}, reverse=True).where("t <> 'agent_turn' and ends is not null")
    scope = [*SESSION, "turn_seq", "turn_id"]
    children = pairing.pair_subagents(cut_lineage(placed.select(*SESSION, "seq", "t", "agent_id", F.col("ends.seq").alias("turn_seq"), F.col("ends.turn_id").alias("turn_id"))), scope)
    turn = _under("turn", F.col("turn_id"))
    call = F.concat_ws(":", "turn_id", F.col("call_no").cast("string"))
    parts = [
        _nodes(turns, "turn", F.col("turn_id"), F.lit(None).cast("string"), turn_id="turn_id", name="model", start_ts="start_ts", end_ts="end_ts"),
        _nodes(codex.calls(rows), "call", call, turn, turn_id="turn_id", start_ts="start_ts", end_ts="end_ts"),
        _nodes(codex.tool_spans(rows), "tool", F.col("pos"), _under("call", call), turn_id="turn_id", name="name", start_seq="pos", start_ts="start_ts", end_ts="end_ts"),
        _nodes(asked, "permission", F.col("seq"), turn, turn_id="turn_id", start_seq="seq", end_seq="seq", start_ts="ts", end_ts="ts"),
        _nodes(children, "subagent", F.col("start_seq"), turn, turn_id="turn_id", name="agent_id", start_seq="start_seq", end_seq="stop_seq"),
    ]
    return reduce(DataFrame.unionByName, parts)


def cursor_turn_tree(events: DataFrame, *, session_wide: bool = False) -> DataFrame:
    """Cursor sessions as one flat tree, with the columns of ``codex_turn_tree``; turn_id is the generation.

    A generation is a turn, unless a started child runs under it.  A child hangs under the turn of
    its start, or under the child that dispatched it.  Tools pair inside their generation; one
    inside the window of a child of that generation (the latest started, if several) is
    this child's, without the calls that dispatched grandchildren, another one its turn's.  What has neither has no parent.
    ``session_wide`` adds a root for each session, over all that have no parent.
    """
    from spanloom.functions.ids import child_generation_id
    from spanloom.operators.interactions import own_tools

    events = cut_lineage(events)
    windows = pairing.lifecycle_windows(events).where("start_seq is not null").withColumn("generation", child_generation_id(F.col("start_ref")))
    windows = cut_lineage(windows)
    starts = events.where("t = 'subagent_start'").select(*SESSION, F.col("seq").alias("start_seq"), F.col("generation").alias("own"))
    child_of = windows.where("generation <> ''").select(*SESSION, "generation").distinct()
    turns = events.where("generation <> ''").groupBy(*SESSION, "generation").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))
    turns = cut_lineage(turns.join(child_of, [*SESSION, "generation"], "left_anti"))
    inner = pairing.events_for_subagent(events.select(*SESSION, "seq", "t", "generation", "call_ref"), windows)
    held = inner.groupBy(*SESSION, "seq").agg(F.max("start_seq").alias("window_seq"))
    dispatched = inner.where("t in ('tool_call', 'tool_result')")
    outside = dispatched.join(own_tools(dispatched, events).select(*SESSION, "seq").distinct(), [*SESSION, "seq"], "left_anti").select(*SESSION, "seq").distinct()
    tools = pairing.pair_two_sided(events).withColumn("seq", F.coalesce("call_seq", "result_seq"))
    tools = tools.join(outside, [*SESSION, "seq"], "left_anti").join(held, [*SESSION, "seq"], "left")
    names = events.select(*SESSION, "seq", "name")
    tools = tools.join(names, [*SESSION, "seq"])
    root = turns.select(*SESSION, F.col("generation").alias("own"), F.lit(True).alias("is_turn"))
    tools = tools.withColumn("own", F.col("generation")).join(root, [*SESSION, "own"], "left")
    kids = windows.join(starts, [*SESSION, "start_seq"]).join(held.withColumnsRenamed({"seq": "start_seq"}), [*SESSION, "start_seq"], "left").join(root, [*SESSION, "own"], "left")
    place = F.when(F.col("window_seq").isNotNull(), _under("subagent", F.col("window_seq"))).when(F.col("is_turn"), _under("turn", F.col("own")))
    parts = [
        _nodes(turns, "turn", F.col("generation"), F.lit(None).cast("string"), turn_id="generation", start_seq="start_seq", end_seq="end_seq"),
        _nodes(kids, "subagent", F.col("start_seq"), place, turn_id="own", name="child_id", start_seq="start_seq", end_seq="stop_seq"),
        _nodes(tools, "tool", F.col("seq"), place, turn_id="own", name="name", start_seq="call_seq", end_seq="result_seq"),
    ]
    nodes = reduce(DataFrame.unionByName, parts)
    if not session_wide:
        return nodes
    top = F.concat_ws("/", F.lit("session"), *SESSION)
    sessions = events.groupBy(*SESSION).agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))
    roots = _nodes(sessions, "session", F.concat_ws("/", *SESSION), F.lit(None).cast("string"), start_seq="start_seq", end_seq="end_seq")
    return nodes.withColumn("parent_id", F.coalesce("parent_id", top)).unionByName(roots)


def background_children(starts: DataFrame, ended: DataFrame, exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stops to synthesise for children whose transcript ended, once per unmatched dispatch, and the rest as warnings."""
    waiting = ended.join(exported.select(*SESSION, "child_session"), [*SESSION, "child_session"], "left_anti")
    tasks = pairing.task_for_child(starts, waiting)
    stops = tasks.select(*SESSION, F.col("task_id").alias("child_id"), "child_session", F.lit("subagent_message").alias("t"))
    lost = waiting.join(stops.select(*SESSION, "child_session"), [*SESSION, "child_session"], "left_anti")
    warnings = lost.select(*SESSION, F.lit("warning").alias("level"), F.lit("pair_child").alias("phase"), F.concat(F.lit("no open dispatch for child "), "child_session").alias("message"))
    return stops, warnings


def review_report(sessions: DataFrame, events: DataFrame, calls: DataFrame, first_text: Column, *, more_than: int = 20) -> DataFrame:
    """Cohort with task shape, waste flags and token cost per session, and how it compares with the cohort median."""
    picked = cohort(sessions, more_than=more_than)
    profile = review.waste_signatures(review.session_profile(events))
    cost = usage.usage_rollup(calls).select(*SESSION, "calls", "total_tokens")
    out = picked.join(profile.drop("events"), SESSION).join(review.task_shape(events, first_text), SESSION, "left").join(cost, SESSION, "left")
    out = out.withColumn("shape", F.coalesce("shape", F.lit("other")))
    medians = out.groupBy("shape").agg(F.median("tool_calls").alias("median_tool_calls"))
    return out.join(medians, "shape", "left")
