"""Pairing calls with results, starts with stops, and events with their owners."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.ordered import CHUNK_ROWS, queue_pairs, scan, stack_pairs, walk
from spanloom.session import cut_lineage

SESSION = ["platform", "session_id"]
# Names of the tool that dispatches a child agent.
DISPATCH_TOOLS = ("Task", "Agent")


def pair_tools_by_id(events: DataFrame, carry: Sequence[str] = (), *, width: int = CHUNK_ROWS) -> DataFrame:
    """Each result with the latest open call of its id; results without one are dropped.

    A new call replaces the open one and a result takes it, so a result has a partner
    exactly when the row before it under the same id is a call.
    """
    tools = events.where(F.col("t").isin("tool_call", "tool_result") & F.coalesce(F.col("tool_use_id") != "", F.lit(False)))
    fields = ["t", "seq", *carry]
    out = scan(
        tools,
        [*SESSION, "tool_use_id"],
        "seq",
        befores={"call": F.struct(*[F.col(c).alias(c) for c in fields])},
        width=width,
    )
    return out.where((F.col("t") == "tool_result") & (F.col("call.t") == "tool_call"))


def merge_payloads(call: Column, result: Column) -> Column:
    """Map union in which the result's entry wins."""
    kept = F.map_filter(call, lambda k, _v: ~F.map_contains_key(result, k))
    return F.map_concat(kept, result)


def _schema(texts: Sequence[str], *numbers: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in texts] + [T.StructField(c, T.LongType()) for c in numbers])


def _stack_level(width: int):
    """State of one chunk: pops take the newest live push, what is left goes on."""

    def start() -> tuple:
        live: list[tuple[int, float]] = []
        end = [0]

        def on_row(row) -> list[tuple]:
            seq = int(row.seq)
            end[0] = (seq // width + 1) * width
            if row.kind == "push":
                live.append((seq, float("inf") if pd.isna(row.gone_at) else float(row.gone_at)))
                return []
            while live and live[-1][1] <= seq:
                live.pop()
            return [(seq, "pop", None, live.pop()[0] if live else None)]

        def on_end() -> list[tuple]:
            return [(s, "push", None if g == float("inf") else int(g), None) for s, g in live if g >= end[0]]

        return on_row, on_end

    return start


def pair_tools_with_fallback(events: DataFrame, *, width: int = CHUNK_ROWS, fan: int = 64) -> DataFrame:
    """Parent call of every result: by id, else the newest call still open.

    Pairing by id needs no stack (see ``pair_tools_by_id``).  The other results pop a
    stack from which id-paired calls vanish at a known seq.  Chunks of the session
    settle what they can on their own; only unsettled pops and still-open pushes go on
    to chunks ``fan`` times as wide, until one chunk spans the longest session.
    """
    tools = events.where(F.col("t").isin("tool_call", "tool_result"))
    tools = cut_lineage(tools.select(*SESSION, "seq", "t", "tool_use_id"))
    has_id = F.coalesce(F.col("tool_use_id") != "", F.lit(False))
    cell = F.struct(F.col("t").alias("t"), F.col("seq").alias("seq"))
    ided = scan(tools.where(has_id), [*SESSION, "tool_use_id"], "seq", befores={"__prev": cell}, width=width)
    ided = scan(ided, [*SESSION, "tool_use_id"], "seq", befores={"__next": cell}, reverse=True, width=width)
    ided = ided.select(
        *SESSION,
        "seq",
        "t",
        F.when(
            (F.col("t") == "tool_result") & (F.col("__prev.t") == "tool_call"), F.col("__prev.seq")
        ).alias("by_id"),
        F.when((F.col("t") == "tool_call") & (F.col("__next.t") == "tool_result"), F.col("__next.seq")).alias("gone_at"),
    )
    none = F.lit(None).cast("bigint")
    rows = ided.unionByName(tools.where(~has_id).select(*SESSION, "seq", "t", none.alias("by_id"), none.alias("gone_at")))
    direct = rows.where("by_id is not null").select(*SESSION, "seq", F.col("by_id").alias("parent_seq"))

    pops = rows.where((F.col("t") == "tool_result") & F.col("by_id").isNull())
    pending = (
        rows.where(F.col("t") == "tool_call")
        .join(pops.select(*SESSION).distinct(), SESSION, "left_semi")
        .select(*SESSION, "seq", F.lit("push").alias("kind"), "gone_at", none.alias("mate"))
        .unionByName(pops.select(*SESSION, "seq", F.lit("pop").alias("kind"), "gone_at", none.alias("mate")))
    )
    longest = pending.agg(F.max("seq")).first()[0]
    settled = direct
    span = width
    while longest is not None:
        chunked = pending.withColumn("part", F.expr(f"cast(seq div {span} as string)"))
        schema = chunked.select(*SESSION, "part", "seq", "kind", "gone_at", "mate").schema
        step = walk(chunked.drop("mate"), [*SESSION, "part"], "seq", schema, _stack_level(span)).drop("part")
        last = span > longest
        if not last:
            step = cut_lineage(step)
        done = step.where("kind = 'pop' and mate is not null")
        settled = settled.unionByName(done.select(*SESSION, "seq", F.col("mate").alias("parent_seq")))
        if last:
            rest = step.where("kind = 'pop' and mate is null")
            settled = settled.unionByName(rest.select(*SESSION, "seq", none.alias("parent_seq")))
            break
        pending = step.where("mate is null")
        span *= fan
    return settled


def _positional() -> tuple:
    """First-in-first-out pairing of one tool family.

    Rows with an id are settled already; they only hold their place until ``gone_at``.
    """
    waiting: dict[str, list[tuple[str, bool, int, float]]] = {"tool_call": [], "tool_result": []}

    def on_row(row) -> list[tuple]:
        seq = int(row.seq)
        until = float("inf") if pd.isna(row.gone_at) else float(row.gone_at)
        if row.has_id:
            waiting[row.t].append((row.pair_key, True, seq, until))
            return []
        side = "tool_result" if row.t == "tool_call" else "tool_call"
        waiting[side] = other = [w for w in waiting[side] if w[3] > seq]
        at = next((i for i, w in enumerate(other) if w[0] == row.pair_key), None)
        if at is None and row.bare and other and not other[0][1]:
            at = 0
        if at is None:
            waiting[row.t].append((row.pair_key, False, seq, until))
            return []
        mate = other.pop(at)[2]
        return [(seq, mate) if row.t == "tool_call" else (mate, seq)]

    def on_end() -> list[tuple]:
        alone = {t: [w[2] for w in rows if not w[1]] for t, rows in waiting.items()}
        return [(s, None) for s in alone["tool_call"]] + [(None, s) for s in alone["tool_result"]]

    return on_row, on_end


def pair_two_sided(events: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Calls and results where either may come first, as (call_seq, result_seq, unmatched).

    Needs ``generation``, ``family``, ``name``, ``call_ref`` (id), ``signature`` and ``instant``.  Rows with equal
    key pair first-in-first-out: the k-th call with the k-th result.  Families holding a
    row with neither id nor signature also pair by position, which depends on everything
    open before; only their narrow rows go through Python, in seq order, batch by batch.
    """
    scope = [*SESSION, "generation"]
    group = [*scope, "family"]
    tools = events.where(F.col("t").isin("tool_call", "tool_result"))
    family = F.coalesce(F.nullif(F.col("family"), F.lit("")), F.col("name"))
    named = F.coalesce(F.col("call_ref") != "", F.lit(False))
    signed = F.coalesce(F.col("signature") != "", F.lit(False))
    keyed = tools.select(
        *SESSION,
        F.coalesce("generation", F.lit("")).alias("generation"),
        family.alias("family"),
        "seq",
        "t",
        F.when(named, F.concat(F.lit("id:"), "call_ref"))
        .when(signed, F.concat_ws(":", family, "name", "signature"))
        .otherwise(F.concat_ws(":", family, "name"))
        .alias("pair_key"),
        named.alias("has_id"),
        (~named & ~signed).alias("bare"),
        F.coalesce(F.col("instant"), F.lit(False)).alias("instant"),
    )
    at_once = keyed.where("instant").select(*scope, F.col("seq").alias("call_seq"), F.col("seq").alias("result_seq"))
    rest = cut_lineage(keyed.where("not instant"))
    mixed = rest.where("bare").select(*group).distinct()
    by_key = rest.where("has_id").unionByName(rest.where("not has_id").join(mixed, group, "left_anti").select(*rest.columns))
    numbered = cut_lineage(scan(by_key, [*scope, "pair_key", "t"], "seq", sums={"k": F.lit(1)}, width=width))
    on = [*scope, "pair_key", "k"]
    calls = numbered.where("t = 'tool_call'").select(*on, F.col("seq").alias("call_seq"), F.col("family").alias("cf"))
    results = numbered.where("t = 'tool_result'").select(*on, F.col("seq").alias("result_seq"), F.col("family").alias("rf"))
    pairs = cut_lineage(calls.join(results, on, "full_outer"))

    first_is_call = F.col("result_seq").isNull() | (F.col("call_seq") < F.col("result_seq"))
    holders = pairs.where(F.col("pair_key").startswith("id:")).select(
        *scope,
        F.when(first_is_call, F.col("cf")).otherwise(F.col("rf")).alias("family"),
        F.least("call_seq", "result_seq").alias("seq"),
        F.when(first_is_call, "tool_call").otherwise("tool_result").alias("t"),
        "pair_key",
        F.lit(True).alias("has_id"),
        F.lit(False).alias("bare"),
        F.when(F.col("call_seq").isNotNull() & F.col("result_seq").isNotNull(), F.greatest("call_seq", "result_seq")).alias("gone_at"),
    )
    guessing = rest.where("not has_id").withColumn("gone_at", F.lit(None).cast("bigint")).drop("instant")
    narrow = guessing.unionByName(holders).join(mixed, group, "left_semi")
    guessed = walk(narrow, group, "seq", _schema(group, "call_seq", "result_seq"), _positional).drop("family")
    return (
        pairs.select(*scope, "call_seq", "result_seq")
        .unionByName(guessed)
        .unionByName(at_once)
        .withColumn(
            "unmatched",
            F.when(F.col("call_seq").isNull(), "result").when(F.col("result_seq").isNull(), "call"),
        )
    )


def subagent_windows(events: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Start..stop windows per agent with the dispatching call's seq.

    A later start of an agent replaces its open one; each start takes the oldest
    dispatch call not yet taken, if any, and the agent keeps it until its next stop.
    """
    dispatch = (F.col("t") == "tool_call") & F.col("tool_name").isin(*DISPATCH_TOOLS)
    named = F.coalesce(F.col("agent_id") != "", F.lit(False))
    start = (F.col("t") == "subagent_start") & named & ~F.coalesce(dispatch, F.lit(False))
    stop = (F.col("t") == "subagent_message") & named
    rows = events.where(dispatch | start | stop)
    rows = rows.select(*SESSION, "seq", "t", "tool_name", "agent_id")
    queued = cut_lineage(queue_pairs(rows, SESSION, "seq", dispatch, start, width=width))
    tasks = queued.where(dispatch & F.col("pair_no").isNotNull()).select(*SESSION, "pair_no", F.col("seq").alias("task_seq"))
    life = (
        queued.where(start | stop)
        .withColumn("pair_no", F.when(start, F.col("pair_no")))
        .join(tasks, [*SESSION, "pair_no"], "left")
        .select(*SESSION, "agent_id", "seq", "t", "task_seq")
    )
    agent = [*SESSION, "agent_id"]
    life = scan(life, agent, "seq", befores={"__prev": F.struct(F.col("t").alias("t"), F.col("seq").alias("seq"))}, width=width)
    ends = (F.col("t") == "subagent_message") & (F.col("__prev.t") == "subagent_start")
    life = cut_lineage(life.withColumn("__ends", ends))
    life = scan(life, agent, "seq", sums={"__w": F.when(F.col("__ends"), 1).otherwise(0)}, width=width)
    life = life.withColumn("__w", F.when(F.col("__ends"), F.col("__w") - 1).otherwise(F.col("__w")))
    return (
        life.groupBy(*agent, "__w")
        .agg(
            F.max(F.when(F.col("__ends"), F.col("__prev.seq"))).alias("start_seq"),
            F.max(F.when(F.col("__ends"), F.col("seq"))).alias("stop_seq"),
            F.max("task_seq").alias("task_seq"),
        )
        .where("stop_seq is not null")
        .drop("__w")
    )


def _inside(points: DataFrame, windows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of points and windows with equal keys and start_seq <= seq <= stop_seq.

    A window lies in at most two cells of its own level, each level's cells being four times as wide as those of the one below,
    so it makes two rows at most, however long it is.  A point is looked up at those levels that windows of its key have.
    """
    keys = list(keys)
    span = f"(stop_seq div {width} - start_seq div {width})"
    spans = windows.where("start_seq <= stop_seq").withColumn("__level", F.expr(f"case when {span} <= 1 then 0 else (length(bin({span} - 1)) + 1) div 2 end").cast("int"))
    levels = spans.groupBy(*keys).agg(F.collect_set("__level").alias("__levels"))
    cell = lambda c: f"shiftright({c} div {width}, 2 * __level)"
    spans = spans.withColumn("__cell", F.explode(F.expr(f"array_distinct(array({cell('start_seq')}, {cell('stop_seq')}))")))
    placed = points.join(levels, keys).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__cell", F.expr(cell("seq")))
    return placed.join(spans, [*keys, "__level", "__cell"]).where("seq between start_seq and stop_seq").drop("__level", "__cell")


def owning_agent(events: DataFrame, windows: DataFrame, *, width: int = 4096) -> DataFrame:
    """Owner of each event: its own agent id, else the narrowest window around its seq.

    The interval join is an equi-join on session and a cell of seq; the narrowest window
    is chosen by a partial aggregation, ties by the earliest start.  An owner without a
    window counts as none.
    """
    known = windows.select(*SESSION, "agent_id").distinct()
    tagged = (
        events.where(F.coalesce(F.col("agent_id") != "", F.lit(False)))
        .join(known.withColumn("__known", F.lit(True)), [*SESSION, "agent_id"], "left")
        .select(*SESSION, "seq", F.when(F.col("__known"), F.col("agent_id")).alias("owner"))
    )
    bare = events.where(~F.coalesce(F.col("agent_id") != "", F.lit(False))).select(*SESSION, "seq")
    spans = windows.select(*SESSION, F.col("agent_id").alias("owner"), "start_seq", "stop_seq")
    inside = (
        _inside(bare, spans, SESSION, width)
        .groupBy(*SESSION, "seq")
        .agg(F.min_by("owner", F.struct(F.expr("stop_seq - start_seq"), F.col("start_seq"))).alias("owner"))
    )
    return tagged.unionByName(bare.join(inside, [*SESSION, "seq"], "left"))


def permissions_in_turn(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Permission requests of the turn that ends at the next marker, when their time fits too.

    ``turns`` has one row per marker event (seq, start_ts, end_ts).  Seq ranges of turns do
    not overlap, so each request belongs to the next marker: a backward scan, not a range join.
    """
    asks = events.where(F.col("t") == "permission_request").select(
        *SESSION, "seq", "ts", F.lit(None).cast(turns.schema["start_ts"].dataType).alias("start_ts"),
        F.lit(None).cast(turns.schema["end_ts"].dataType).alias("end_ts"), F.lit(False).alias("mark"),
    )
    marks = turns.select(*SESSION, "seq", F.lit(None).cast(events.schema["ts"].dataType).alias("ts"), "start_ts", "end_ts", F.lit(True).alias("mark"))
    nxt = F.when(F.col("mark"), F.struct(F.col("seq").alias("seq"), F.col("start_ts").alias("a"), F.col("end_ts").alias("b")))
    out = scan(asks.unionByName(marks), SESSION, "seq", befores={"turn": nxt}, reverse=True)
    return out.where(~F.col("mark") & F.col("ts").between(F.col("turn.a"), F.col("turn.b"))).select(
        *SESSION, "seq", "ts", F.col("turn.seq").alias("turn_seq")
    )


#: Finest cell of the interval join, and its levels, each four times as wide as the one below: sixty years at the top.
CELL_SECONDS, LEVELS = 60, 14


def _cells(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Intervals with their first and last finest cell, and the level at which they span two cells at most."""
    cell = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div {CELL_SECONDS * 1_000_000}")
    out = df.where(F.col(start) <= F.col(end)).withColumns({f"{name}_a": cell(start), f"{name}_b": cell(end)})
    length = F.col(f"{name}_b") - F.col(f"{name}_a")
    level = F.when(length <= 1, 0)
    for j in range(1, LEVELS):
        level = level.when(length <= 4**j, j)
    return out.withColumn(f"{name}_level", level.otherwise(LEVELS))


def _spread(df: DataFrame, name: str, lowest: Column, highest: Column) -> DataFrame:
    out = df.withColumn("__level", F.explode(F.when(lowest <= highest, F.sequence(lowest, highest)).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("__cell", F.explode(F.expr(f"sequence(shiftright({name}_a, 2 * __level), shiftright({name}_b, 2 * __level))")))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals overlap, each pair once.

    The longer interval of a pair lies in at most two cells of its own level; the shorter is looked up
    there.  So an interval makes at most two rows per level, however long it is.  Intervals with a missing or
    unreadable end, or that run backwards, overlap nothing.
    """
    keys = list(keys)
    a, b = _cells(left, *left_span, "__l"), _cells(right, *right_span, "__r")
    top, own = F.lit(LEVELS), F.col
    longer_left = _spread(a, "__l", own("__l_level"), own("__l_level")).join(_spread(b, "__r", own("__r_level"), top), [*keys, "__level", "__cell"])
    longer_right = _spread(a, "__l", own("__l_level") + 1, top).join(_spread(b, "__r", own("__r_level"), own("__r_level")), [*keys, "__level", "__cell"])
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    once = F.expr("__cell = shiftright(greatest(__l_a, __r_a), 2 * __level)")
    meet = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    return longer_left.unionByName(longer_right.select(*longer_left.columns)).where(once & meet).select(*columns)


def windows_with_children(windows: DataFrame, children: DataFrame) -> DataFrame:
    """Each window with each child turn that overlaps it (c_start, c_end, prompt, output, status, calls, ...): the calls of a
    window are those of its rows, in the order of c_start, and are never gathered."""
    kids = children.withColumnsRenamed({"start_ts": "c_start", "end_ts": "c_end"})
    keys = ["platform", "child_id"] if "platform" in kids.columns else ["child_id"]
    return overlapping(windows, kids, keys, ("start_ts", "end_ts"), ("c_start", "c_end"))


def child_turns_overlapping(windows: DataFrame, children: DataFrame, *, keep: bool = False) -> DataFrame:
    """Child turns overlapping each window: first prompt, last output and status, number of calls.

    ``keep`` gives windows without such turns too, those without an end among them.
    """
    met = windows_with_children(windows, children)
    keys = [*SESSION, "child_id", "start_ts", "end_ts"]
    rank = F.struct("c_start", "c_end", "prompt")
    out = met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("children"),
        F.min_by("prompt", rank).alias("prompt"),
        F.max_by("output", rank).alias("output"),
        F.max_by("status", rank).alias("status"),
        F.sum("calls").alias("calls"),
    )
    if not keep:
        return out
    every = windows.select(*keys).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & every[k].eqNullSafe(out[k])
    rest = every.join(out, same, "left_anti")
    return out.unionByName(rest.withColumn("children", F.lit(0).cast("bigint")), allowMissingColumns=True)


def pair_subagents(events: DataFrame, scope: Sequence[str] = SESSION, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Starts and stops inside ``scope``: first-in-first-out per agent id, last-in-first-out without ids.

    The two rules never touch each other's starts, so each is a window computation.
    """
    start, stop = F.col("t") == "subagent_start", F.col("t") == "subagent_message"
    rows = events.where(start | stop)
    named = F.coalesce(F.col("agent_id") != "", F.lit(False))
    key = [*scope, "agent_id"]
    narrow = rows.where(named).select(*key, "seq", "t")
    queued = cut_lineage(queue_pairs(narrow, key, "seq", start, stop, width=width).where("pair_no is not null"))
    opened = queued.where(start).select(*key, "pair_no", F.col("seq").alias("start_seq"))
    closed = queued.where(stop).select(*key, "pair_no", F.col("seq").alias("stop_seq"))
    by_id = opened.join(closed, [*key, "pair_no"]).drop("pair_no")
    stacked = stack_pairs(rows.where(~named).select(*scope, "seq", "t"), scope, "seq", start, stop, width=width)
    by_depth = stacked.where(stop & F.col("partner").isNotNull()).select(
        *scope, F.lit(None).cast("string").alias("agent_id"), F.col("partner").alias("start_seq"), F.col("seq").alias("stop_seq")
    )
    return by_id.unionByName(by_depth)


def _resumed() -> tuple:
    """Windows of one child that has resumed dispatches."""
    queue: list[tuple[int, str, bool]] = []
    finished = [False]

    def on_row(row) -> list[tuple]:
        seq, ref = int(row.seq), row.call_ref or ""
        if row.t == "subagent_message":
            if queue:
                finished[0] = True
                start = queue.pop(0)
                return [(start[0], start[1], seq)]
            return [] if finished[0] else [(None, "", seq)]
        finished[0] = False
        resume = row.t == "tool_call"
        if not resume:
            same = next((q for q in queue if q[2] and (not ref or q[1] == ref)), None)
            if same is not None:
                queue.remove(same)
                ref, resume = ref or same[1], True
        queue.append((seq, ref, resume))
        return []

    return on_row, list


def lifecycle_windows(events: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """First-in-first-out start/stop windows per child id, counting a resumed dispatch as a start.

    Needs ``child_id``, ``call_ref`` and ``resume`` (true on a dispatch call that resumes; its child id is its
    call id).  A later real start replaces a resume still in the queue.  Stops after a
    completed window are repeats; a stop nothing started makes a window without start.
    Children without a resume pair by window functions; only the narrow rows of the
    others are read in order, batch by batch.
    """
    key = [*SESSION, "child_id"]
    named = F.coalesce(F.col("child_id") != "", F.lit(False))
    resumes = (F.col("t") == "tool_call") & F.coalesce(F.col("resume"), F.lit(False))
    rows = events.where(named & (resumes | F.col("t").isin("subagent_start", "subagent_message")))
    rows = cut_lineage(rows.select(*key, "seq", "t", "call_ref"))
    resumed = rows.where("t = 'tool_call'").select(*key).distinct()

    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in key]
        + [T.StructField("start_seq", T.LongType()), T.StructField("start_ref", T.StringType()), T.StructField("stop_seq", T.LongType())]
    )
    with_resume = walk(rows.join(resumed, key, "left_semi"), key, "seq", schema, _resumed)

    plain = rows.join(resumed, key, "left_anti")
    start, stop = F.col("t") == "subagent_start", F.col("t") == "subagent_message"
    paired = cut_lineage(queue_pairs(plain, key, "seq", start, stop, width=width))
    begun = paired.where(start).select(*key, "pair_no", F.col("seq").alias("start_seq"), F.col("call_ref").alias("start_ref"))
    done = paired.where(stop & F.col("pair_no").isNotNull()).select(*key, "pair_no", F.col("seq").alias("stop_seq"))
    windows = begun.join(done, [*key, "pair_no"]).drop("pair_no")
    seen = scan(
        paired.where(stop), key, "seq", befores={"__done": F.when(F.col("pair_no").isNotNull(), F.col("seq"))}, width=width
    )
    lone = seen.where("pair_no is null and __done is null").select(*key, "seq").unionByName(
        events.where(stop & ~named).select(*SESSION, F.lit("").alias("child_id"), "seq")
    )
    return (
        windows.unionByName(with_resume)
        .unionByName(
            lone.select(*key, F.lit(None).cast("bigint").alias("start_seq"), F.lit("").alias("start_ref"), F.col("seq").alias("stop_seq"))
        )
        .withColumn("start_ref", F.coalesce("start_ref", F.lit("")))
    )


def events_for_subagent(events: DataFrame, windows: DataFrame, *, width: int = 4096) -> DataFrame:
    """Events of the window's own generation with start < seq <= stop."""
    spans = windows.where("start_seq is not null and generation <> ''").select(
        *SESSION, "generation", "child_id", "start_seq", "stop_seq"
    )
    return _inside(events, spans, [*SESSION, "generation"], width).where("seq > start_seq")


def unmatched_starts(events: DataFrame, windows: DataFrame) -> DataFrame:
    """First start of each child id that no window ever completed."""
    started = events.where((F.col("t") == "subagent_start") & (F.coalesce(F.col("child_id"), F.lit("")) != ""))
    paired = windows.where("start_seq is not null").select(*SESSION, "child_id").distinct()
    return (
        started.join(paired, [*SESSION, "child_id"], "left_anti")
        .groupBy(*SESSION, "child_id")
        .agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"), F.min_by("agent_ref", "seq").alias("agent_ref"))
    )


def task_for_child(starts: DataFrame, children: DataFrame, *, hour_bins: int = 1) -> DataFrame:
    """Task start of each child conversation: by resume id, else the last start not after it.

    The as-of side is a union of both tables and one ordered scan, so no child is compared
    with more than its own start.  Each task serves only the first child in order.
    """
    named = (
        children.join(
            starts.where("agent_ref <> ''").select(*SESSION, F.col("agent_ref").alias("child_session"), F.col("child_id").alias("task_id"), F.col("seq").alias("task_seq")),
            [*SESSION, "child_session"],
        )
        .groupBy(*SESSION, "child_session", "child_ts", "child_order")
        .agg(F.min_by("task_id", "task_seq").alias("task_id"))
    )
    micros = lambda c: F.expr(f"unix_micros(cast({c} as timestamp))")
    # Of starts at one time, the later in event order counts, which also makes the order unique.
    last = starts.where("ts IS NOT NULL").groupBy(*SESSION, (micros("ts") * 2).alias("at")).agg(F.max_by("child_id", "seq").alias("child_id"))
    left = last.select(*SESSION, "at", "child_id", F.lit(None).cast("string").alias("child_session"))
    free = children.join(named.select(*SESSION, "child_session"), [*SESSION, "child_session"], "left_anti").where("child_ts is not null")
    right = free.select(*SESSION, (micros("child_ts") * 2 + 1).alias("at"), F.lit(None).cast("string").alias("child_id"), "child_session")
    seen = scan(
        left.unionByName(right), SESSION, "at", befores={"task_id": F.col("child_id")},
        width=hour_bins * 7_200_000_000,
    ).where("child_session is not null and task_id is not null")
    asof = free.join(seen.select(*SESSION, "child_session", "task_id"), [*SESSION, "child_session"])
    both = named.select(*SESSION, "child_session", "child_order", "task_id").unionByName(
        asof.select(*SESSION, "child_session", "child_order", "task_id")
    )
    return both.groupBy(*SESSION, "task_id").agg(
        F.min_by("child_session", "child_order").alias("child_session"), F.count(F.lit(1)).alias("claims")
    )


def tool_mentions(calls: DataFrame) -> DataFrame:
    """(session, tool id) of every tool part in a call's output, with the call and its position."""
    return calls.select(*SESSION, "call_id", "pos", F.explode("tool_ids").alias("tool_use_id")).where("tool_use_id <> ''")


def attach_tools(mentions: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool pairs joined to the calls whose output names them."""
    return mentions.join(tools, [*SESSION, "tool_use_id"])


def requesting_call(mentions: DataFrame) -> DataFrame:
    """First call that mentions each tool id."""
    return mentions.groupBy(*SESSION, "tool_use_id").agg(F.min_by("call_id", "pos").alias("call_id"))


def orphan_tools(tools: DataFrame, attached: DataFrame, committed_tools: DataFrame, committed_mentions: DataFrame) -> DataFrame:
    """Tools neither attached nor committed, under the committed call that mentions them."""
    key = [*SESSION, "tool_use_id"]
    pending = tools.join(attached.select(*key), key, "left_anti").join(committed_tools.select(*key), key, "left_anti")
    return pending.join(requesting_call(committed_mentions), key)
