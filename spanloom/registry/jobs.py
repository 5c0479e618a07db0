"""Queries over composite plans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.times import parse_ts
from spanloom.operators import interactions, pairing, turns, usage
from spanloom.plans import context, copilot_turns, spans, trees
from spanloom.registry.core import _DAYS, _PROFILE, _SHAPE, TURN_SQL
from spanloom.registry.platforms import _AT, _CG, P, _attributed, _child_events, _cursor_events, _kit, _lone_starts, _LONE, _sql
from spanloom.sources import claude, copilot, star_frames
from spanloom.sources import star_views as V
from spanloom.streaming import jobs as stream

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


# --- interactions ----------------------------------------------------------------------


def _interactions(s, d):
    ev = V.events(s, d)
    shaped = ev.selectExpr(
        *P, "seq", "date_format(ts, 'yyyy-MM-dd') as ts",
        "case t when 'permission_request' then 'assistant_thought' else t end as t",
        "try_parse_json(to_json(named_struct('generation_id', concat('g', cast(v % 2 as string)), 'text', case when k % 4 <> 0 then concat('x', cast(k % 3 as string)) end,"
        " 'tool_use_id', case when t like 'tool%' then tool_use_id end, 'tool_name', tool_name, 'model', cast(v as string), 'command', case when k % 2 = 0 then command end, 'prompt', case when v % 3 = 0 then 'hi' end,"
        " 'output', case when k % 5 = 0 then 'done' end))) as data")
    return interactions.interactions(shaped)


_IX = """ix AS (SELECT platform, session_id, seq, strftime(ts, '%Y-%m-%d') AS ts, CASE t WHEN 'permission_request' THEN 'reasoning' ELSE t END AS kind, 'g' || CAST(v % 2 AS VARCHAR) AS generation,
    CASE WHEN t LIKE 'tool%' THEN tool_use_id ELSE '' END AS correlation, CASE WHEN k % 4 <> 0 THEN 'x' || CAST(k % 3 AS VARCHAR) END AS txt, tool_name, CASE WHEN k % 2 = 0 THEN command END AS cmd,
    CASE WHEN v % 3 = 0 THEN 'hi' END AS prompt, CASE WHEN k % 5 = 0 THEN 'done' END AS outp FROM ev)"""
_add("session_interactions", lambda s, d: interactions.dedup_reasoning(_interactions(s, d)).select(*P, "seq", "interaction_id", "kind", "duplicates"), _sql(
    f"""+{_IX}, g AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY platform, session_id, generation, ts, txt, tool_name, cmd, prompt, outp, kind) - 1 AS n FROM ix
    WINDOW w AS (PARTITION BY platform, session_id, generation, ts, txt, tool_name, cmd, prompt, outp, kind ORDER BY seq))
    SELECT platform, session_id, seq, generation || ':' || kind || ':' || CASE WHEN correlation = '' THEN '-' ELSE correlation END || ':' || CAST(seq AS VARCHAR) AS interaction_id, kind,
    CASE WHEN kind = 'reasoning' THEN n ELSE 0 END AS duplicates FROM g WHERE kind <> 'reasoning' OR rn = 1""", "ev"))
_add("dedup_reasoning", lambda s, d: interactions.duplicate_seqs(_interactions(s, d)), _sql(
    f"""+{_IX}, g AS (SELECT *, min(seq) OVER (PARTITION BY platform, session_id, generation, ts, txt, tool_name, cmd, prompt, outp) AS first_seq FROM ix WHERE kind = 'reasoning')
    SELECT platform, session_id, first_seq, seq AS copy_seq FROM g WHERE seq > first_seq""", "ev"))
_add("interaction_messages", lambda s, d: interactions.messages(_interactions(s, d)).select(*P, "seq", "role", "part", "content"), _sql(
    f"""+{_IX} SELECT platform, session_id, seq, CASE kind WHEN 'user_message' THEN 'user' WHEN 'tool_result' THEN 'tool' ELSE 'assistant' END AS role,
    CASE kind WHEN 'tool_call' THEN 'tool_call' WHEN 'tool_result' THEN 'tool_call_response' ELSE 'text' END AS part,
    CASE kind WHEN 'tool_call' THEN '"' || cmd || '"' WHEN 'tool_result' THEN '"' || outp || '"' WHEN 'user_message' THEN coalesce(prompt, txt) ELSE coalesce(txt, outp) END AS content
    FROM ix WHERE kind LIKE 'tool%' OR kind = 'user_message' AND coalesce(prompt, txt) IS NOT NULL OR kind IN ('assistant_message', 'reasoning') AND coalesce(txt, outp) IS NOT NULL""", "ev"))


def _stops(s, d):
    return V.events(s, d).selectExpr(
        *P, "seq", "case t when 'assistant_message' then 'turn_stop' else t end as t",
        "case when v % 7 = 0 then session_id when k % 5 > 0 then concat('g', cast(k % 5 as string)) end as generation")


_add("resolve_generation", lambda s, d: interactions.resolve_generation(_stops(s, d)), _sql(
    """+q AS (SELECT platform, session_id, seq, t, CASE WHEN v % 7 = 0 THEN session_id WHEN k % 5 > 0 THEN 'g' || CAST(k % 5 AS VARCHAR) END AS g FROM ev WHERE t IN ('user_message', 'assistant_message')),
    l AS (SELECT *, max(CASE WHEN t = 'user_message' AND g IS NOT NULL AND g <> session_id THEN seq END) OVER (PARTITION BY platform, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls,
    max(CASE WHEN t = 'user_message' THEN seq END) OVER (PARTITION BY platform, session_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS os FROM q)
    SELECT l.platform, l.session_id, l.seq, CASE WHEN l.g IS NOT NULL AND l.g <> l.session_id AND os IS NOT NULL THEN l.g ELSE coalesce(p.g, l.g) END AS generation,
    CASE WHEN l.g IS NOT NULL AND l.g <> l.session_id AND os IS NOT NULL THEN os ELSE ls END AS prompt_seq FROM l LEFT JOIN q p ON p.seq = l.ls AND p.platform = l.platform WHERE l.t = 'assistant_message'""", "ev"))
_add("nested_task_ids", lambda s, d: interactions.own_tools(
    V.events(s, d).where("t = 'tool_call'").selectExpr(*P, "seq", "concat('r', cast(k as string)) as call_ref"), _cursor_events(s, d)).select(*P, "seq", "call_ref"), _sql(
    """+n AS (SELECT DISTINCT platform, session_id, k FROM ev WHERE t = 'permission_request')
    SELECT platform, session_id, seq, 'r' || CAST(k AS VARCHAR) AS call_ref FROM ev ANTI JOIN n USING (platform, session_id, k) WHERE t = 'tool_call'""", "ev"))

# --- plans -----------------------------------------------------------------------------


def _chat_calls(s, d):
    chat = V.chat_events(s, d)
    return chat.where("t = 'assistant_message'").selectExpr(
        *P, "concat('c', cast(seq as string)) as call_id", "seq as pos", "seq as first_pos", "cast(length(text) as bigint) as input_tokens", "cast(1 as bigint) as output_tokens", "'m' as response_model",
        "cast(null as bigint) as cache_read_input_tokens", "cast(null as bigint) as cache_creation_input_tokens")


def _chat_sessions(s, d):
    return V.chat_events(s, d).groupBy(*P).agg(F.count(F.lit(1)).alias("event_count"))


_add("session_context", lambda s, d: context.session_context(
    _chat_sessions(s, d), V.chat_events(s, d), _chat_calls(s, d), F.concat_ws(" ", F.col("seq").cast("string"), "t")).select(
    *P, "event_count", "turns", "models", "total_tokens", "timeline"), _sql(
    """+c AS (SELECT platform, session_id, count(*) AS turns, CAST(sum(length(text) + 1) AS BIGINT) AS total_tokens FROM chat WHERE t = 'assistant_message' GROUP BY ALL),
    z AS (SELECT platform, session_id, count(*) AS event_count, string_agg(CAST(seq AS VARCHAR) || ' ' || t, chr(10) ORDER BY seq) AS timeline FROM chat GROUP BY ALL)
    SELECT platform, session_id, event_count, turns, CASE WHEN turns IS NOT NULL THEN 'm (' || CAST(turns AS VARCHAR) || ' turns)' END AS models, total_tokens, timeline FROM z LEFT JOIN c USING (platform, session_id)""", "chat"))


def _report(s, d):
    ev = V.events(s, d).withColumn("args", F.col("command"))
    calls = usage.dedup_calls(V.usage_raw(s, d)).withColumn("platform", F.expr("element_at(array('claude','codex','copilot','cursor'), cast(cast(session_id as bigint) % 4 + 1 as int))"))
    return trees.review_report(V.sessions(s, d), ev, calls, F.col("event_text"), more_than=60).select(
        *P, "event_count", "repeat_reads", "grep_via_bash", "chatty", "shape", "calls", "total_tokens", "median_tool_calls")


_add("review_report", _report, _sql(
    f"""+{_PROFILE}, f AS (SELECT platform, session_id, lower(substr(arg_min(event_text, seq), 1, 200)) AS x FROM ev WHERE t = 'user_message' GROUP BY ALL),
    uc AS (SELECT session_id, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM usage_calls GROUP BY session_id),
    r AS (SELECT s.platform, s.session_id, s.event_count, repeat_reads, bash_grep > 8 AS grep_via_bash, pr.tool_calls > pr.events * 0.75 AS chatty, coalesce({_SHAPE}, 'other') AS shape, uc.calls, uc.total_tokens, pr.tool_calls
    FROM sessions s JOIN pr USING (platform, session_id) LEFT JOIN f USING (platform, session_id) LEFT JOIN uc ON uc.session_id = s.session_id WHERE s.event_count > 60)
    SELECT * EXCLUDE (tool_calls), median(tool_calls) OVER (PARTITION BY shape) AS median_tool_calls FROM r""", "sessions", "usage_calls"))


def _span_tables(s, d):
    """Turns and calls of the order-based copilot data, usage rows as accounting."""
    calls, tools, _ = _kit(s, d)
    turn = calls.groupBy(*P, F.col("stored_turn_id").alias("turn_id")).agg(F.min("start_ts").alias("start_ts"), F.max("start_ts").alias("end_ts"), F.min("model").alias("model"))
    turn = turn.withColumns({"parent_turn_id": F.lit(None).cast("string"), "status": F.lit("completed")})
    call = calls.selectExpr(*P, "call_id", "stored_turn_id as turn_id", "model", "start_ts", "start_ts as end_ts", "cast(null as bigint) as input_tokens", "cast(null as bigint) as output_tokens")
    tool = tools.join(call.select(*P, "call_id", "turn_id", "start_ts", "end_ts"), [*P, "call_id"]).withColumn("name", F.lit("sh"))
    acc = _attributed(s, d).selectExpr(*P, "logical_call_id as accounting_id", "call_id", "case when status <> 'conflicting' then stored_turn_id end as turn_id", "status", "cast(1 as bigint) as input_tokens", "cast(2 as bigint) as output_tokens", "'2024-01-01' as ts")
    return turn, call, tool, acc


def _span_counts(s, d):
    turn, call, tool, acc = _span_tables(s, d)
    out = spans.flatten_spans(turn, call, tool, accounting=acc)
    links = out.select("platform", "session_id", F.col("span_id").alias("parent_span_id"), F.col("kind").alias("parent_kind"))
    joined = out.join(links, ["platform", "session_id", "parent_span_id"], "left")
    return joined.groupBy("kind", "parent_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.map_contains_key("attributes", "gen_ai.usage.input_tokens")).alias("priced"))


_add("flatten_spans", _span_counts, _sql(
    f"""+{_AT}, sp AS (SELECT 'session' AS kind, NULL AS parent_kind, count(DISTINCT session_id) AS n, 0 AS priced FROM kc UNION ALL SELECT 'turn', 'session', count(DISTINCT stored_turn_id), 0 FROM kc
    UNION ALL SELECT 'chat', 'turn', count(*), (SELECT count(*) FROM fn WHERE call_id IS NOT NULL) FROM kc UNION ALL SELECT 'tool', 'chat', count(*), 0 FROM kc WHERE has_tools
    UNION ALL SELECT 'accounting', CASE WHEN status <> 'conflicting' AND stored_turn_id IS NOT NULL THEN 'turn' ELSE 'session' END, count(*), count(*) FROM fn WHERE call_id IS NULL AND session_id IN (SELECT session_id FROM kc) GROUP BY 2)
    SELECT kind, parent_kind, n, CAST(priced AS BIGINT) AS priced FROM sp""", "att"))


def _placements(s, d):
    rows = V.table(s, d, "lineitem").selectExpr(
        "'copilot' as platform", "cast(l_orderkey as string) as session_id", "cast(l_linenumber as string) as accounting_id", "l_partkey * 100000 + cast(floor(l_extendedprice * 100) as bigint) % 100000 as at",
        "l_returnflag as destination", "cast(l_quantity as string) as digest", "l_linestatus = 'F' as delivered")
    ledger = rows.where("delivered or digest > '2'")
    now = usage.latest(rows, [*P, "accounting_id"], "at")
    return spans.placements(ledger, now).select("session_id", "accounting_id", "action", "destination")


_add("placement", _placements, """WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CAST(l_linenumber AS VARCHAR) AS accounting_id, l_partkey * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000 AS placed_at,
    l_returnflag AS destination, CAST(l_quantity AS VARCHAR) AS digest, l_linestatus = 'F' AS delivered FROM lineitem),
    w AS (SELECT session_id, accounting_id, destination AS wd, digest AS wg, delivered AS wv FROM r WHERE delivered OR digest > '2' QUALIFY row_number() OVER (PARTITION BY session_id, accounting_id ORDER BY placed_at) = 1),
    n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id, accounting_id ORDER BY placed_at DESC) = 1)
    SELECT session_id, accounting_id, CASE WHEN wd IS NULL THEN 'new' WHEN wg = digest AND wd = destination THEN 'same' WHEN wv THEN 'conflict' ELSE 'moved' END AS action,
    CASE WHEN wv THEN wd ELSE destination END AS destination FROM n LEFT JOIN w USING (session_id, accounting_id)""")


def _eligible(s, d):
    t = V.table(s, d, "orders").selectExpr("'copilot' as platform", "cast(o_custkey as string) as session_id", "cast(o_orderkey as string) as turn_id",
                                           "case o_orderstatus when 'F' then 'completed' when 'O' then 'open' else 'errored' end as status", "o_orderdate < timestamp'1998-01-01' as before")
    boundary = spans.history_boundary(t.where("before"))
    return spans.export_eligible(t, boundary).select("session_id", "turn_id", "status")


_add("export_eligible", _eligible, """SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(o_orderkey AS VARCHAR) AS turn_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'errored' END AS status
    FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'O')""")


def _copilot_events(s, d):
    """events as transcript records: views prompt, sign-ups answer, clicks and errors are tools, purchases end."""
    rec = V.events(s, d).selectExpr(
        "'copilot' as platform", "session_id", "seq as pos", "concat('e', cast(seq as string)) as source_id", "'transcript' as source_kind",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") as ts", "cast(null as string) as event",
        "try_parse_json(to_json(named_struct('type', case t when 'user_message' then 'user.message' when 'permission_request' then 'assistant.message' when 'tool_call' then 'tool.execution_start'"
        " when 'tool_result' then 'tool.execution_complete' else case v % 5 when 0 then 'abort' when 1 then 'request.error' else 'assistant.turn_end' end end,"
        " 'data', named_struct('interactionId', case when v % 11 <> 0 or t <> 'assistant_message' then concat('i', cast(k % 3 as string)) end, 'turnId', cast(v % 2 as string), 'content', tool_name, 'toolCallId', case when t like 'tool%' then cast(k as string) end,"
        " 'phase', case when k % 4 = 0 then 'final_answer' end, 'model', 'm', 'toolRequests', case when t = 'permission_request' and v % 3 = 0 then array(named_struct('toolCallId', cast(k as string), 'name', tool_name)) end)))) as payload")
    return copilot.normalize(rec)


_add("normalize_events", lambda s, d: _copilot_events(s, d).groupBy("kind", "role").agg(F.count(F.lit(1)).alias("n")), _sql(
    """+q AS (SELECT CASE t WHEN 'user_message' THEN 'user_prompt' WHEN 'permission_request' THEN 'assistant_message' WHEN 'tool_call' THEN 'tool_execution_start' WHEN 'tool_result' THEN 'tool_execution_complete'
    ELSE CASE v % 5 WHEN 0 THEN 'abort' WHEN 1 THEN 'error' ELSE 'assistant_turn_end' END END AS kind FROM ev UNION ALL SELECT 'tool_request' FROM ev WHERE t = 'permission_request' AND v % 3 = 0)
    SELECT kind, CASE kind WHEN 'user_prompt' THEN 'user_prompt' WHEN 'tool_request' THEN 'tool_request' WHEN 'assistant_message' THEN 'assistant_message' WHEN 'tool_execution_start' THEN 'tool_execution' WHEN 'tool_execution_complete' THEN 'tool_result' ELSE 'finish' END AS role, count(*) AS n FROM q GROUP BY ALL""", "ev"))
_add("copilot_turns", lambda s, d: copilot_turns.build(_copilot_events(s, d))["turns"].select(
    "session_id", "interaction_id", "turn_id", "start_ts", "end_ts", "input", "output", "status", "complete"))
_add("copilot_calls", lambda s, d: copilot_turns.build(_copilot_events(s, d))["calls"].select("session_id", "call_id", "stored_turn_id", "start_ts", "end_ts", "tools", "finish_kind"))
_add("copilot_pending", lambda s, d: copilot_turns.build(_copilot_events(s, d))["pending"].groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n")))
_add("completed_main_turns", lambda s, d: copilot_turns.main_turns(copilot_turns.build(_copilot_events(s, d))["turns"]).select("session_id", "turn_id", "start_ts", "status"))


def _hooks(s, d):
    rows = V.events(s, d).selectExpr(
        *P, "seq as pos", "'hook' as source_kind", "case t when 'tool_call' then 'sessionEnd' when 'user_message' then 'userPromptSubmitted' when 'tool_result' then 'sessionStart' else 'postToolUse' end as event",
        "try_parse_json(to_json(named_struct('agentId', case when v % 3 = 0 then 'a' end))) as payload", "'{}' as context")
    return copilot.lifecycle_status(rows)


_add("lifecycle_status", _hooks, _sql(
    """SELECT platform, session_id, CASE WHEN arg_max(t, seq) = 'tool_call' THEN 'closed' ELSE 'open' END AS status FROM ev WHERE t = 'tool_call' AND v % 3 <> 0 OR t IN ('user_message', 'tool_result') GROUP BY ALL""", "ev"))


def _claude_tree(s, d):
    ev = V.events(s, d)
    kids = _child_events(s, d).where("t in ('subagent_start', 'subagent_message') or tool_name = 'Task'")
    shaped = kids.withColumn("tool_use_id", F.concat(F.lit("u"), F.col("k").cast("string"))).select(*P, "seq", "ts", "t", "tool_name", "agent_id", "tool_use_id")
    plain = ev.where("t in ('tool_call', 'tool_result')").selectExpr(*P, "seq", "ts", "t", "tool_name", "cast(null as string) as agent_id", "concat('u', tool_use_id) as tool_use_id")
    events = plain.unionByName(shaped.where("t like 'subagent%'"))
    frames = star_frames.claude_frames(s, d)
    turn_rows = turns.turn_events(ev, marker_platforms=())
    return trees.claude_tree(events, frames, turn_rows)["tools"].select(*P, "tool_use_id", "call_seq", F.col("seq").alias("result_seq"), "call_id", "turn_no")


_add("claude_turn_tree", _claude_tree, _sql(
    "+" + TURN_SQL.format(src="ev").lstrip(", ") + f""", {_CG}, me AS (SELECT platform, session_id, 'u' || CAST(k AS VARCHAR) AS tool_use_id, arg_min(call_id, pos) AS call_id FROM gr WHERE is_call GROUP BY ALL),
    tp AS (SELECT platform, session_id, 'u' || tool_use_id AS tool_use_id, ps AS call_seq, seq AS result_seq FROM (SELECT *, lag(t) OVER w AS pt, lag(seq) OVER w AS ps FROM ev
    WHERE t IN ('tool_call', 'tool_result') WINDOW w AS (PARTITION BY platform, session_id, tool_use_id ORDER BY seq)) WHERE t = 'tool_result' AND pt = 'tool_call')
    SELECT tp.*, me.call_id, te.turn_no FROM tp LEFT JOIN me USING (platform, session_id, tool_use_id) LEFT JOIN te ON te.platform = tp.platform AND te.seq = tp.call_seq""", "ev", "cf"))
_add("background_children", lambda s, d: trees.background_children(
    _lone_starts(s, d), V.events(s, d).where("t = 'user_message'").selectExpr(*P, "concat('s', cast(seq as string)) as child_session", "ts as child_ts", "seq as child_order"),
    V.events(s, d).where("t = 'user_message' and seq % 2 = 1").selectExpr(*P, "concat('s', cast(seq as string)) as child_session"))[0].select(*P, "child_id", "child_session"), _sql(
    f"""+{_LONE}, kd AS (SELECT platform, session_id, 's' || CAST(seq AS VARCHAR) AS child_session, ts, seq FROM ev WHERE t = 'user_message' AND seq % 2 = 0),
    nm AS (SELECT kd.platform, kd.session_id, child_session, kd.seq, arg_min(child_id, ls.seq) AS task_id FROM kd JOIN ls ON ls.platform = kd.platform AND ls.session_id = kd.session_id AND ls.agent_ref = child_session GROUP BY ALL),
    af AS (SELECT kd.platform, kd.session_id, child_session, kd.seq, ls.child_id AS task_id FROM kd ASOF JOIN ls ON ls.platform = kd.platform AND ls.session_id = kd.session_id AND kd.ts >= ls.ts WHERE child_session NOT IN (SELECT child_session FROM nm)),
    al AS (SELECT * FROM nm UNION ALL SELECT * FROM af)
    SELECT platform, session_id, task_id AS child_id, arg_min(child_session, seq) AS child_session FROM al GROUP BY platform, session_id, task_id""", "ev"))

# --- streams ---------------------------------------------------------------------------


def _folders(s, name):
    base = stream.work_folder(s, name)
    return base, f"{base}-ckpt"


def _usage_stream(s, d):
    out, ckpt = _folders(s, "usage")
    rows = V.usage_raw(s, V.STREAM + d)
    stream.drain(stream.usage_stream(rows, out, ckpt))
    return usage.usage_rollup(stream.read_calls(s, out, rows.schema))


_add("usage_stream", _usage_stream, _sql(
    """SELECT platform, session_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM usage_calls GROUP BY platform, session_id""", "usage_calls"))


def _daily_stream(s, d):
    out, ckpt = _folders(s, "daily")
    stream.drain(stream.daily_stream(V.usage_raw(s, V.STREAM + d), out, f"{out}-days", ckpt))
    return stream.read_days(s, f"{out}-days").withColumn("day", F.col("day").cast("string"))


_add("daily_stream", _daily_stream, _sql("+" + _DAYS.format(
    where="", lo="(SELECT CAST(min(day) AS TIMESTAMP) FROM d)", hi="(SELECT CAST(max(day) AS TIMESTAMP) FROM d)").lstrip(", "), "usage_calls"))


def _tail_stream(s, d):
    out, ckpt = _folders(s, "tail")
    rows = stream.tail_stream(V.events(s, V.STREAM + d), after_seq=500).select(*P, "seq", "t")
    stream.drain(stream.to_folder(rows, out, ckpt))
    return s.read.parquet(out)


_add("tail_stream", _tail_stream, _sql("SELECT platform, session_id, seq, t FROM ev WHERE seq > 500", "ev"))


def _ingest(s, d):
    out, ckpt = _folders(s, "ingest")
    records = V.table(s, V.STREAM + d, "lineitem").selectExpr(
        "'copilot' as platform", "cast(l_orderkey as string) as session_id", "concat('s', cast(l_linenumber as string)) as source_id", "l_partkey * 100000 + cast(floor(l_extendedprice * 100) as bigint) % 100000 as pos",
        "case when l_suppkey % 3 = 0 then date_format(l_shipdate, 'yyyy-MM-dd') end as ts", "case when l_suppkey % 10 = 0 then 'never' else '2024-01-01' end as observed_at")
    stream.drain(stream.ingest(records, out, ckpt))
    return s.read.parquet(f"{out}/records").select("session_id", "source_id", "pos", "ts")


_add("ingest_dedup", _ingest, """SELECT CAST(l_orderkey AS VARCHAR) AS session_id, 's' || CAST(l_linenumber AS VARCHAR) AS source_id, l_partkey * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000 AS pos,
    CASE WHEN l_suppkey % 3 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '2024-01-01' END AS ts FROM lineitem WHERE l_suppkey % 10 <> 0
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) = 1""")


def _seq_stream(s, d):
    out, ckpt = _folders(s, "seq")
    stream.drain(stream.to_folder(stream.assign_seq(V.events(s, V.STREAM + d).withColumnRenamed("seq", "pos")), out, ckpt))
    return s.read.parquet(out)


_add("assign_seq_stream", _seq_stream, _sql(
    "SELECT platform, session_id, seq AS pos, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) - 1 AS n FROM ev", "ev"))


def _call_stream(s, d):
    out, ckpt = _folders(s, "calls")
    frames = claude.call_fields(star_frames.claude_frames(s, V.STREAM + d)).withColumn("ts", parse_ts(F.col("ts_text")))
    role = F.when((F.col("type") == "user") & F.col("has_message"), "user").when(claude.is_call(), "call")
    rows = frames.select(*P, "pos", role.alias("role"), "call_id", "ts", "input_tokens", "output_tokens")
    stream.drain(stream.to_folder(stream.incremental_calls(rows), out, ckpt))
    return s.read.parquet(out).select(*P, "pos", "call_id", "input_tokens", "output_tokens", "frames")


_add("incremental_calls", _call_stream, _sql(
    f"""+{_CG}, la AS (SELECT platform, session_id, max(group_no) AS g, max(CASE WHEN type = 'user' THEN pos END) AS up, max(CASE WHEN is_call THEN pos END) AS cp FROM gr GROUP BY ALL)
    SELECT ca.platform, ca.session_id, ca.pos, ca.call_id, input_tokens, output_tokens, frames FROM ca JOIN la USING (platform, session_id) WHERE group_no < g OR up > cp""", "cf"))


def _turn_stream(s, d):
    """Runs to the end of the data only; a live stream keeps going so that its timer can fire."""
    out, ckpt = _folders(s, "turns")
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = s.conf.get(idle, "true")
    s.conf.set(idle, "false")
    try:
        stream.drain(stream.to_folder(stream.open_turns(V.events(s, V.STREAM + d)), out, ckpt))
    finally:
        s.conf.set(idle, was)
    return s.read.parquet(out)


_add("open_turns", _turn_stream, _sql(
    """+n AS (SELECT *, lead(t) OVER w AS nt, lead(seq) OVER w AS ns FROM ev WHERE t IN ('user_message', 'assistant_message') WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq))
    SELECT platform, session_id, seq AS prompt_seq, ns AS end_seq, CASE nt WHEN 'user_message' THEN 'interrupted' ELSE 'completed' END AS status FROM n WHERE t = 'user_message' AND nt IS NOT NULL""", "ev"))


def _pairs_job(rows):
    return pairing.pair_tools_by_id(rows).select(*P, "tool_use_id", F.col("call.seq").alias("call_seq"), F.col("seq").alias("result_seq"))


_PAIRS = """SELECT platform, session_id, tool_use_id, ps AS call_seq, seq AS result_seq FROM (SELECT *, lag(t) OVER w AS pt, lag(seq) OVER w AS ps FROM ev
    WHERE t IN ('tool_call', 'tool_result') WINDOW w AS (PARTITION BY platform, session_id, tool_use_id ORDER BY seq)) WHERE t = 'tool_result' AND pt = 'tool_call'"""


def _late(s, d):
    out, ckpt = _folders(s, "late")
    rows = V.events(s, V.STREAM + d).select(*P, "seq", "t", "tool_use_id")
    stream.drain(stream.recompute_touched(rows, f"{out}-bronze", out, ckpt, _pairs_job))
    return stream.newest_version(s, out)


_add("late_corrections", _late, _sql(_PAIRS, "ev"))


def _live_tools(s, d):
    out, ckpt = _folders(s, "live")
    rows = V.events(s, V.STREAM + d).select(*P, "seq", "t", "tool_use_id")
    stream.drain(stream.emit_once(rows, f"{out}-bronze", out, ckpt, _pairs_job, [*P, "tool_use_id", "result_seq"]))
    return s.read.parquet(out).drop("batch")


_add("live_tool_spans", _live_tools, _sql(_PAIRS, "ev"))
