"""The given tables shaped as raw platform frames, so that ingest runs over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources import star_views as V

ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


#: The same moment, every third time with an offset.
OFFSET = f"case when k % 3 = 0 then date_format(ts + interval 2 hours 30 minutes, \"yyyy-MM-dd'T'HH:mm:ss.SSS'+02:30'\") else {ISO} end"


def claude_frames(spark: SparkSession, sf_dir: str, stamp: str = ISO) -> DataFrame:
    """events as transcript frames: views are prompts, sign-ups other frames, the rest answers."""
    return V.events(spark, sf_dir).selectExpr(
        "platform",
        "session_id",
        "seq as pos",
        "try_parse_json(to_json(named_struct("
        " 'type', case t when 'user_message' then 'user' when 'permission_request' then 'system' else 'assistant' end,"
        f" 'timestamp', case when k % 9 = 0 then 'bad' else {stamp} end,"
        " 'message', named_struct('id', concat('m', cast(v % 3 as string)), 'role', 'x',"
        "   'model', case when k % 10 = 0 then '<synthetic>' else concat('claude-', cast(v % 3 as string)) end,"
        "   'usage', named_struct('input_tokens', v, 'output_tokens', k,"
        "     'cache_read_input_tokens', case when k % 2 = 0 then v % 7 end),"
        "   'content', array(named_struct('type', case when t = 'user_message' then 'text' else 'tool_use' end,"
        "     'text', concat('p', cast(k as string)), 'id', concat('u', cast(k as string)), 'name', tool_name, 'input', named_struct('v', v))))))) as frame",
    )


def codex_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rollout frames: sign-ups open turns, purchases report tokens, clicks and errors are tools."""
    return V.spread(V.events(spark, sf_dir)).selectExpr(
        "platform",
        "session_id",
        "seq as pos",
        "try_parse_json(to_json(named_struct("
        " 'type', case t when 'permission_request' then 'turn_context' when 'user_message' then 'event_msg'"
        "   when 'assistant_message' then 'event_msg' else 'response_item' end,"
        f" 'timestamp', {ISO},"
        " 'payload', named_struct("
        "   'type', case t when 'user_message' then 'user_message' when 'assistant_message' then 'token_count'"
        "     when 'tool_call' then 'function_call' when 'tool_result' then 'function_call_output' end,"
        "   'turn_id', case when t = 'permission_request' then concat('t', cast(v % 4 as string)) end,"
        "   'model', case when t = 'permission_request' and k % 2 = 0 then concat('gpt-', cast(k % 3 as string)) end,"
        "   'message', case when t = 'user_message' then concat('p', cast(k as string)) end,"
        "   'call_id', case when t like 'tool%' then concat('c', cast(k as string)) end,"
        "   'name', case when t = 'tool_call' then tool_name end,"
        "   'output', case when t = 'tool_result' then concat('o', cast(k as string)) end,"
        "   'info', case when t = 'assistant_message' then named_struct("
        "     'last_token_usage', named_struct('input_tokens', v, 'output_tokens', k, 'total_tokens', v + k, 'cached_input_tokens', case when k % 2 = 0 then v % 7 end),"
        "     'total_token_usage', named_struct('total_tokens', seq - seq % 300)) end)))) as frame",
    )


def cursor_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).where("t = 'assistant_message'").selectExpr(
        "platform",
        "session_id",
        "seq",
        "ts",
        "try_parse_json(to_json(named_struct('generation_id', case when v % 2 = 0 then concat('g', cast(k % 2 as string)) end,"
        " 'generationId', case when v % 5 = 0 then 'g9' end, 'model', case when k % 7 = 0 then '' else 'gpt-5' end,"
        " 'input_tokens', case when k % 11 <> 0 then v end, 'outputTokens', cast(k as string), 'cache_read_tokens', '--'))) as payload",
    )


def copilot_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as model calls: 16 orders a session, 4 an interaction, the last of 4 by a child agent."""
    return V.table(spark, sf_dir, "orders").selectExpr(
        "'copilot' as platform",
        "cast(o_orderkey div 16 as string) as session_id",
        "o_orderkey as pos",
        "concat('c', cast(o_orderkey as string)) as call_id",
        "concat('turn', cast(o_orderkey div 4 as string)) as stored_turn_id",
        "concat('i', cast(o_orderkey div 4 as string)) as interaction_id",
        "case when o_orderkey % 4 = 3 then 'a1' end as agent_id",
        "case when o_orderkey % 4 = 3 then concat('t', cast(o_orderkey - 1 as string)) end as parent_tool_call_id",
        "cast(o_orderkey % 4 as string) as native_turn_id",
        "case o_orderstatus when 'P' then 'F' else o_orderstatus end as model",
        "date_format(o_orderdate, 'yyyy-MM-dd') as start_ts",
        "o_custkey % 3 <> 0 as has_finish",
        "o_custkey % 2 = 0 as asks_tool",
    )


def copilot_call_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copilot_calls(spark, sf_dir).where("asks_tool").selectExpr(
        "platform", "session_id", "call_id", "concat('t', substring(call_id, 2)) as tool_call_id"
    )


def copilot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as usage rows of those calls."""
    return V.table(spark, sf_dir, "lineitem").selectExpr(
        "'copilot' as platform",
        "cast(l_orderkey div 16 as string) as session_id",
        "(l_orderkey % 16) * 10000000000000000 + l_partkey * 100000 + cast(floor(l_extendedprice * 100) as bigint) % 100000 as pk",
        "l_orderkey",
        "l_linenumber",
        "cast((l_orderkey % 16) div 4 as bigint) as turn_index",
        "case when l_suppkey % 4 = 3 then 'a1' end as agent_id",
        "case when l_suppkey % 4 = 3 then concat('t', cast(l_orderkey - l_orderkey % 4 + 2 as string)) end as parent_tool_call_id",
        "l_linestatus as model",
        "case l_returnflag when 'A' then 'stop' when 'N' then 'tool_calls' end as finish_reason",
        "case l_linenumber % 3 when 1 then 'user' when 2 then 'agent' end as initiator",
    ).selectExpr("*", "concat('u', session_id, '-', cast(pk as string)) as logical_call_id", "concat('s', cast(pk as string)) as usage_source_id")


def copilot_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as usage table rows: an order is a session, a line a row id, repeats are revisions."""
    return V.table(spark, sf_dir, "lineitem").selectExpr(
        "'copilot' as platform",
        "cast(l_orderkey as string) as session_id",
        "l_partkey * 100000 + cast(floor(l_extendedprice * 100) as bigint) % 100000 as pos",
        "l_linenumber as pk",
        "case when l_suppkey % 9 = 0 and l_linenumber = 7 then 'g2' else 'g1' end as generation",
        "to_json(named_struct('agent_id', case when l_linenumber % 3 = 0 then concat('a', cast(l_linenumber as string)) end,"
        " 'cache_read_tokens', cast(floor(l_discount * 1000) as bigint), 'cache_write_tokens', 0, 'created_at', date_format(l_shipdate, 'yyyy-MM-dd'),"
        " 'id', l_linenumber, 'input_tokens', cast(floor(l_quantity) as bigint), 'model', case when l_suppkey % 10 <> 0 then l_linestatus end, 'output_tokens', l_suppkey,"
        " 'reasoning_tokens', 0, 'total_nano_aiu', cast(floor(l_extendedprice) as bigint))) as row_json",
    )


def copilot_shutdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as shutdown records that state the order's totals over two models and one agent."""
    block = (
        "named_struct('usage', named_struct('inputTokens', {i}, 'outputTokens', 0, 'cacheReadTokens', 0, 'cacheWriteTokens', 0,"
        " 'reasoningTokens', 0), 'totalNanoAiu', cast({n} as double))"
    )
    return V.table(spark, sf_dir, "orders").selectExpr(
        "'copilot' as platform",
        "cast(o_orderkey as string) as session_id",
        "concat('shut', cast(o_orderkey as string)) as source_id",
        "o_orderkey as pos",
        "try_parse_json(to_json(named_struct('type', 'session.shutdown', 'data', named_struct('modelMetrics', map("
        f" 'm1', {block.format(i='o_custkey', n='floor(o_totalprice)')}, 'm2', {block.format(i='case when o_orderkey % 10 = 0 then null else 5 end', n='1')}),"
        f" 'agentMetrics', map('main', named_struct('modelMetrics', map('m1', {block.format(i='o_custkey', n='1')}))))))) as payload",
    )


def copilot_records(spark: SparkSession, sf_dir: str, abort_at: int = 1) -> DataFrame:
    """orders as transcript records: each order is a model cycle of up to twelve records, aborts after cycle ``abort_at``.

    16 orders make a session, 4 an interaction, whose last is a child agent's.  What is
    asked, run, ended, aborted, nameless or of another version follows from the customer key.
    """
    orders = V.spread(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).selectExpr(
        "o_orderkey as k", "o_custkey as c", "o_orderkey div 16 as s", "concat('i', o_orderkey div 4) as i", "o_orderkey % 4 as m", "case o_orderstatus when 'P' then 'F' else o_orderstatus end as model"
    )
    child = "case when m = 3 then concat('a', k div 4) end"
    block = "named_struct('usage', named_struct('inputTokens', c % 50, 'outputTokens', 0, 'cacheReadTokens', 0, 'cacheWriteTokens', 0, 'reasoningTokens', 0), 'totalNanoAiu', cast(c as double))"

    def record(j: int, when: str, kind: str, agent: str, data: str, extra: str = "") -> str:
        return f"case when {when} then named_struct('j', {j}, 'doc', to_json(named_struct('type', '{kind}', 'agentId', {agent}, 'data', named_struct({data}){extra}))) end"

    asks = "case when c % 2 = 0 then array(named_struct('toolCallId', concat('t', k), 'name', 'bash')) end"
    records = [
        record(0, "m = 0", "user.message", "cast(null as string)", "'interactionId', i, 'content', concat('ask', k)"),
        record(1, "m = 3", "user.message", child, "'interactionId', i, 'content', concat('sub', k)"),
        record(
            2, "true", "assistant.message", child,
            "'interactionId', i, 'turnId', cast(m as string), 'content', case when c % 9 = 0 then '' else concat('say', k) end, 'model', model,"
            f" 'parentToolCallId', case when m = 3 then concat('t', k - 1) end, 'toolRequests', {asks},"
            " 'phase', case when (m = 2 and c % 8 <> 3) or (m = 3 and c % 6 <> 0) then 'final_answer' end",
        ),
        record(3, "c % 2 = 0 and c % 7 <> 0", "tool.execution_start", "cast(null as string)", "'toolCallId', concat('t', k), 'arguments', named_struct('cmd', concat('ls ', c), 'n', k)"),
        record(4, "c % 5 <> 0 and (c % 2 = 0 or c % 11 = 0)", "tool.execution_complete", "cast(null as string)", "'toolCallId', concat('t', k), 'result', concat('out ', c), 'success', true"),
        record(5, "c % 3 <> 0", "assistant.turn_end", child, "'interactionId', case when m = 3 and c % 4 = 1 then null else i end, 'turnId', cast(m as string)"),
        record(6, f"m = {abort_at} and c % 13 = 0", "abort", "cast(null as string)", f"'interactionId', i, 'turnId', '{abort_at}'"),
        record(7, "c % 17 = 0", "user.message", "cast(null as string)", "'content', 'lost'"),
        record(8, "c % 19 = 0", "assistant.message", "cast(null as string)", "'interactionId', i, 'content', 'other'", ", 'schema_version', '99'"),
        record(9, "c % 23 = 0", "model.title", "cast(null as string)", "'model', 'mini'"),
        record(10, "k % 16 = 15", "session.shutdown", "cast(null as string)", f"'modelMetrics', map('m1', {block})"),
        record(11, "k % 16 = 8 and c % 2 = 0", "session.usage_checkpoint", "cast(null as string)", "'n', 1"),
    ]
    struct = "array<struct<j:int,doc:string>>"
    return orders.selectExpr("k", "s", f"explode(filter(cast(array({', '.join(records)}) as {struct}), x -> x is not null)) as r").selectExpr(
        "'copilot' as platform", "cast(s as string) as session_id", "k * 16 + r.j as pos", "concat('r', k * 16 + r.j) as source_id", "'transcript' as source_kind",
        "date_format(timestamp_seconds(1704067200 + k % 16 * 16 + r.j), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as ts", "cast(null as string) as event", "try_parse_json(r.doc) as payload",
    )


def copilot_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as usage table rows of those sessions; a line number of an order is a row id, repeats are revisions."""
    lines = V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    return V.spread(lines).selectExpr(
        "'copilot' as platform", "cast(l_orderkey div 16 as string) as session_id", "l_partkey * 100000 + cast(floor(l_extendedprice * 100) as bigint) % 100000 as pos",
        "l_orderkey * 10 + l_linenumber as pk", "case when l_suppkey % 97 = 0 then 'g2' else 'g1' end as generation",
        "to_json(named_struct('turn_index', (l_orderkey % 16) div 4, 'agent_id', case when l_suppkey % 4 = 3 then concat('a', l_orderkey div 4) end,"
        " 'parent_tool_call_id', case when l_suppkey % 4 = 3 then concat('t', l_orderkey - l_orderkey % 4 + 2) end, 'model', case when l_suppkey % 31 = 0 then '' else l_linestatus end,"
        " 'finish_reason', case l_returnflag when 'A' then 'stop' when 'N' then 'tool_calls' end, 'initiator', case l_linenumber % 3 when 1 then 'user' when 2 then 'agent' end,"
        " 'provider', case when l_suppkey % 2 = 0 then 'openai' end, 'created_at', case when l_suppkey % 37 = 0 then 'bad' else date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end,"
        " 'input_tokens', cast(floor(l_quantity) as bigint), 'output_tokens', l_suppkey, 'cache_read_tokens', cast(floor(l_discount * 300) as bigint), 'total_nano_aiu', 1)) as row_json",
    )


SQL = {
    "cf": """SELECT platform, session_id, seq AS pos, ts, t, k, v, tool_name,
        CASE t WHEN 'user_message' THEN 'user' WHEN 'permission_request' THEN 'system' ELSE 'assistant' END AS type,
        CASE WHEN k % 9 = 0 THEN NULL ELSE ts END AS vts, 'm' || CAST(v % 3 AS VARCHAR) AS call_id,
        t IN ('tool_call', 'tool_result', 'assistant_message') AND k % 10 <> 0 AS is_call FROM ev""",
    "kc": """SELECT 'copilot' AS platform, CAST(o_orderkey // 16 AS VARCHAR) AS session_id, o_orderkey AS pos, 'c' || CAST(o_orderkey AS VARCHAR) AS call_id,
        'turn' || CAST(o_orderkey // 4 AS VARCHAR) AS stored_turn_id, 'i' || CAST(o_orderkey // 4 AS VARCHAR) AS interaction_id,
        CASE WHEN o_orderkey % 4 = 3 THEN 'a1' END AS agent_id, CASE WHEN o_orderkey % 4 = 3 THEN 't' || CAST(o_orderkey - 1 AS VARCHAR) END AS parent_tool_call_id,
        CAST(o_orderkey % 4 AS VARCHAR) AS native_turn_id, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS model,
        strftime(o_orderdate, '%Y-%m-%d') AS start_ts, o_custkey % 3 <> 0 AS has_finish, o_custkey % 2 = 0 AS has_tools FROM orders""",
    "kr": """SELECT c.*, CASE WHEN c.agent_id IS NULL THEN c.call_id WHEN p.has_tools THEN p.call_id END AS root_call FROM kc c
        LEFT JOIN kc p ON p.pos = c.pos - 1 AND c.agent_id IS NOT NULL""",
    "ku": """SELECT 'copilot' AS platform, CAST(l_orderkey // 16 AS VARCHAR) AS session_id,
        (l_orderkey % 16) * 10000000000000000 + l_partkey * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000 AS pk,
        (l_orderkey % 16) // 4 AS turn_index, CASE WHEN l_suppkey % 4 = 3 THEN 'a1' END AS agent_id,
        CASE WHEN l_suppkey % 4 = 3 THEN 't' || CAST(l_orderkey - l_orderkey % 4 + 2 AS VARCHAR) END AS parent_tool_call_id, l_linestatus AS model,
        CASE l_returnflag WHEN 'A' THEN 'stop' WHEN 'N' THEN 'tool_calls' END AS finish_reason,
        CASE l_linenumber % 3 WHEN 1 THEN 'user' WHEN 2 THEN 'agent' END AS initiator, l_orderkey, l_linenumber,
        'u' || CAST(l_orderkey // 16 AS VARCHAR) || '-' || CAST((l_orderkey % 16) * 10000000000000000 + l_partkey * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000 AS VARCHAR) AS logical_call_id
        FROM lineitem""",
    "io": """SELECT session_id, interaction, first_pos, stored_turn_id, row_number() OVER (PARTITION BY session_id ORDER BY first_pos) - 1 AS turn_index FROM (
        SELECT r.session_id, m.interaction_id AS interaction, min(r.pos) AS first_pos, any_value(m.stored_turn_id) AS stored_turn_id
        FROM kr r JOIN kr m ON m.call_id = r.root_call GROUP BY ALL)""",
    "om": """SELECT logical_call_id, call_id FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, ag, pa, model ORDER BY k ROWS UNBOUNDED PRECEDING) AS broken FROM (
        SELECT u.session_id, u.ag, u.pa, u.model, u.k, u.logical_call_id, c.call_id,
        CASE WHEN finish_reason IS NULL THEN true WHEN finish_reason = 'tool_calls' THEN has_tools ELSE NOT has_tools AND has_finish END AS ok
        FROM (SELECT *, coalesce(agent_id, '') AS ag, coalesce(parent_tool_call_id, '') AS pa, row_number() OVER (PARTITION BY session_id, agent_id, parent_tool_call_id, model ORDER BY pk, logical_call_id) AS k FROM ku) u
        JOIN (SELECT *, coalesce(agent_id, '') AS ag, coalesce(parent_tool_call_id, '') AS pa, row_number() OVER (PARTITION BY session_id, agent_id, parent_tool_call_id, model
            ORDER BY begun, lpad(native_turn_id, 20, '0'), call_id) AS k FROM (SELECT *, min(start_ts) OVER (PARTITION BY session_id, interaction_id) AS begun FROM kc)) c
        USING (session_id, ag, pa, model, k))) WHERE broken = 0""",
    "cy": """SELECT *, row_number() OVER (PARTITION BY session_id, interaction_id, agent_id, parent_tool_call_id ORDER BY start_ts, call_id) - 1 AS cycle FROM kr""",
    "po": """SELECT u.logical_call_id, count(*) AS possible, min(c.call_id) AS possible_call FROM ku u JOIN io ON io.session_id = u.session_id AND io.turn_index = u.turn_index
        JOIN (SELECT c.*, coalesce(m.interaction_id, c.interaction_id) AS ri FROM cy c LEFT JOIN kr m ON m.call_id = c.root_call) c ON c.session_id = u.session_id AND c.ri = io.interaction
        AND c.agent_id IS NOT DISTINCT FROM u.agent_id AND c.parent_tool_call_id IS NOT DISTINCT FROM u.parent_tool_call_id AND c.model = u.model
        WHERE CASE WHEN finish_reason IS NULL THEN true WHEN finish_reason = 'tool_calls' THEN has_tools ELSE NOT has_tools AND has_finish END
        AND CASE WHEN initiator IS NULL THEN true WHEN initiator = 'user' THEN cycle = 0 ELSE cycle > 0 AND c.agent_id IS NULL END GROUP BY 1""",
    "att": """SELECT u.session_id, u.logical_call_id, u.turn_index, u.agent_id AS usage_agent, om.call_id AS ordered_call,
        CASE WHEN om.call_id IS NULL AND possible = 1 THEN possible_call END AS guessed, possible, io.stored_turn_id AS index_turn,
        coalesce(om.call_id, CASE WHEN possible = 1 THEN possible_call END) AS chosen
        FROM ku u LEFT JOIN om USING (logical_call_id) LEFT JOIN po USING (logical_call_id) LEFT JOIN io ON io.session_id = u.session_id AND io.turn_index = u.turn_index""",
    "cr": """SELECT 'copilot' AS platform, CAST(l_orderkey AS VARCHAR) AS session_id, l_partkey * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000 AS pos,
        l_linenumber AS pk, CASE WHEN l_suppkey % 9 = 0 AND l_linenumber = 7 THEN 'g2' ELSE 'g1' END AS generation,
        CASE WHEN l_linenumber % 3 = 0 THEN 'a' || CAST(l_linenumber AS VARCHAR) END AS agent_id, CAST(floor(l_discount * 1000) AS BIGINT) AS cache_read_tokens,
        CAST(floor(l_quantity) AS BIGINT) AS input_tokens, CASE WHEN l_suppkey % 10 <> 0 THEN l_linestatus END AS model, l_suppkey AS output_tokens,
        CAST(floor(l_extendedprice) AS BIGINT) AS total_nano_aiu FROM lineitem""",
    "cu": """SELECT c.*, CASE WHEN r.session_id IS NOT NULL THEN 'usage_row_id_reuse' WHEN cache_read_tokens > input_tokens THEN 'usage_revision_conflict' END AS quarantine FROM (
        SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY session_id, generation, pk ORDER BY pos DESC) = 1) c
        LEFT JOIN (SELECT session_id, pk FROM cr GROUP BY ALL HAVING count(DISTINCT generation) > 1) r USING (session_id, pk)""",
    "pb": """SELECT *, o_orderkey AS k, o_custkey AS c, o_orderkey // 16 AS s, o_orderkey // 4 AS iv, o_orderkey % 4 AS m, o_custkey % 2 = 0 AS asks, o_custkey % 3 <> 0 AS ends,
        (o_orderkey % 4 = 2 AND o_custkey % 8 <> 3) OR (o_orderkey % 4 = 3 AND o_custkey % 6 <> 0) AS final, o_orderkey % 4 = 1 AND o_custkey % 13 = 0 AS aborts FROM orders""",
    "px": """SELECT iv, m = 3 AS child, any_value(s) AS s, min(k) AS k0, bool_or(final) AS final, bool_or(aborts) AS aborts, bool_or(final AND ends AND NOT asks) AS closes, bool_or(ends OR aborts) AS ended,
        max(CASE WHEN ends THEN k * 16 + 5 WHEN aborts THEN k * 16 + 6 END) AS end1, max(CASE WHEN aborts THEN k * 16 + 6 END) AS end2, arg_max(CASE WHEN c % 9 <> 0 THEN 'say' || k END, CASE WHEN c % 9 <> 0 THEN k END) AS said
        FROM pb GROUP BY ALL""",
    "pt": """SELECT px.*, shut, greatest(end1, coalesce(end2, end1)) AS last_end, closes OR aborts OR (final AND shut IS NOT NULL) AS complete, closes OR aborts AS early,
        CASE WHEN aborts AND NOT final THEN 'interrupted' ELSE 'completed' END AS status,
        'copilot:turn:key:' || px.s || ':i' || iv || CASE WHEN child THEN ':a' || iv ELSE '' END AS turn_id
        FROM px LEFT JOIN (SELECT s, k * 16 + 10 AS shut FROM pb WHERE k % 16 = 15) USING (s)""",
    "pl": """SELECT t.*, t.child AND t.complete AND NOT coalesce(o.asks AND p.complete, false) AS lost FROM pt t LEFT JOIN pt p ON t.child AND p.iv = t.iv AND NOT p.child LEFT JOIN pb o ON t.child AND o.k = t.k0 - 1""",
    "pc": """SELECT 'copilot' AS platform, CAST(pb.s AS VARCHAR) AS session_id, pb.k AS ordinal, pb.k * 16 + 2 AS pos, 'copilot:call:r' || (pb.k * 16 + 2) AS call_id, CASE WHEN NOT lost THEN turn_id END AS stored_turn_id,
        'i' || pb.iv AS interaction_id, CASE WHEN m = 3 THEN 'a' || pb.iv END AS agent_id, CASE WHEN m = 3 THEN 't' || (pb.k - 1) END AS parent_tool_call_id, CAST(m AS VARCHAR) AS native_turn_id,
        CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS model, strftime(TIMESTAMP '2024-01-01' + to_seconds(pb.k % 16 * 16 + 2), '%Y-%m-%dT%H:%M:%SZ') AS start_ts,
        ends OR pb.aborts AS has_finish, asks AS has_tools, CASE WHEN ends THEN 'assistant_turn_end' WHEN pb.aborts THEN 'abort' END AS finish_kind,
        strftime(TIMESTAMP '2024-01-01' + to_seconds(pb.k % 16 * 16 + CASE WHEN ends THEN 5 WHEN pb.aborts THEN 6 ELSE 2 END), '%Y-%m-%dT%H:%M:%SZ') AS end_ts
        FROM pb JOIN pl ON pl.iv = pb.iv AND pl.child = (m = 3)""",
    "pr": """SELECT c.*, CASE WHEN c.agent_id IS NULL THEN c.call_id WHEN p.has_tools THEN p.call_id END AS root_call FROM pc c LEFT JOIN pc p ON p.ordinal = c.ordinal - 1 AND c.agent_id IS NOT NULL""",
    "pv": """SELECT 'copilot' AS platform, CAST(l_orderkey // 16 AS VARCHAR) AS session_id, l_partkey * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000 AS pos, l_orderkey * 10 + l_linenumber AS pk,
        CASE WHEN l_suppkey % 97 = 0 THEN 'g2' ELSE 'g1' END AS generation, (l_orderkey % 16) // 4 AS turn_index, CASE WHEN l_suppkey % 4 = 3 THEN 'a' || (l_orderkey // 4) END AS agent_id,
        CASE WHEN l_suppkey % 4 = 3 THEN 't' || (l_orderkey - l_orderkey % 4 + 2) END AS parent_tool_call_id, CASE WHEN l_suppkey % 31 <> 0 THEN l_linestatus END AS model,
        CASE l_returnflag WHEN 'A' THEN 'stop' WHEN 'N' THEN 'tool_calls' END AS finish_reason, CASE l_linenumber % 3 WHEN 1 THEN 'user' WHEN 2 THEN 'agent' END AS initiator,
        CASE WHEN l_suppkey % 2 = 0 THEN 'openai' END AS provider, CASE WHEN l_suppkey % 37 <> 0 THEN l_shipdate END AS ts, CAST(floor(l_quantity) AS BIGINT) AS input_tokens, l_suppkey AS output_tokens,
        CAST(floor(l_discount * 300) AS BIGINT) AS cache_read_tokens FROM lineitem""",
    "pu": """SELECT c.*, 'copilot:usage:key:assistant_usage_events:' || generation || ':' || pk AS logical_call_id, CASE WHEN r.session_id IS NOT NULL THEN 'usage_row_id_reuse' WHEN cache_read_tokens > input_tokens THEN 'usage_revision_conflict' END AS quarantine
        FROM (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY session_id, generation, pk ORDER BY pos DESC) = 1) c
        LEFT JOIN (SELECT session_id, pk FROM pv GROUP BY ALL HAVING count(DISTINCT generation) > 1) r USING (session_id, pk)""",
}

#: The same matching rules over the sessions of ``copilot_records``.
RENAMED = {"kc": "pc", "kr": "pr", "ku": "pu", "io": "pio", "om": "pom", "cy": "pcy", "po": "ppo", "att": "patt"}
for _name in ("io", "om", "cy", "po", "att"):
    SQL[RENAMED[_name]] = re.sub(r"\b(" + "|".join(RENAMED) + r")\b", lambda m: RENAMED[m[0]], SQL[_name])
