"""Queries over platform frames, pairing, attribution and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import ids, payload
from spanloom.functions import text as X
from spanloom.operators import accounting, attribution, lineage, pairing
from spanloom.operators import usage as usage_ops
from spanloom.session import cut_lineage
from spanloom.sources import claude, codex, copilot, star_frames, tables
from spanloom.sources import star_views as V
from spanloom.sources.star_views import SQL as VIEW_SQL
from spanloom.sources.star_views import with_views

VIEW_SQL.update(star_frames.SQL)
NEEDS = {
    "cf": ["ev"], "kr": ["kc"], "io": ["kc", "kr"], "om": ["ku", "kc"], "cy": ["kc", "kr"], "po": ["ku", "kc", "kr", "io", "cy"],
    "att": ["ku", "kc", "kr", "io", "om", "cy", "po"], "cu": ["cr"],
}


def _sql(body, *names):
    wanted = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in wanted:
                wanted.append(m)
    return with_views(body, *wanted)


QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


P = ["platform", "session_id"]
TOKENS = ["input_tokens", "output_tokens", "cache_read_input_tokens"]

# --- claude ----------------------------------------------------------------------------
_add("claude_usage_rows", lambda s, d: claude.usage_rows(star_frames.claude_frames(s, d)).select(*P, "pos", "call_id", "response_model", *TOKENS), _sql(
    """SELECT platform, session_id, pos, call_id, 'claude-' || CAST(v % 3 AS VARCHAR) AS response_model, v + CASE WHEN k % 2 = 0 THEN v % 7 ELSE 0 END AS input_tokens, k AS output_tokens,
    CASE WHEN k % 2 = 0 THEN v % 7 END AS cache_read_input_tokens FROM cf WHERE is_call""", "cf"))
_CG = """mk AS (SELECT *, lag(type) OVER w AS pt, lag(call_id) OVER w AS pc FROM (SELECT *, max(CASE WHEN vts IS NOT NULL THEN pos END) OVER (PARTITION BY platform, session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ppos FROM cf)
    WHERE type = 'user' OR is_call WINDOW w AS (PARTITION BY platform, session_id ORDER BY pos)),
    gr AS (SELECT *, CAST(sum(CASE WHEN is_call AND (pt IS NULL OR pt = 'user' OR pc <> call_id) THEN 1 ELSE 0 END) OVER (PARTITION BY platform, session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM mk),
    ca AS (SELECT platform, session_id, group_no, min(pos) AS pos, count(*) AS frames, arg_min(call_id, pos) AS call_id, arg_min(ppos, pos) FILTER (WHERE true) AS ppos, arg_min(v + CASE WHEN k % 2 = 0 THEN v % 7 ELSE 0 END, pos) AS input_tokens,
    arg_min(k, pos) AS output_tokens, arg_max(pos, pos) FILTER (WHERE vts IS NOT NULL) AS lpos FROM gr WHERE is_call GROUP BY ALL)"""


def _claude_calls(s, d):
    return claude.calls(claude.grouped_frames(star_frames.claude_frames(s, d)))


_add("claude_calls", lambda s, d: _claude_calls(s, d).select(*P, "group_no", "pos", "frames", "call_id", "input_tokens", "output_tokens"), _sql(
    f"+{_CG} SELECT platform, session_id, group_no, pos, frames, call_id, input_tokens, output_tokens FROM ca", "cf"))


def _window_stats(s, d):
    """Per session, the number of calls whose window has no length and the latest end."""
    c = _claude_calls(s, d)
    return c.groupBy(*P).agg(F.count_if(F.col("start_ts") == F.col("end_ts")).alias("flat"), F.count("end_ts").alias("ended"))


_add("claude_call_windows", _window_stats, _sql(
    f"""+{_CG}, wn AS (SELECT ca.platform, ca.session_id, coalesce(date_trunc('millisecond', s.ts), date_trunc('millisecond', o.vts)) AS st, date_trunc('millisecond', e.ts) AS en FROM ca LEFT JOIN cf s ON s.platform = ca.platform AND s.pos = ca.ppos
    LEFT JOIN cf e ON e.pos = ca.lpos LEFT JOIN cf o ON o.pos = ca.pos)
    SELECT platform, session_id, count(*) FILTER (WHERE en IS NOT NULL AND (st IS NULL OR st >= en) OR en IS NULL AND st IS NOT NULL) AS flat, count(coalesce(en, st)) AS ended FROM wn GROUP BY ALL""", "cf"))


def _claude_parts(s, d):
    frames = star_frames.claude_frames(s, d)
    return claude.parts(frames, claude.grouped_frames(frames))


_add("message_parts", lambda s, d: _claude_parts(s, d).select(*P, "group_no", "side", "type", "id", F.col("name").alias("tool"), "content"), _sql(
    f"""+{_CG} SELECT platform, session_id, group_no + CASE WHEN type = 'user' THEN 1 ELSE 0 END AS group_no, CASE WHEN type = 'user' THEN 'input' ELSE 'output' END AS side,
    CASE WHEN type = 'user' THEN 'text' ELSE 'tool_call' END AS type, CASE WHEN type <> 'user' THEN 'u' || CAST(k AS VARCHAR) END AS id, CASE WHEN type <> 'user' THEN tool_name END AS tool,
    CASE WHEN type = 'user' THEN 'p' || CAST(k AS VARCHAR) ELSE '{{"v":' || CAST(v AS VARCHAR) || '}}' END AS content FROM gr""", "cf"))


def _mentions(s, d):
    return claude.tool_mentions(_claude_parts(s, d))


_MENT = f"{_CG}, me AS (SELECT platform, session_id, call_id, pos, 'u' || CAST(k AS VARCHAR) AS tool_use_id FROM gr WHERE is_call)"
_add("requesting_call", lambda s, d: pairing.requesting_call(_mentions(s, d)), _sql(
    f"+{_MENT} SELECT platform, session_id, tool_use_id, arg_min(call_id, pos) AS call_id FROM me GROUP BY ALL", "cf"))


def _tool_pairs(s, d):
    pairs = pairing.pair_tools_by_id(V.events(s, d))
    return pairs.select(*P, F.concat(F.lit("u"), "tool_use_id").alias("tool_use_id"), F.col("call.seq").alias("call_seq"), F.col("seq").alias("result_seq"))


_PAIR = """tp AS (SELECT platform, session_id, 'u' || tool_use_id AS tool_use_id, ps AS call_seq, seq AS result_seq FROM (SELECT *, lag(t) OVER w AS pt, lag(seq) OVER w AS ps FROM ev
    WHERE t IN ('tool_call', 'tool_result') WINDOW w AS (PARTITION BY platform, session_id, tool_use_id ORDER BY seq)) WHERE t = 'tool_result' AND pt = 'tool_call')"""
_add("attach_tools_to_calls", lambda s, d: pairing.attach_tools(_mentions(s, d).select(*P, "call_id", "tool_use_id").distinct(), _tool_pairs(s, d)).select(
    *P, "call_id", "tool_use_id", "call_seq", "result_seq"), _sql(
    f"+{_MENT}, {_PAIR} SELECT DISTINCT platform, session_id, me.call_id, tool_use_id, call_seq, result_seq FROM me JOIN tp USING (platform, session_id, tool_use_id)", "cf"))


def _orphans(s, d):
    m = _mentions(s, d)
    tools = _tool_pairs(s, d)
    return pairing.orphan_tools(tools, m.where("call_id = 'm0'"), tools.where("call_seq % 5 = 0"), m.where("call_id <> 'm0'")).select(
        *P, "tool_use_id", "call_id", "call_seq", "result_seq")


_add("orphan_tools", _orphans, _sql(
    f"""+{_MENT}, {_PAIR}, fi AS (SELECT platform, session_id, tool_use_id, arg_min(call_id, pos) AS call_id FROM me WHERE call_id <> 'm0' GROUP BY ALL)
    SELECT platform, session_id, tool_use_id, call_id, call_seq, result_seq FROM tp ANTI JOIN (SELECT DISTINCT platform, session_id, tool_use_id FROM me WHERE call_id = 'm0') a USING (platform, session_id, tool_use_id)
    JOIN fi USING (platform, session_id, tool_use_id) WHERE (platform, session_id, tool_use_id) NOT IN (SELECT (platform, session_id, tool_use_id) FROM tp WHERE call_seq % 5 = 0)""".replace(
        "(platform, session_id, tool_use_id) NOT IN (SELECT (platform, session_id, tool_use_id) FROM", "platform || session_id || tool_use_id NOT IN (SELECT platform || session_id || tool_use_id FROM"), "cf"))

# --- codex -----------------------------------------------------------------------------
_add("codex_events", lambda s, d: codex.events(star_frames.codex_frames(s, d)).select(*P, "pos", "t"), _sql(
    """SELECT platform, session_id, seq AS pos, CASE t WHEN 'permission_request' THEN 'notification' WHEN 'user_message' THEN 'user_message' ELSE t END AS t FROM ev WHERE t <> 'assistant_message'""", "ev"))
_add("codex_usage_rows", lambda s, d: codex.usage_rows(star_frames.codex_frames(s, d)).select(*P, "pos", "call_id", "response_model", *TOKENS), _sql(
    """+w AS (SELECT *, last_value(CASE WHEN t = 'permission_request' AND k % 2 = 0 THEN 'gpt-' || CAST(k % 3 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM ev)
    SELECT platform, session_id, seq AS pos, 'cum:' || CAST(seq - seq % 300 AS VARCHAR) AS call_id, coalesce(m, 'unknown') AS response_model, v AS input_tokens, k AS output_tokens,
    CASE WHEN k % 2 = 0 THEN v % 7 END AS cache_read_input_tokens FROM w WHERE t = 'assistant_message'""", "ev"))
_CT = """tf AS (SELECT *, last_value(CASE WHEN t = 'permission_request' THEN 't' || CAST(v % 4 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS turn_id FROM ev QUALIFY turn_id IS NOT NULL),
    nw AS (SELECT *, t = 'assistant_message' AND seq = min(seq) OVER (PARTITION BY platform, session_id, turn_id, t, seq - seq % 300) AS is_new,
    count(*) FILTER (WHERE t = 'tool_call') OVER (PARTITION BY platform, session_id, turn_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS outs FROM tf),
    cl AS (SELECT *, is_new AND outs > coalesce(max(CASE WHEN is_new THEN outs END) OVER (PARTITION BY platform, session_id, turn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closes FROM nw),
    cn AS (SELECT *, CAST(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY platform, session_id, turn_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) - CASE WHEN closes THEN 1 ELSE 0 END AS call_no FROM cl)"""


def _codex_rows(s, d):
    return codex.call_frames(codex.normal_messages(codex.turn_frames(star_frames.codex_frames(s, d))))


_add("select_turn_frames", lambda s, d: codex.turn_frames(star_frames.codex_frames(s, d)).select(*P, "pos", "turn_id"), _sql(
    f"+{_CT} SELECT platform, session_id, seq AS pos, turn_id FROM tf", "ev"))
_add("codex_calls", lambda s, d: codex.calls(_codex_rows(s, d)).select(*P, "turn_id", "call_no", "outputs", "input_tokens", "output_tokens"), _sql(
    f"""+{_CT} SELECT platform, session_id, turn_id, call_no, count(*) FILTER (WHERE t = 'tool_call') AS outputs, max(CASE WHEN closes THEN v END) AS input_tokens, max(CASE WHEN closes THEN k END) AS output_tokens
    FROM cn GROUP BY ALL HAVING count(*) FILTER (WHERE t = 'tool_call') > 0""", "ev"))
_add("codex_turns", lambda s, d: codex.turns(codex.normal_messages(codex.turn_frames(star_frames.codex_frames(s, d)))).select(
    *P, "turn_id", "user_prompt", "status", "model"), _sql(
    f"""+{_CT} SELECT platform, session_id, turn_id, coalesce(arg_max('p' || CAST(k AS VARCHAR), seq) FILTER (WHERE t = 'user_message'), '') AS user_prompt, 'completed' AS status,
    arg_max('gpt-' || CAST(k % 3 AS VARCHAR), seq) FILTER (WHERE t = 'permission_request' AND k % 2 = 0) AS model FROM tf GROUP BY ALL""", "ev"))
_add("codex_tool_spans", lambda s, d: codex.tool_spans(_codex_rows(s, d)).select(*P, "turn_id", "pos", "tool_use_id", F.col("name").alias("tool"), "result"), _sql(
    f"""+{_CT}, an AS (SELECT platform, session_id, turn_id, k, 'o' || CAST(k AS VARCHAR) AS result FROM tf WHERE t = 'tool_result' GROUP BY ALL)
    SELECT platform, session_id, turn_id, seq AS pos, 'c' || CAST(k AS VARCHAR) AS tool_use_id, tool_name AS tool, coalesce(result, '') AS result FROM tf LEFT JOIN an USING (platform, session_id, turn_id, k) WHERE t = 'tool_call'""", "ev"))


def _copies(s, d):
    """Chat turns as messages, each user text once more as a completed item; some items repeat their id."""
    chat = V.table(s, d, "conversations").selectExpr(
        "'codex' as platform", "concat('c', cast(conv_id div 4 as string)) as session_id", "(conv_id * 100 + turn) * 4 as pos", "role", "turn", "conv_id", "text as word"
    )
    item = "named_struct('type', case role when 'user' then 'UserMessage' else 'AgentMessage' end, 'id', {i}, 'phase', 'p', 'content', array(named_struct('text', word)))"
    turn = "try_parse_json(to_json(named_struct('type', 'turn_context', 'payload', named_struct('turn_id', cast(conv_id div 4 as string))))) as frame"
    own = "try_parse_json(to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'message', 'role', role, 'phase', 'p', 'content', array(named_struct('text', word)))))) as frame"
    copy = "try_parse_json(to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'item_completed', 'item', " + item + ")))) as frame"
    head = chat.where("conv_id % 4 = 0 and turn = 0").selectExpr("platform", "session_id", "pos - 1 as pos", turn)
    mains = chat.where("role <> 'system' and turn % 3 <> 2").selectExpr("platform", "session_id", "pos", own)
    twins = chat.where("role <> 'system'").selectExpr("platform", "session_id", "pos + 1 as pos", copy.format(i="concat('i', cast(turn as string))"))
    more = chat.where("role = 'user'").selectExpr("platform", "session_id", "pos + 2 as pos", copy.format(i="cast(null as string)"))
    frames = head.unionByName(mains).unionByName(twins).unionByName(more)
    return codex.normal_messages(codex.turn_frames(frames)).where("is_message or is_copy").select(*P, "pos", "role", F.col("text").alias("word"))


_add("dedup_messages", _copies, """WITH c AS (SELECT 'codex' AS platform, 'c' || CAST(conv_id // 4 AS VARCHAR) AS session_id, (conv_id * 100 + turn) * 4 AS pos, role, turn, text AS word FROM conversations WHERE role <> 'system'),
    own AS (SELECT platform, session_id, pos, role, word FROM c WHERE turn % 3 <> 2),
    cp AS (SELECT platform, session_id, pos + 1 AS pos, role, word FROM c QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY pos) = 1
        UNION ALL SELECT platform, session_id, pos + 2, role, word FROM c WHERE role = 'user'),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id, role, word ORDER BY pos) AS nth FROM cp),
    r AS (SELECT session_id, role, word, count(*) AS m FROM own GROUP BY ALL)
    SELECT platform, session_id, pos, role, word FROM own UNION ALL SELECT platform, n.session_id, pos, n.role, n.word FROM n LEFT JOIN r USING (session_id, role, word) WHERE nth > coalesce(m, 0)""")

# --- cursor ----------------------------------------------------------------------------
_add("cursor_usage_rows", lambda s, d: tables.cursor_usage_rows(star_frames.cursor_stops(s, d)).select(*P, "seq", "call_id", "provider_name", "input_tokens", "output_tokens"), _sql(
    """+q AS (SELECT *, coalesce(CASE WHEN v % 2 = 0 THEN 'g' || CAST(k % 2 AS VARCHAR) END, CASE WHEN v % 5 = 0 THEN 'g9' END) AS g FROM ev WHERE t = 'assistant_message'),
    l AS (SELECT *, lag(g) OVER (PARTITION BY platform, session_id ORDER BY seq) AS pg FROM q WHERE g IS NOT NULL AND k % 7 <> 0 AND k % 11 <> 0)
    SELECT platform, session_id, seq, g AS call_id, 'openai' AS provider_name, v AS input_tokens, k AS output_tokens FROM l WHERE pg IS NULL OR pg <> g""", "ev"))


def _messages(s, d):
    return V.chat_events(s, d).where("t <> 'notification'").selectExpr(
        *P, "seq as pos", "case t when 'user_message' then 'user' else 'assistant' end as role", "text")


_add("transcript_summary", lambda s, d: tables.transcript_summary(_messages(s, d)), _sql(
    """SELECT platform, session_id, coalesce(arg_min(text, seq) FILTER (WHERE t = 'user_message'), '') AS input_text, coalesce(arg_max(text, seq) FILTER (WHERE t = 'assistant_message'), '') AS output_text
    FROM chat WHERE t <> 'notification' GROUP BY ALL""", "chat"))
_add("latest_transcript_turn", lambda s, d: tables.latest_transcript_turn(_messages(s, d)), _sql(
    """+u AS (SELECT platform, session_id, max(seq) AS us, arg_max(text, seq) AS input_text, count(*) AS user_messages FROM chat WHERE t = 'user_message' GROUP BY ALL),
    a AS (SELECT platform, session_id, max(seq) AS rs, arg_max(text, seq) AS reply FROM chat WHERE t = 'assistant_message' GROUP BY ALL)
    SELECT platform, session_id, input_text, coalesce(CASE WHEN rs > us THEN reply END, '') AS output_text, user_messages FROM u LEFT JOIN a USING (platform, session_id)""", "chat"))

# --- pairing ---------------------------------------------------------------------------


def _sided(s, d, ref="tool_use_id"):
    return V.events(s, d).selectExpr(
        *P, "seq", "t", f"concat('g', cast(v % 3 as string)) as generation", "tool_name as family", "tool_name as name", f"{ref} as call_ref", "command as signature", "k % 13 = 0 as instant")


_add("pair_tools_two_sided", lambda s, d: pairing.pair_two_sided(_sided(s, d)), _sql(
    """+q AS (SELECT *, 'g' || CAST(v % 3 AS VARCHAR) AS generation FROM ev WHERE t IN ('tool_call', 'tool_result')),
    n AS (SELECT *, row_number() OVER (PARTITION BY platform, session_id, generation, k, t ORDER BY seq) AS rn FROM q WHERE k % 13 <> 0),
    p AS (SELECT platform, session_id, generation, c.seq AS call_seq, r.seq AS result_seq FROM (SELECT * FROM n WHERE t = 'tool_call') c FULL JOIN (SELECT * FROM n WHERE t = 'tool_result') r USING (platform, session_id, generation, k, rn))
    SELECT *, CASE WHEN call_seq IS NULL THEN 'result' WHEN result_seq IS NULL THEN 'call' END AS unmatched FROM p
    UNION ALL SELECT platform, session_id, generation, seq, seq, NULL FROM q WHERE k % 13 = 0""", "ev"))
_add("pair_tools_positional", lambda s, d: pairing.pair_two_sided(_sided(s, d, "case when k % 4 = 0 then tool_use_id end").withColumn(
    "signature", F.when(F.col("seq") % 3 == 0, F.col("signature")))))
_add("pair_tools_with_fallback", lambda s, d: pairing.pair_tools_with_fallback(V.events(s, d).withColumn(
    "tool_use_id", F.when(F.col("v") % 3 != 0, (F.col("k") % 12).cast("string")))))
_SUB = "case t when 'permission_request' then 'subagent_start' when 'tool_result' then 'subagent_message' else t end as t"


def _child_events(s, d):
    return V.events(s, d).selectExpr(
        *P, "seq", "ts", _SUB, "case when k % 2 = 0 then 'Task' else tool_name end as tool_name",
        "case when t in ('permission_request', 'tool_result') and k % 6 <> 0 then cast(k % 6 as string) end as agent_id", "k", "v")


_WIN = """rw AS (SELECT *, CASE WHEN t = 'tool_call' AND k % 2 = 0 THEN 1 WHEN t = 'permission_request' AND k % 6 <> 0 THEN -1 ELSE 0 END AS st FROM ev
    WHERE t = 'tool_call' AND k % 2 = 0 OR t IN ('permission_request', 'tool_result') AND k % 6 <> 0),
    bs AS (SELECT *, sum(st) OVER w AS b, count(*) FILTER (WHERE st = 1) OVER w AS no, count(*) FILTER (WHERE st = -1) OVER w AS ns FROM rw WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    us AS (SELECT *, greatest(0, -min(b) OVER w) AS u FROM bs WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    uz AS (SELECT *, u > coalesce(lag(u) OVER (PARTITION BY platform, session_id ORDER BY seq), 0) AS lost FROM us),
    lf AS (SELECT s.platform, s.session_id, CAST(s.k % 6 AS VARCHAR) AS agent_id, s.seq, s.t, k.seq AS task_seq FROM (SELECT * FROM uz WHERE st <> 1) s
        LEFT JOIN (SELECT platform, session_id, seq, no FROM uz WHERE st = 1) k ON s.t = 'permission_request' AND NOT s.lost AND k.platform = s.platform AND k.session_id = s.session_id AND k.no = s.ns - s.u),
    pv AS (SELECT *, lag(t) OVER w AS pt, lag(seq) OVER w AS ps FROM lf WINDOW w AS (PARTITION BY platform, session_id, agent_id ORDER BY seq)),
    en AS (SELECT *, t = 'tool_result' AND pt = 'permission_request' AS ends FROM pv),
    wg AS (SELECT *, count(*) FILTER (WHERE ends) OVER (PARTITION BY platform, session_id, agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN ends THEN 1 ELSE 0 END AS wno FROM en),
    wi AS (SELECT platform, session_id, agent_id, max(CASE WHEN ends THEN ps END) AS start_seq, max(CASE WHEN ends THEN seq END) AS stop_seq, max(task_seq) AS task_seq FROM wg GROUP BY platform, session_id, agent_id, wno HAVING max(CASE WHEN ends THEN seq END) IS NOT NULL)"""
_add("subagent_windows", lambda s, d: pairing.subagent_windows(_child_events(s, d)), _sql(f"+{_WIN} SELECT * FROM wi", "ev"))


def _owned(s, d):
    windows = pairing.subagent_windows(_child_events(s, d))
    tools = V.events(s, d).where("t in ('tool_call', 'user_message')").selectExpr(*P, "seq", "case when v % 10 = 0 then cast(k % 9 as string) end as agent_id")
    return pairing.owning_agent(tools, windows)


_add("owning_agent", _owned, _sql(
    f"""+{_WIN}, tl AS (SELECT platform, session_id, seq, CASE WHEN v % 10 = 0 THEN CAST(k % 9 AS VARCHAR) END AS a FROM ev WHERE t IN ('tool_call', 'user_message')),
    kn AS (SELECT DISTINCT platform, session_id, agent_id FROM wi),
    ow AS (SELECT tl.platform, tl.session_id, tl.seq, arg_min(agent_id, (stop_seq - start_seq) * 1000000000 + start_seq) AS owner FROM tl JOIN wi ON wi.platform = tl.platform AND wi.session_id = tl.session_id AND tl.seq BETWEEN start_seq AND stop_seq WHERE a IS NULL GROUP BY ALL)
    SELECT tl.platform, tl.session_id, tl.seq, CASE WHEN a IS NOT NULL THEN kn.agent_id ELSE owner END AS owner FROM tl LEFT JOIN kn ON kn.platform = tl.platform AND kn.session_id = tl.session_id AND kn.agent_id = tl.a
    LEFT JOIN ow ON ow.platform = tl.platform AND ow.seq = tl.seq""", "ev"))


def _asks(s, d):
    ev = V.events(s, d)
    asks = ev.where("t = 'tool_call'").withColumn("t", F.lit("permission_request")).select(*P, "seq", "ts", "t")
    marks = ev.where("t = 'permission_request'").selectExpr(*P, "seq", "ts - interval 6 hours as start_ts", "ts as end_ts")
    return pairing.permissions_in_turn(asks, marks).select(*P, "seq", "turn_seq")


_add("permissions_in_turn", _asks, _sql(
    """+n AS (SELECT *, first_value(CASE WHEN t = 'permission_request' THEN seq END IGNORE NULLS) OVER w AS ms, first_value(CASE WHEN t = 'permission_request' THEN ts END IGNORE NULLS) OVER w AS mt
    FROM ev WHERE t IN ('permission_request', 'tool_call') WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT platform, session_id, seq, ms AS turn_seq FROM n WHERE t = 'tool_call' AND ts BETWEEN mt - INTERVAL 6 HOUR AND mt""", "ev"))


def _overlaps(s, d):
    ev = V.events(s, d)
    windows = ev.where("t = 'tool_call'").selectExpr(*P, "session_id as child_id", "ts as start_ts", "ts + interval 5 hours as end_ts")
    kids = ev.where("t = 'user_message'").selectExpr(
        "platform", "session_id as child_id", "ts as start_ts", "ts + interval 90 minutes as end_ts", "event_text as prompt", "event_text as output", "'completed' as status", "v as calls")
    return pairing.child_turns_overlapping(windows, kids).select(*P, F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_ts"), "children", "prompt", "output", "calls")


_add("child_turns_overlapping", _overlaps, _sql(
    """SELECT w.platform, w.session_id, strftime(w.ts, '%Y-%m-%d %H:%M:%S.%f') AS start_ts, count(*) AS children, arg_min(c.event_text, c.ts) AS prompt, arg_max(c.event_text, c.ts) AS output, CAST(sum(c.v) AS BIGINT) AS calls
    FROM ev w JOIN ev c ON c.session_id = w.session_id AND c.t = 'user_message' AND c.ts <= w.ts + INTERVAL 5 HOUR AND c.ts + INTERVAL 90 MINUTE >= w.ts WHERE w.t = 'tool_call' GROUP BY w.platform, w.session_id, w.ts""", "ev"))


def _codex_children(s, d):
    return V.events(s, d).selectExpr(*P, "seq", "case t when 'tool_call' then 'subagent_start' when 'tool_result' then 'subagent_message' end as t",
                                     "case when k % 3 <> 0 then cast(k % 3 as string) end as agent_id").where("t is not null")


_add("pair_subagents_codex", lambda s, d: pairing.pair_subagents(_codex_children(s, d)), _sql(
    """+q AS (SELECT platform, session_id, seq, CASE t WHEN 'tool_call' THEN 1 ELSE -1 END AS st, CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS VARCHAR) END AS agent_id FROM ev WHERE t IN ('tool_call', 'tool_result')),
    b AS (SELECT *, sum(st) OVER w AS b, count(*) FILTER (WHERE st = 1) OVER w AS no, count(*) FILTER (WHERE st = -1) OVER w AS ns FROM q WINDOW w AS (PARTITION BY platform, session_id, agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    u AS (SELECT *, greatest(0, -min(b) OVER (PARTITION BY platform, session_id, agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS u FROM b),
    z AS (SELECT *, st = -1 AND u > coalesce(lag(u) OVER (PARTITION BY platform, session_id, agent_id ORDER BY seq), 0) AS lost FROM u),
    d AS (SELECT *, CASE WHEN st = 1 THEN b + u WHEN NOT lost THEN b + u + 1 END AS lv FROM z WHERE agent_id IS NULL),
    s AS (SELECT *, max(CASE WHEN st = 1 THEN seq END) OVER (PARTITION BY platform, session_id, lv ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM d)
    SELECT o.platform, o.session_id, o.agent_id, o.seq AS start_seq, c.seq AS stop_seq FROM (SELECT * FROM z WHERE agent_id IS NOT NULL AND st = 1) o JOIN (SELECT * FROM z WHERE agent_id IS NOT NULL AND st = -1 AND NOT lost) c
    ON c.platform = o.platform AND c.session_id = o.session_id AND c.agent_id = o.agent_id AND o.no = c.ns - c.u
    UNION ALL SELECT platform, session_id, NULL, ps, seq FROM s WHERE st = -1 AND NOT lost""", "ev"))


def _cursor_events(s, d, resumes=False):
    return V.events(s, d).selectExpr(
        *P, "seq", "ts", _SUB.replace("'tool_result'", "'tool_result'"), "concat('x', cast(k % 6 as string)) as child_id", "concat('r', cast(k as string)) as call_ref",
        f"{'k % 2 = 0' if resumes else 'false'} as resume", "concat('g', cast(v % 4 as string)) as generation", "case when v % 5 = 0 then concat('s', cast(k as string)) else '' end as agent_ref")


_LIFE = """lq AS (SELECT platform, session_id, seq, ts, v, k, 'x' || CAST(k % 6 AS VARCHAR) AS child_id, CASE t WHEN 'permission_request' THEN 1 ELSE -1 END AS st FROM ev WHERE t IN ('permission_request', 'tool_result')),
    lb AS (SELECT *, sum(st) OVER w AS b, count(*) FILTER (WHERE st = 1) OVER w AS no, count(*) FILTER (WHERE st = -1) OVER w AS ns FROM lq WINDOW w AS (PARTITION BY platform, session_id, child_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    lu AS (SELECT *, greatest(0, -min(b) OVER (PARTITION BY platform, session_id, child_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS u FROM lb),
    lz AS (SELECT *, st = -1 AND u > coalesce(lag(u) OVER (PARTITION BY platform, session_id, child_id ORDER BY seq), 0) AS lost FROM lu),
    lw AS (SELECT o.platform, o.session_id, o.child_id, o.seq AS start_seq, 'r' || CAST(o.k AS VARCHAR) AS start_ref, c.seq AS stop_seq FROM (SELECT * FROM lz WHERE st = 1) o JOIN (SELECT * FROM lz WHERE st = -1 AND NOT lost) c
        ON c.platform = o.platform AND c.session_id = o.session_id AND c.child_id = o.child_id AND o.no = c.ns - c.u),
    ld AS (SELECT *, max(CASE WHEN st = -1 AND NOT lost THEN seq END) OVER (PARTITION BY platform, session_id, child_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dn FROM lz)"""
_add("subagent_windows_cursor", lambda s, d: pairing.lifecycle_windows(_cursor_events(s, d)), _sql(
    f"+{_LIFE} SELECT * FROM lw UNION ALL SELECT platform, session_id, child_id, NULL, '', seq FROM ld WHERE lost AND dn IS NULL", "ev"))
_add("subagent_windows_resumed", lambda s, d: pairing.lifecycle_windows(_cursor_events(s, d, True)))


def _subagent_events(s, d):
    ev = _cursor_events(s, d)
    windows = pairing.lifecycle_windows(ev).withColumn("generation", F.lit("g1")).withColumnRenamed("child_id", "owner")
    return pairing.events_for_subagent(ev.drop("child_id"), windows.withColumnRenamed("owner", "child_id")).select(*P, "child_id", "start_seq", "seq")


_add("events_for_subagent", _subagent_events, _sql(
    f"+{_LIFE} SELECT lw.platform, lw.session_id, lw.child_id, start_seq, ev.seq FROM lw JOIN ev ON ev.platform = lw.platform AND ev.session_id = lw.session_id AND ev.v % 4 = 1 AND ev.seq > start_seq AND ev.seq <= stop_seq", "ev"))


def _lone_starts(s, d):
    ev = _cursor_events(s, d).withColumn("child_id", F.concat(F.lit("x"), F.substring("call_ref", 2, 9)))
    return pairing.unmatched_starts(ev, pairing.lifecycle_windows(ev))


_LONE = _LIFE.replace("CAST(k % 6 AS VARCHAR)", "CAST(k AS VARCHAR)") + """, ls AS (SELECT platform, session_id, child_id, min(seq) AS seq, arg_min(ts, seq) AS ts, arg_min(CASE WHEN v % 5 = 0 THEN 's' || CAST(k AS VARCHAR) ELSE '' END, seq) AS agent_ref FROM lz
    WHERE st = 1 AND platform || session_id || child_id NOT IN (SELECT platform || session_id || child_id FROM lw) GROUP BY platform, session_id, child_id)"""
_add("unmatched_starts", lambda s, d: _lone_starts(s, d).select(*P, "child_id", "seq", "agent_ref"), _sql(f"+{_LONE} SELECT platform, session_id, child_id, seq, agent_ref FROM ls", "ev"))


def _child_tasks(s, d):
    kids = V.events(s, d).where("t = 'user_message'").selectExpr(*P, "concat('s', cast(seq as string)) as child_session", "ts as child_ts", "seq as child_order")
    return pairing.task_for_child(_lone_starts(s, d), kids).select(*P, "task_id", "child_session")


_add("task_for_child", _child_tasks, _sql(
    f"""+{_LONE}, kd AS (SELECT platform, session_id, 's' || CAST(seq AS VARCHAR) AS child_session, ts, seq FROM ev WHERE t = 'user_message'),
    nm AS (SELECT kd.platform, kd.session_id, child_session, kd.seq, arg_min(child_id, ls.seq) AS task_id FROM kd JOIN ls ON ls.platform = kd.platform AND ls.session_id = kd.session_id AND ls.agent_ref = child_session GROUP BY ALL),
    af AS (SELECT kd.platform, kd.session_id, child_session, kd.seq, ls.child_id AS task_id FROM kd ASOF JOIN ls ON ls.platform = kd.platform AND ls.session_id = kd.session_id AND kd.ts >= ls.ts WHERE child_session NOT IN (SELECT child_session FROM nm)),
    al AS (SELECT * FROM nm UNION ALL SELECT * FROM af)
    SELECT platform, session_id, task_id, arg_min(child_session, seq) AS child_session FROM al GROUP BY platform, session_id, task_id""", "ev"))

# --- attribution -----------------------------------------------------------------------


def _kit(s, d):
    return star_frames.copilot_calls(s, d), star_frames.copilot_call_tools(s, d), star_frames.copilot_usage(s, d)


def _rooted(s, d):
    calls, tools, _ = _kit(s, d)
    return attribution.root_calls(attribution.with_tools(calls, tools), tools)


_add("root_call", lambda s, d: _rooted(s, d).select(*P, "call_id", "root_call"), _sql("SELECT platform, session_id, call_id, root_call FROM kr", "kr"))


def _chain(s, d):
    """Each order hangs under the one half its key, every 64th is a main turn: chains of up to six links."""
    t = V.table(s, d, "orders").selectExpr(
        "'copilot' as platform", "'one' as session_id", "cast(o_orderkey as string) as turn_id",
        "case when o_orderkey % 64 <> 0 then cast(o_orderkey - (o_orderkey & -o_orderkey) as string) end as parent_turn_id")
    return attribution.root_turn_owner(t).select(*P, "turn_id", "main_turn_id")


_add("root_turn_owner", _chain, "SELECT 'copilot' AS platform, 'one' AS session_id, CAST(o_orderkey AS VARCHAR) AS turn_id, CAST(o_orderkey - o_orderkey % 64 AS VARCHAR) AS main_turn_id FROM orders")
_add("interaction_order", lambda s, d: attribution.interaction_order(_rooted(s, d)).select("session_id", "interaction", "first_pos", "stored_turn_id", "turn_index"), _sql(
    "SELECT session_id, interaction, first_pos, stored_turn_id, turn_index FROM io", "io"))
_add("cycle_order", lambda s, d: attribution.cycle_order(_kit(s, d)[0]).select("call_id", "cycle"), _sql("SELECT call_id, cycle FROM cy", "cy"))


def _direct(s, d):
    calls, _, usage = _kit(s, d)
    left = usage.selectExpr(*P, "logical_call_id", "concat('n', cast(l_orderkey div 3 as string)) as native_id")
    right = calls.selectExpr(*P, "call_id", "case when pos % 3 = 0 or pos % 7 = 0 then concat('n', cast(pos div 3 as string)) end as native_id").where("native_id is not null")
    return attribution.direct_matches(left, right).select("logical_call_id", "direct_call", "direct_status")


_add("direct_usage_match", lambda s, d: _direct(s, d), _sql(
    """+l AS (SELECT session_id, logical_call_id, 'n' || CAST(l_orderkey // 3 AS VARCHAR) AS id FROM ku), r AS (SELECT session_id, call_id, 'n' || CAST(pos // 3 AS VARCHAR) AS id FROM kc WHERE pos % 3 = 0 OR pos % 7 = 0)
    SELECT logical_call_id, CASE WHEN count(DISTINCT call_id) = 1 THEN min(call_id) END AS direct_call, CASE WHEN count(DISTINCT call_id) = 1 THEN 'matched' ELSE 'conflicting' END AS direct_status
    FROM l JOIN r USING (session_id, id) GROUP BY logical_call_id""", "ku", "kc"))


def _ordered(s, d):
    calls, tools, usage = _kit(s, d)
    return attribution.ordered_matches(attribution.with_tools(calls, tools), usage).select("logical_call_id", F.col("ordered_call").alias("call_id"))


_add("ordered_usage_match", _ordered, _sql("SELECT logical_call_id, call_id FROM om", "om"))
_AT = """cm AS (SELECT chosen, count(*) AS claims FROM att WHERE chosen IS NOT NULL GROUP BY chosen),
    fn AS (SELECT att.session_id, att.logical_call_id, CASE WHEN ordered_call IS NOT NULL THEN r2.stored_turn_id ELSE index_turn END AS stored_turn_id,
    CASE WHEN ordered_call IS NOT NULL THEN r.agent_id ELSE usage_agent END AS agent_id,
    CASE WHEN claims = 1 THEN att.chosen END AS call_id, CASE WHEN claims > 1 THEN 'conflicting' WHEN att.chosen IS NOT NULL THEN 'matched' WHEN possible > 1 THEN 'ambiguous' ELSE 'pending' END AS status
    FROM att LEFT JOIN cm USING (chosen) LEFT JOIN kr r ON r.call_id = att.chosen LEFT JOIN kr r2 ON r2.call_id = coalesce(r.root_call, r.call_id))"""


def _attributed(s, d):
    return attribution.attribute_usage(*_kit(s, d))


_add("attribute_usage", lambda s, d: _attributed(s, d).select("session_id", "logical_call_id", "stored_turn_id", "agent_id", "call_id", "status"), _sql(
    f"+{_AT} SELECT session_id, logical_call_id, stored_turn_id, agent_id, call_id, status FROM fn", "att"))


def _placed(s, d):
    calls = star_frames.copilot_calls(s, d)
    turns = calls.where("pos % 8 < 6").selectExpr(*P, "stored_turn_id as turn_id")
    return attribution.place_accounting(_attributed(s, d), calls, turns).groupBy("owner_turn_id", "status").agg(F.count(F.lit(1)).alias("n"))


_add("place_accounting", _placed, _sql(
    f"""+{_AT}, kt AS (SELECT DISTINCT stored_turn_id AS t FROM kc WHERE pos % 8 < 6)
    SELECT t AS owner_turn_id, status, count(*) AS n FROM (SELECT fn.status, CASE WHEN fn.status = 'matched' THEN kc.stored_turn_id ELSE fn.stored_turn_id END AS o FROM fn LEFT JOIN kc ON kc.call_id = fn.call_id) LEFT JOIN kt ON t = o GROUP BY ALL""", "att"))


def _evidence(s, d):
    calls = star_frames.copilot_calls(s, d)
    turns = calls.selectExpr(*P, "stored_turn_id as turn_id", "interaction_id").distinct()
    events = star_frames.copilot_usage(s, d).selectExpr(
        *P, "case when l_linenumber < 4 then concat('i', cast(l_orderkey div 4 as string)) end as interaction_id",
        "case when l_linenumber > 2 then concat('turn', cast(l_orderkey div 4 as string)) end as stored_turn_id", "usage_source_id as source_id", "pk as seq")
    own = calls.selectExpr(*P, "stored_turn_id as turn_id", "call_id as source_id")
    archived = events.selectExpr(*P, "source_id", "seq", "cast(seq as string) as ts")
    return attribution.evidence_bounds(attribution.turn_evidence(own, turns, events), archived).select("session_id", "turn_id", "start_seq", "end_seq", "events")


_add("turn_evidence", _evidence, _sql(
    """SELECT session_id, 'turn' || CAST(l_orderkey // 4 AS VARCHAR) AS turn_id, min(pk) AS start_seq, max(pk) AS end_seq, count(*) AS events FROM ku GROUP BY ALL""", "ku"))

# --- accounting ------------------------------------------------------------------------


def _revisions(s, d):
    rows = star_frames.copilot_revisions(s, d)
    return accounting.row_metrics(copilot.usage_snapshot(rows, F.sha2(F.lit("k"), 256), F.col("generation")))


def _current(s, d, columns=None):
    return accounting.current_revisions(_revisions(s, d), columns)


_add("current_revisions", lambda s, d: _current(s, d, ("generation", "pos", "model")).select("session_id", "generation", "primary_key", "pos", "input_tokens", "cache_read_tokens", "model", "quarantine"), _sql(
    "SELECT session_id, generation, CAST(pk AS VARCHAR) AS primary_key, pos, input_tokens, cache_read_tokens, model, quarantine FROM cu", "cu"))
_add("copilot_usage_snapshot", lambda s, d: copilot.usage_snapshot(star_frames.copilot_revisions(s, d), F.lit("k"), F.col("generation")).select("session_id", "pos", "source_id", "logical_call_id"), _sql(
    """+j AS (SELECT *, 'sha256:' || sha256('{' || CASE WHEN agent_id IS NOT NULL THEN '"agent_id":"' || agent_id || '",' ELSE '' END || '"cache_read_tokens":' || CAST(cache_read_tokens AS VARCHAR) || ',"cache_write_tokens":0,"created_at":"' ||
    sd || '","id":' || CAST(pk AS VARCHAR) || ',"input_tokens":' || CAST(input_tokens AS VARCHAR) || CASE WHEN model IS NOT NULL THEN ',"model":"' || model || '"' ELSE '' END || ',"output_tokens":' || CAST(output_tokens AS VARCHAR) ||
    ',"reasoning_tokens":0,"total_nano_aiu":' || CAST(total_nano_aiu AS VARCHAR) || '}') AS rev FROM (SELECT cr.*, strftime(l_shipdate, '%Y-%m-%d') AS sd FROM cr POSITIONAL JOIN (SELECT l_shipdate FROM lineitem)))
    SELECT session_id, pos, 'copilot-db:k:' || session_id || ':assistant_usage_events:' || CAST(pk AS VARCHAR) || ':' || rev AS source_id, 'copilot:usage:k:assistant_usage_events:' || generation || ':' || CAST(pk AS VARCHAR) AS logical_call_id FROM j""", "cr"))
_ACC = """ac AS (SELECT session_id, NULL AS agent, true AS whole, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS r, sum(total_nano_aiu) AS n FROM cu WHERE quarantine IS NULL GROUP BY session_id
    UNION ALL SELECT session_id, coalesce(agent_id, 'main'), false, sum(input_tokens), sum(output_tokens), sum(cache_read_tokens), sum(total_nano_aiu) FROM cu WHERE quarantine IS NULL GROUP BY session_id, coalesce(agent_id, 'main'))"""
_add("accounted_metrics", lambda s, d: accounting.accounted_metrics(_current(s, d, accounting.ACCOUNTED)).select(
    "session_id", "agent", "whole", "input_tokens", "output_tokens", "cache_read_tokens", "total_nano_aiu"), _sql(
    f"+{_ACC} SELECT session_id, agent, whole, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(r AS BIGINT) AS cache_read_tokens, CAST(n AS BIGINT) AS total_nano_aiu FROM ac", "cu"))
_SHUT = """sh AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id, NULL AS agent, o_orderkey % 10 <> 0 AS readable, o_custkey + 5 AS i, CAST(floor(o_totalprice) AS BIGINT) + 1 AS n FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'main', o_orderkey % 10 <> 0, o_custkey, CAST(1 AS BIGINT) FROM orders)"""
_add("shutdown_totals", lambda s, d: accounting.shutdown_totals(star_frames.copilot_shutdowns(s, d)).select(
    "session_id", "agent", "readable", F.when(F.col("readable"), F.col("input_tokens")).alias("input_tokens"), F.when(F.col("readable"), F.col("total_nano_aiu")).alias("total_nano_aiu")), _sql(
    f"+{_SHUT} SELECT session_id, agent, readable, CASE WHEN readable THEN i END AS input_tokens, CASE WHEN readable THEN n END AS total_nano_aiu FROM sh", "cr").replace("WITH cr AS (" + VIEW_SQL["cr"] + "),", "WITH", 1))
_add("shutdown_mismatch", lambda s, d: accounting.shutdown_mismatch(
    accounting.shutdown_totals(star_frames.copilot_shutdowns(s, d)), accounting.accounted_metrics(_current(s, d, accounting.ACCOUNTED))).select(
    "session_id", "agent", "expected_input_tokens", "accounted_input_tokens", "expected_total_nano_aiu", "accounted_total_nano_aiu"), _sql(
    f"""+{_ACC}, {_SHUT} SELECT sh.session_id, sh.agent, sh.i AS expected_input_tokens, CAST(coalesce(ac.i, 0) AS BIGINT) AS accounted_input_tokens, sh.n AS expected_total_nano_aiu, CAST(coalesce(ac.n, 0) AS BIGINT) AS accounted_total_nano_aiu
    FROM sh LEFT JOIN ac ON ac.session_id = sh.session_id AND ac.agent IS NOT DISTINCT FROM sh.agent WHERE readable AND (sh.i <> coalesce(ac.i, 0) OR sh.n <> coalesce(ac.n, 0) OR coalesce(ac.o, 0) <> 0 OR coalesce(ac.r, 0) <> 0)""", "cu"))
_add("copilot_usage_rows", lambda s, d: usage_ops.usage_rollup(accounting.usage_rows(_current(s, d, accounting.COUNTED))), _sql(
    """SELECT platform, session_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens
    FROM cu WHERE quarantine IS NULL AND model IS NOT NULL GROUP BY platform, session_id""", "cu"))
_add("accounting_diagnostics", lambda s, d: _acc_diag(s, d), _sql(
    f"""+{_ACC}, {_SHUT}, mm AS (SELECT 1 FROM sh LEFT JOIN ac ON ac.session_id = sh.session_id AND ac.agent IS NOT DISTINCT FROM sh.agent WHERE readable AND (sh.i <> coalesce(ac.i, 0) OR sh.n <> coalesce(ac.n, 0) OR coalesce(ac.o, 0) <> 0 OR coalesce(ac.r, 0) <> 0))
    SELECT quarantine AS code, 'error' AS severity, count(*) AS n FROM cu WHERE quarantine IS NOT NULL GROUP BY 1 UNION ALL SELECT 'missing_usage_fields', 'warning', count(*) FROM cu WHERE quarantine IS NULL AND model IS NULL
    UNION ALL SELECT 'unknown_provider', 'info', count(*) FROM cu WHERE quarantine IS NULL AND model IS NOT NULL UNION ALL SELECT 'capability_gap', 'warning', count(*) FROM sh WHERE NOT readable
    UNION ALL SELECT 'shutdown_total_mismatch', 'warning', count(*) FROM mm""", "cu"))


def _acc_diag(s, d):
    # Both are read by several diagnostics.
    current = cut_lineage(_current(s, d, (*accounting.ACCOUNTED, *accounting.COUNTED, "source_id")))
    shut = star_frames.copilot_shutdowns(s, d)
    totals = cut_lineage(accounting.shutdown_totals(shut))
    bad = accounting.shutdown_mismatch(totals, accounting.accounted_metrics(current))
    return accounting.accounting_diagnostics(current, totals, bad, shut).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


_add("projection_counts", lambda s, d: accounting.projection_counts({"usage": _current(s, d, ()), "revisions": _revisions(s, d), "shutdowns": star_frames.copilot_shutdowns(s, d)}).drop("platform"), _sql(
    """+u AS (SELECT session_id, count(*) AS usage FROM cu GROUP BY 1), r AS (SELECT session_id, count(*) AS revisions FROM cr GROUP BY 1), h AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id, count(*) AS shutdowns FROM orders GROUP BY 1)
    SELECT session_id, coalesce(usage, 0) AS usage, coalesce(revisions, 0) AS revisions, coalesce(shutdowns, 0) AS shutdowns FROM u FULL JOIN r USING (session_id) FULL JOIN h USING (session_id)""", "cu"))

# --- scalar functions ------------------------------------------------------------------
_add("env_to_tag", lambda s, d: V.table(s, d, "customer").select("c_custkey", X.env_to_tag(F.concat(F.lit("WB_"), F.col("c_mktsegment")), F.col("c_name")).alias("tag")),
     "SELECT c_custkey, lower(c_mktsegment) || '-' || trim(regexp_replace(lower(c_name), '[^a-z0-9_.#-]', '-', 'g'), '-') AS tag FROM customer")
_add("validate_tag", lambda s, d: V.table(s, d, "pages").select("page_id", X.validate_tag(F.regexp_extract("url", "//([^/]*)", 1)).alias("tag"), X.validate_tag(F.col("url")).alias("whole")),
     "SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '//([^/]*)', 1), '^[a-z0-9_.#-]{1,64}$') THEN regexp_extract(url, '//([^/]*)', 1) END AS tag, CASE WHEN regexp_matches(url, '^[a-z0-9_.#-]{1,64}$') THEN url END AS whole FROM pages")
_add("percent_quote", lambda s, d: V.table(s, d, "pages").select("page_id", ids.percent_quote(F.col("url")).alias("quoted")), "SELECT page_id, url_encode(url) AS quoted FROM pages")
_add("cursor_generation_id", lambda s, d: V.events(s, d).select("seq", ids.child_generation_id(F.col("event_text")).alias("gid")), _sql(
    """+h AS (SELECT seq, sha256('subagent-request-' || event_text) AS h FROM ev)
    SELECT seq, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS gid FROM h""", "ev"))
_add("provider_of", lambda s, d: V.table(s, d, "documents").select("doc_id", ids.provider_of(F.col("text")).alias("provider"), ids.agent_name(F.col("source"), F.col("lang")).alias("agent")),
     """SELECT doc_id, CASE WHEN contains(lower(text), 'claude') THEN 'anthropic' WHEN contains(lower(text), 'gemini') THEN 'gcp.gemini' WHEN contains(lower(text), 'deepseek') THEN 'deepseek' WHEN contains(lower(text), 'grok') THEN 'x_ai'
     WHEN regexp_matches(lower(text), '^(gpt-|o1|o3|o4)') THEN 'openai' ELSE '' END AS provider, CASE WHEN coalesce(lang, '') <> '' THEN source || '[' || lang || ']' ELSE source END AS agent FROM documents""")
_add("span_ids", lambda s, d: V.events(s, d).select("seq", ids.span_id(ids.span_key(F.col("platform"), F.col("session_id"), "turn", F.col("seq"))).alias("span_id"), ids.span_id(
    ids.trace_key(F.col("platform"), F.col("session_id")), 16).alias("trace_id")))
_add("strip_synthetic_prefix", lambda s, d: V.table(s, d, "documents").select("doc_id", X.strip_synthetic_prefix(F.concat(
    F.lit("<environment_context>a</environment_context>\n<in-app-browser-context u=1>b</in-app-browser-context>"), F.expr("case when doc_id % 5 = 0 then '<task-notification>' else '' end"), F.col("text"))).alias("rest")).select(
    "doc_id", F.length("rest").alias("n"), F.md5("rest").alias("h")),
     """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS rest FROM documents) SELECT doc_id, length(rest) AS n, md5(rest) AS h FROM r""")
_add("semantic_value", lambda s, d: V.events(s, d).select("seq", F.expr(
    "try_parse_json(to_json(named_struct('command', case when k % 2 = 0 then command end, 'file_path', case when k % 3 = 0 then file_path end)))").alias("p")).select(
    "seq", payload.semantic_value(F.col("p"), payload.ARGUMENT_KEYS).alias("arguments")), _sql(
    """SELECT seq, CASE WHEN k % 6 = 0 THEN '{"command":"' || command || '","file_path":"' || file_path || '"}' WHEN k % 2 = 0 THEN '"' || command || '"' WHEN k % 3 = 0 THEN '"' || file_path || '"' END AS arguments FROM ev""", "ev"))
_add("foreign_payloads", lambda s, d: V.events(s, d).select("seq", F.expr(
    "try_parse_json(to_json(named_struct('hook_event_name', case when k % 2 = 0 then 'Stop' when k % 3 = 0 then 'agentStop' else 'beforeReadFile' end, 'cursor_version', case when v % 9 = 0 then '1' end)))").alias("p")).select(
    "seq", payload.foreign_reason(F.col("p"), "copilot").alias("copilot"), payload.foreign_reason(F.col("p"), "cursor").alias("cursor")), _sql(
    """SELECT seq, CASE WHEN v % 9 = 0 THEN 'Cursor marker cursor_version present' WHEN k % 2 <> 0 AND k % 3 <> 0 THEN 'Cursor event beforeReadFile received for copilot' END AS copilot,
    CASE WHEN k % 2 = 0 THEN 'PascalCase event Stop received for cursor' END AS cursor FROM ev""", "ev"))
_add("lineage_cycles", lambda s, d: _cycles(s, d), """SELECT 'copilot' AS platform, 's' AS session_id, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 8 < 4 THEN CAST(o_orderkey - o_orderkey % 4 AS VARCHAR) END AS root FROM orders""")


def _cycles(s, d):
    """Half of the groups of four hang together in a ring and so have no root."""
    nodes = V.table(s, d, "orders").selectExpr(
        "'copilot' as platform", "'s' as session_id", "cast(o_orderkey as string) as id", "o_orderkey % 8 = 0 as root_node",
        "cast(case when o_orderkey % 4 = 0 then o_orderkey + 3 else o_orderkey - 1 end as string) as up")
    return lineage.resolve_roots(nodes, P, "id", "up", F.col("root_node"), "root").select(*P, "id", "root")
