"""Turn trees at row level: every node with its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import child_generation_id
from spanloom.plans import trees
from spanloom.registry.platforms import _CT, _LIFE
from spanloom.sources import star_frames
from spanloom.sources import star_views as V
from spanloom.sources.star_views import with_views

QUERIES: dict = {}
ORACLE: dict = {}

P = ["platform", "session_id"]
STAMP = "yyyy-MM-dd HH:mm:ss.SSS"


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def _shown(nodes: DataFrame, *times: str) -> DataFrame:
    return nodes.select(*P, "kind", "node_id", "parent_id", "turn_id", "name", "start_seq", "end_seq", *[F.date_format(t, STAMP).alias(t) for t in times])


# --- codex -----------------------------------------------------------------------------
def _codex(s, d):
    """Prompts are also permission requests, every fifth report ends a turn, clicks and errors start and stop children."""
    events = V.events(s, d).selectExpr(
        *P, "seq", "ts", "case when t = 'user_message' then 'permission_request' when t = 'assistant_message' and k % 5 = 0 then 'agent_turn'"
        " when t = 'tool_call' then 'subagent_start' when t = 'tool_result' then 'subagent_message' end as t",
        "case when t = 'assistant_message' then concat('t', cast(v % 4 as string)) end as turn_id", "case when k % 3 <> 0 then cast(k % 3 as string) end as agent_id",
    ).where("t is not null")
    return _shown(trees.codex_turn_tree(star_frames.codex_frames(s, d), events), "start_ts", "end_ts")


_MS = "date_trunc('millisecond', {})"
_SHOW = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"
_CODEX = f"""+{_CT},
    tu AS (SELECT platform, session_id, turn_id, {_MS.format('arg_min(ts, seq)')} AS a, {_MS.format("arg_max(ts, seq) FILTER (WHERE t = 'assistant_message')")} AS b,
        arg_max('gpt-' || CAST(k % 3 AS VARCHAR), seq) FILTER (WHERE t = 'permission_request' AND k % 2 = 0) AS model FROM tf GROUP BY ALL),
    pc AS (SELECT platform, session_id, turn_id, call_no, count(*) FILTER (WHERE t = 'tool_call') AS outputs, arg_max(ts, seq) FILTER (WHERE t = 'tool_call') AS lo, max(CASE WHEN closes THEN ts END) AS closed,
        arg_min(ts, seq) FILTER (WHERE t = 'user_message') AS inp FROM cn GROUP BY ALL),
    pd AS (SELECT *, last_value(closed IGNORE NULLS) OVER (PARTITION BY platform, session_id, turn_id ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM pc),
    an AS (SELECT platform, session_id, turn_id, k, arg_max(ts, seq) AS b FROM tf WHERE t = 'tool_result' GROUP BY ALL),
    mk AS (SELECT e.platform, e.session_id, e.seq, tu.turn_id, a, b FROM ev e JOIN tu ON tu.platform = e.platform AND tu.session_id = e.session_id AND tu.turn_id = 't' || CAST(e.v % 4 AS VARCHAR) WHERE e.t = 'assistant_message' AND e.k % 5 = 0),
    q AS (SELECT e.platform, e.session_id, e.seq, CASE e.t WHEN 'tool_call' THEN 1 ELSE -1 END AS st, CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS VARCHAR) END AS agent_id, mk.seq AS ms, mk.turn_id
        FROM (SELECT * FROM ev WHERE t IN ('tool_call', 'tool_result')) e ASOF JOIN mk ON e.platform = mk.platform AND e.session_id = mk.session_id AND e.seq < mk.seq),
    qb AS (SELECT *, sum(st) OVER w AS b, count(*) FILTER (WHERE st = 1) OVER w AS no, count(*) FILTER (WHERE st = -1) OVER w AS ns FROM q WINDOW w AS (PARTITION BY platform, session_id, ms, agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    qu AS (SELECT *, greatest(0, -min(b) OVER (PARTITION BY platform, session_id, ms, agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS u FROM qb),
    z AS (SELECT *, st = -1 AND u > coalesce(lag(u) OVER (PARTITION BY platform, session_id, ms, agent_id ORDER BY seq), 0) AS lost FROM qu),
    dz AS (SELECT *, CASE WHEN st = 1 THEN b + u WHEN NOT lost THEN b + u + 1 END AS lv FROM z WHERE agent_id IS NULL),
    ds AS (SELECT *, max(CASE WHEN st = 1 THEN seq END) OVER (PARTITION BY platform, session_id, ms, lv ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM dz),
    kids AS (SELECT o.platform, o.session_id, o.turn_id, o.agent_id, o.seq AS start_seq, c.seq AS stop_seq FROM (SELECT * FROM z WHERE agent_id IS NOT NULL AND st = 1) o JOIN (SELECT * FROM z WHERE agent_id IS NOT NULL AND st = -1 AND NOT lost) c
        ON c.platform = o.platform AND c.session_id = o.session_id AND c.ms = o.ms AND c.agent_id = o.agent_id AND o.no = c.ns - c.u UNION ALL SELECT platform, session_id, turn_id, NULL, ps, seq FROM ds WHERE st = -1 AND NOT lost),
    nodes AS (SELECT platform, session_id, 'turn' AS kind, 'turn/' || turn_id AS node_id, NULL AS parent_id, turn_id, model AS name, CAST(NULL AS BIGINT) AS start_seq, CAST(NULL AS BIGINT) AS end_seq, a, b FROM tu
        UNION ALL SELECT platform, session_id, 'call', 'call/' || turn_id || ':' || CAST(call_no AS VARCHAR), 'turn/' || turn_id, turn_id, NULL, NULL, NULL, coalesce(CASE WHEN call_no = 0 THEN inp ELSE pv END, closed, lo), coalesce(lo, closed) FROM pd WHERE outputs > 0
        UNION ALL SELECT platform, session_id, 'tool', 'tool/' || CAST(seq AS VARCHAR), 'call/' || turn_id || ':' || CAST(call_no AS VARCHAR), turn_id, tool_name, seq, NULL, ts, coalesce(an.b, ts) FROM cn LEFT JOIN an USING (platform, session_id, turn_id, k) WHERE t = 'tool_call'
        UNION ALL SELECT e.platform, e.session_id, 'permission', 'permission/' || CAST(e.seq AS VARCHAR), 'turn/' || mk.turn_id, mk.turn_id, NULL, e.seq, e.seq, e.ts, e.ts
            FROM (SELECT * FROM ev WHERE t = 'user_message') e ASOF JOIN mk ON e.platform = mk.platform AND e.session_id = mk.session_id AND e.seq < mk.seq WHERE e.ts BETWEEN mk.a AND mk.b
        UNION ALL SELECT platform, session_id, 'subagent', 'subagent/' || CAST(start_seq AS VARCHAR), 'turn/' || turn_id, turn_id, agent_id, start_seq, stop_seq, NULL, NULL FROM kids)
    SELECT platform, session_id, kind, node_id, parent_id, turn_id, name, start_seq, end_seq, {_SHOW.format('a')} AS start_ts, {_SHOW.format('b')} AS end_ts FROM nodes"""
_add("codex_turn_tree", _codex, with_views(_CODEX, "ev"))


# --- cursor ----------------------------------------------------------------------------
def _cursor(s, d, wide=False):
    """Sign-ups and purchases start and stop children, which dispatch ``r0`` to ``r4``; two thirds of the rows run under a child's generation."""
    events = V.events(s, d).selectExpr(
        *P, "seq", "ts", "case t when 'permission_request' then 'subagent_start' when 'assistant_message' then 'subagent_message' else t end as t",
        "concat('x', cast(k % 6 as string)) as child_id", "case when t like 'tool%' then concat('r', cast(k % 7 as string)) else concat('r', cast(v % 5 as string)) end as call_ref",
        "false as resume", "'' as agent_ref", "'f' as family", "tool_name as name", "command as signature", "false as instant", "k",
    ).withColumn("generation", F.when(F.expr("k % 3 = 0"), F.expr("concat('g', cast(k % 2 as string))")).otherwise(child_generation_id(F.expr("concat('r', cast(k % 5 as string))"))))
    return _shown(trees.cursor_turn_tree(events.drop("k"), session_wide=wide))


def _gid(ref: str) -> str:
    h = f"sha256('subagent-request-' || {ref})"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1)"
        f" || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


_WINDOWS = _LIFE.replace("'tool_result'", "'assistant_message'").replace("'r' || CAST(o.k AS VARCHAR)", "'r' || CAST(o.v % 5 AS VARCHAR)")
_CURSOR = f"""+{_WINDOWS},
    te AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'g' || CAST(k % 2 AS VARCHAR) ELSE {_gid("'r' || CAST(k % 5 AS VARCHAR)")} END AS gen, CASE WHEN t IN ('tool_call', 'tool_result') THEN 'r' || CAST(k % 7 AS VARCHAR) ELSE 'r' || CAST(v % 5 AS VARCHAR) END AS ref FROM ev),
    wi AS (SELECT *, {_gid('start_ref')} AS gen FROM lw),
    hd AS (SELECT e.platform, e.session_id, e.seq, max(start_seq) AS ws FROM te e JOIN wi USING (platform, session_id, gen) WHERE e.seq > start_seq AND e.seq <= stop_seq GROUP BY ALL),
    tn AS (SELECT platform, session_id, gen, min(seq) AS lo, max(seq) AS hi, 1 AS one FROM te ANTI JOIN wi USING (platform, session_id, gen) GROUP BY ALL),
    sr AS (SELECT DISTINCT platform, session_id, ref, 1 AS dispatched FROM te WHERE t = 'permission_request'),
    n AS (SELECT *, row_number() OVER (PARTITION BY platform, session_id, gen, ref, t ORDER BY seq) AS rn FROM te WHERE t IN ('tool_call', 'tool_result')),
    p AS (SELECT platform, session_id, gen, ref, c.seq AS call_seq, r.seq AS result_seq, coalesce(c.seq, r.seq) AS seq, coalesce(c.tool_name, r.tool_name) AS name FROM (SELECT * FROM n WHERE t = 'tool_call') c FULL JOIN (SELECT * FROM n WHERE t = 'tool_result') r USING (platform, session_id, gen, ref, rn)),
    nodes AS (SELECT platform, session_id, 'turn' AS kind, 'turn/' || gen AS node_id, NULL AS parent_id, gen AS turn_id, NULL AS name, lo AS start_seq, hi AS end_seq FROM tn
        UNION ALL SELECT platform, session_id, 'subagent', 'subagent/' || CAST(start_seq AS VARCHAR), CASE WHEN ws IS NOT NULL THEN 'subagent/' || CAST(ws AS VARCHAR) WHEN one = 1 THEN 'turn/' || gen END, gen, child_id, start_seq, stop_seq
            FROM (SELECT lw.*, te.gen FROM lw JOIN te ON te.platform = lw.platform AND te.session_id = lw.session_id AND te.seq = start_seq) w LEFT JOIN (SELECT platform, session_id, seq AS start_seq, ws FROM hd) USING (platform, session_id, start_seq) LEFT JOIN tn USING (platform, session_id, gen)
        UNION ALL SELECT platform, session_id, 'tool', 'tool/' || CAST(seq AS VARCHAR), CASE WHEN ws IS NOT NULL THEN 'subagent/' || CAST(ws AS VARCHAR) WHEN one = 1 THEN 'turn/' || gen END, gen, p.name, call_seq, result_seq
            FROM p LEFT JOIN hd USING (platform, session_id, seq) LEFT JOIN sr USING (platform, session_id, ref) LEFT JOIN tn USING (platform, session_id, gen) WHERE ws IS NULL OR dispatched IS NULL)"""
_add("cursor_turn_tree", _cursor, with_views(f"{_CURSOR} SELECT * FROM nodes", "ev"))
_add("cursor_session_tree", lambda s, d: _cursor(s, d, True), with_views(
    f"""{_CURSOR} SELECT * REPLACE (coalesce(parent_id, 'session/' || platform || '/' || session_id) AS parent_id) FROM nodes
    UNION ALL SELECT platform, session_id, 'session', 'session/' || platform || '/' || session_id, NULL, NULL, NULL, min(seq), max(seq) FROM ev GROUP BY ALL""", "ev"))
