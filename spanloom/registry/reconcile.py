"""Queries over whole chains: platform rows to the daily report, copilot records to their projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import accounting, usage
from spanloom.plans.projection import historical_accounting, projection, projection_spans
from spanloom.registry.core import _DAYS, _ROLL, _day_text
from spanloom.registry.platforms import _current
from spanloom.sources import claude, codex, star_frames, tables
from spanloom.sources import star_views as V
from spanloom.sources.star_views import SQL as VIEW_SQL
from spanloom.sources.star_views import with_views

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


# --- usage of all platforms ------------------------------------------------------------


def _all_usage(s, d):
    """Calls read from claude, codex and cursor logs, the copilot database and the store's own mirror."""
    of = lambda df, platform: df.withColumn("platform", F.lit(platform))
    return usage.dedup_calls(usage.typed_usage(
        of(claude.usage_rows(star_frames.claude_frames(s, d, star_frames.OFFSET)), "claude"),
        of(codex.usage_rows(star_frames.codex_frames(s, d)), "codex"),
        of(tables.cursor_usage_rows(star_frames.cursor_stops(s, d)), "cursor"),
        accounting.usage_rows(_current(s, d, accounting.COUNTED)),
        of(V.usage_raw(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")), "mirror"),
    ))


VIEW_SQL["crd"] = VIEW_SQL["cr"].replace(" FROM lineitem", ", l_shipdate FROM lineitem")
VIEW_SQL["cud"] = VIEW_SQL["cu"].replace("FROM cr ", "FROM crd ")
_USAGE = """cxm AS (SELECT *, last_value(CASE WHEN t = 'permission_request' AND k % 2 = 0 THEN 'gpt-' || CAST(k % 3 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM ev),
    csq AS (SELECT *, coalesce(CASE WHEN v % 2 = 0 THEN 'g' || CAST(k % 2 AS VARCHAR) END, CASE WHEN v % 5 = 0 THEN 'g9' END) AS g FROM ev WHERE t = 'assistant_message'),
    csl AS (SELECT *, lag(g) OVER (PARTITION BY platform, session_id ORDER BY seq) AS pg FROM csq WHERE g IS NOT NULL AND k % 7 <> 0 AND k % 11 <> 0),
    every AS (
      SELECT 'claude' AS platform, session_id, pos, call_id, vts AS ts, v + CASE WHEN k % 2 = 0 THEN v % 7 ELSE 0 END AS input_tokens, k AS output_tokens FROM cf WHERE is_call
      UNION ALL SELECT 'codex', session_id, seq, 'cum:' || CAST(seq - seq % 300 AS VARCHAR), ts, v, k FROM cxm WHERE t = 'assistant_message'
      UNION ALL SELECT 'cursor', session_id, seq, g, ts, v, k FROM csl WHERE pg IS NULL OR pg <> g
      UNION ALL SELECT platform, session_id, pos, generation || pk, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP), input_tokens, output_tokens FROM cud WHERE quarantine IS NULL AND model IS NOT NULL
      UNION ALL SELECT 'mirror', session_id, pos, call_id, ts, input_tokens, output_tokens FROM usage_raw),
    usage_calls AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY platform, session_id, call_id ORDER BY pos DESC) = 1)"""
_NEED = ("ev", "cf", "crd", "cud", "usage_raw")
_add("platform_usage_by_day", lambda s, d: _day_text(usage.usage_by_day(_all_usage(s, d))), with_views(
    "+" + _USAGE + _DAYS.format(where="WHERE ts IS NOT NULL", lo="(SELECT CAST(min(day) AS TIMESTAMP) FROM d)", hi="(SELECT CAST(max(day) AS TIMESTAMP) FROM d)"), *_NEED))
_add("platform_usage_rollup", lambda s, d: usage.usage_rollup(_all_usage(s, d)), with_views("+" + _USAGE + " " + _ROLL.format(where=""), *_NEED))

_add("spike_events", lambda s, d: usage.spike_events(claude.usage_rows(star_frames.claude_frames(s, d)).withColumnRenamed("pos", "seq"), V.events(s, d), output_over=40, input_over=900).select(
    "platform", "session_id", "seq", "call_id", "input_tokens", "output_tokens", "event_seq", "event_t"), with_views(
    """+pe AS (SELECT platform, session_id, seq, lag(seq) OVER w AS event_seq, lag(t) OVER w AS event_t FROM ev WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq)),
    sp AS (SELECT platform, session_id, pos AS seq, call_id, v + CASE WHEN k % 2 = 0 THEN v % 7 ELSE 0 END AS input_tokens, k AS output_tokens FROM cf WHERE is_call)
    SELECT sp.*, event_seq, event_t FROM sp JOIN pe USING (platform, session_id, seq) WHERE output_tokens > 40 OR input_tokens > 900""", "ev", "cf"))

# --- copilot projection ----------------------------------------------------------------



def _projection(s, d):
    return projection(star_frames.copilot_records(s, d), star_frames.copilot_database(s, d), F.lit("key"), F.lit("key"), F.col("generation"))


def _sql(body, *names):
    return with_views(body, *names)


_TURNS = ("pb", "px", "pt", "pl")
_CALLS = (*_TURNS, "pc", "pr")
_ALL = (*_CALLS, "pv", "pu", "pio", "pom", "pcy", "ppo", "patt")
_AT = "strftime(TIMESTAMP '2024-01-01' + to_seconds({0} - s * 256), '%Y-%m-%dT%H:%M:%SZ')"
_add("copilot_projection_turns", lambda s, d: _projection(s, d)["turns"].select(
    "session_id", "turn_id", F.when(F.col("agent") != "", F.col("parent_turn_id")).alias("parent_turn_id"), "start_ts", "end_ts", "input", "output", "status"), _sql(
    f"""SELECT CAST(s AS VARCHAR) AS session_id, turn_id, CASE WHEN child THEN replace(turn_id, ':a' || iv, '') END AS parent_turn_id, {_AT.format("(k0 * 16 + CASE WHEN child THEN 1 ELSE 0 END)")} AS start_ts,
    {_AT.format("(CASE WHEN early THEN last_end ELSE shut END)")} AS end_ts, CASE WHEN child THEN 'sub' ELSE 'ask' END || k0 AS input, coalesce(said, '') AS output, status FROM pl WHERE complete AND NOT lost""", *_TURNS))
_add("copilot_projection_calls", lambda s, d: _projection(s, d)["calls"].select(
    "session_id", "call_id", "stored_turn_id", "interaction_id", "agent_id", "model", "start_ts", "end_ts", "finish_kind", F.col("tools").cast("bigint").alias("tools")), _sql(
    "SELECT session_id, call_id, stored_turn_id, interaction_id, agent_id, model, start_ts, end_ts, finish_kind, CAST(has_tools AS BIGINT) AS tools FROM pc", *_CALLS))

_FINAL = """pcm AS (SELECT chosen, count(*) AS claims FROM patt WHERE chosen IS NOT NULL GROUP BY chosen),
    pfin AS (SELECT a.session_id, a.logical_call_id, a.turn_index, u.agent_id AS ua, u.parent_tool_call_id AS up, u.model AS um, u.finish_reason AS uf, u.initiator AS ui, u.quarantine, u.ts, u.pos AS upos, u.pk, u.generation,
      pio.interaction, a.chosen, a.ordered_call, claims, y.cycle, coalesce(r2.interaction_id, r.interaction_id) AS root_interaction,
      CASE WHEN a.ordered_call IS NOT NULL THEN r2.stored_turn_id ELSE a.index_turn END AS stored_turn_id, CASE WHEN a.ordered_call IS NOT NULL THEN r.agent_id ELSE u.agent_id END AS agent_id,
      CASE WHEN claims = 1 THEN a.chosen END AS call_id, CASE WHEN claims > 1 THEN 'conflicting' WHEN a.chosen IS NOT NULL THEN 'matched' WHEN possible > 1 THEN 'ambiguous' ELSE 'pending' END AS status, r.stored_turn_id AS call_turn
      FROM patt a JOIN pu u USING (session_id, logical_call_id) LEFT JOIN pcm USING (chosen) LEFT JOIN pr r ON r.call_id = a.chosen LEFT JOIN pr r2 ON r2.call_id = coalesce(r.root_call, r.call_id)
      LEFT JOIN pcy y ON y.call_id = a.chosen LEFT JOIN pio ON pio.session_id = a.session_id AND pio.turn_index = a.turn_index),
    pevi AS (SELECT *, CASE status WHEN 'conflicting' THEN 'logical_call_id:' || logical_call_id || '|call_id:' || chosen
      WHEN 'matched' THEN concat('join_kind:inferred|interaction_id:', coalesce(CASE WHEN ordered_call IS NULL THEN interaction ELSE root_interaction END, 'None'), '|turn_index:', turn_index, '|agent_id:', coalesce(ua, 'None'),
        '|parent_tool_call_id:', coalesce(up, 'None'), '|model:', coalesce(um, 'None'), '|finish:', coalesce(uf, 'None'), '|initiator:', coalesce(ui, 'None'), '|order:', cycle, '|call_id:', chosen)
      WHEN 'ambiguous' THEN concat('interaction_id:', interaction, '|model:', coalesce(um, 'None'), '|turn_index:', turn_index)
      ELSE concat('logical_call_id:', logical_call_id, coalesce('|interaction_id:' || interaction, ''), '|turn_index:', turn_index) END AS evidence FROM pfin),
    pown AS (SELECT e.*, t.turn_id AS owner_turn_id FROM pevi e LEFT JOIN (SELECT turn_id FROM pl WHERE complete AND NOT lost) t ON t.turn_id = CASE WHEN e.status = 'matched' THEN e.call_turn ELSE e.stored_turn_id END)"""
_add("copilot_projection", lambda s, d: _projection(s, d)["attributions"].select(
    "session_id", "logical_call_id", "stored_turn_id", "agent_id", "call_id", "status", "join_kind", F.array_join("evidence", "|").alias("evidence")), _sql(
    f"+{_FINAL} SELECT session_id, logical_call_id, stored_turn_id, agent_id, call_id, status, CASE WHEN status = 'matched' THEN 'inferred' END AS join_kind, evidence FROM pevi", *_ALL))
_add("copilot_accounting", lambda s, d: _projection(s, d)["accounting"].select("session_id", "logical_call_id", "status", "owner_turn_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), _sql(
    f"+{_FINAL} SELECT session_id, logical_call_id, status, owner_turn_id, strftime(ts, '%Y-%m-%d') AS day FROM pown WHERE quarantine IS NULL AND ts IS NOT NULL AND um IS NOT NULL", *_ALL))
_add("copilot_candidate_sets", lambda s, d: _candidates(s, d), _sql(
    f"""+{_FINAL} SELECT f.logical_call_id, f.session_id, c.call_id FROM pfin f JOIN (SELECT c.*, coalesce(m.interaction_id, c.interaction_id) AS ri FROM pcy c LEFT JOIN pr m ON m.call_id = c.root_call) c ON c.session_id = f.session_id AND c.ri = f.interaction
    AND c.agent_id IS NOT DISTINCT FROM f.ua AND c.parent_tool_call_id IS NOT DISTINCT FROM f.up AND c.model IS NOT DISTINCT FROM f.um
    WHERE f.status = 'ambiguous' AND CASE WHEN uf IS NULL THEN true WHEN uf = 'tool_calls' THEN has_tools ELSE NOT has_tools AND has_finish END
    AND CASE WHEN ui IS NULL THEN true WHEN ui = 'user' THEN c.cycle = 0 ELSE c.cycle > 0 AND c.agent_id IS NULL END""", *_ALL))


def _candidates(s, d):
    made = _projection(s, d)
    return made["attributions"].where("candidate_set is not null").join(made["candidate_sets"].withColumnRenamed("call_id", "candidate"), ["platform", "session_id", "candidate_set"]).select(
        "session_id", "logical_call_id", F.col("candidate").alias("call_id"))


_PENDING = """ppen AS (
    SELECT s, 'missing_identity' AS kind, 'pending:identity:r' || (k * 16 + 7) AS id, 'user message has no interactionId' AS reason, 'native_type:user.message' AS evidence FROM pb WHERE c % 17 = 0
    UNION ALL SELECT s, 'missing_identity', 'pending:identity:r' || (k * 16 + 6), 'abort has no uniquely matching open model cycle', 'turn_id:1' FROM pb WHERE aborts AND ends
    UNION ALL SELECT s, 'incomplete_tool_pair', 'pending:tool:t' || k, 'tool result has no requesting assistant message', 'tool_call_id:t' || k FROM pb WHERE NOT asks AND c % 5 <> 0 AND c % 11 = 0
    UNION ALL SELECT s, 'incomplete_tool_pair', 'pending:tool:t' || k, 'tool request has no execution result', 'tool_call_id:t' || k FROM pb WHERE asks AND c % 5 = 0
    UNION ALL SELECT s, 'open_interaction', 'pending:' || turn_id, CASE WHEN ended THEN 'user interaction has no completed final assistant turn' ELSE 'user interaction has no assistant.turn_end' END, 'interaction_id:i' || iv FROM pl WHERE NOT complete
    UNION ALL SELECT s, 'missing_identity', 'pending:identity:' || turn_id, 'completed child interaction has no resolved parent tool call', 'interaction_id:i' || iv || '|agent_id:a' || iv FROM pl WHERE lost
    UNION ALL SELECT s, 'missing_source_capability', 'pending:unknown-version:r' || (k * 16 + 8), 'unknown transcript schema_version', 'schema_version:99' FROM pb WHERE c % 19 = 0
    UNION ALL SELECT CAST(session_id AS BIGINT), 'unmatched_usage', 'pending:usage:' || logical_call_id, 'usage attribution is ' || status, evidence FROM pevi WHERE status <> 'matched')"""
_add("copilot_pending_items", lambda s, d: _projection(s, d)["pending"].select("session_id", "kind", "id", "reason", F.array_join("evidence", "|").alias("evidence")), _sql(
    f"+{_FINAL}, {_PENDING} SELECT CAST(s AS VARCHAR) AS session_id, kind, id, reason, evidence FROM ppen", *_ALL))
_ITEM_SOURCES = """pis AS (SELECT iv, m = 3 AS child, s, 'r' || (k * 16 + j) AS source_id FROM pb, (SELECT unnest([0, 1, 2, 5, 6]) AS j)
    WHERE (j = 0 AND m = 0) OR (j = 1 AND m = 3) OR j = 2 OR (j = 5 AND ends) OR (j = 6 AND aborts))"""
_DIAG = """pdg AS (
    SELECT s, 'capability_gap' AS code, 'warning' AS severity, 'r' || (k * 16 + 8) AS subject, 'r' || (k * 16 + 8) AS source_id FROM pb WHERE c % 19 = 0
    UNION ALL SELECT pis.s, 'capability_gap', 'warning', 'pending:identity:' || turn_id, source_id FROM pl JOIN pis USING (iv, child) WHERE lost
    UNION ALL SELECT pis.s, 'open_interaction', 'info', 'pending:' || turn_id, source_id FROM pl JOIN pis USING (iv, child) WHERE NOT complete
    UNION ALL SELECT s, 'auxiliary_excluded_from_main', 'info', 'r' || (k * 16 + 9), 'r' || (k * 16 + 9) FROM pb WHERE c % 23 = 0
    UNION ALL SELECT s, 'checkpoint_not_additive', 'info', 'r' || (k * 16 + 11), 'r' || (k * 16 + 11) FROM pb WHERE k % 16 = 8 AND c % 2 = 0
    UNION ALL SELECT b.s, 'shutdown_total_mismatch', 'warning', 'r' || (k * 16 + 10), 'r' || (k * 16 + 10) FROM pb b LEFT JOIN (SELECT session_id, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS r, count(*) AS n FROM pu WHERE quarantine IS NULL GROUP BY 1) a
      ON a.session_id = CAST(b.s AS VARCHAR) WHERE k % 16 = 15 AND (c % 50 <> coalesce(i, 0) OR coalesce(o, 0) <> 0 OR coalesce(r, 0) <> 0 OR c <> coalesce(n, 0))
    UNION ALL SELECT CAST(session_id AS BIGINT), 'usage_row_id_reuse', 'error', CAST(pk AS VARCHAR), 'u' || pos FROM pv WHERE (session_id, pk) IN (SELECT (session_id, pk) FROM pu WHERE quarantine = 'usage_row_id_reuse')
    UNION ALL SELECT CAST(pu.session_id AS BIGINT), 'usage_revision_conflict', 'error', logical_call_id, 'u' || pv.pos FROM pu JOIN pv USING (session_id, generation, pk) WHERE quarantine = 'usage_revision_conflict'
    UNION ALL SELECT CAST(session_id AS BIGINT), 'missing_usage_fields', 'warning', logical_call_id, 'u' || pos FROM pu WHERE quarantine IS NULL AND (ts IS NULL OR model IS NULL)
    UNION ALL SELECT CAST(session_id AS BIGINT), 'unknown_provider', 'info', logical_call_id, 'u' || pos FROM pu WHERE quarantine IS NULL AND ts IS NOT NULL AND model IS NOT NULL AND provider IS NULL
    UNION ALL SELECT CAST(session_id AS BIGINT), 'inferred_join', 'info', logical_call_id, 'u' || upos FROM pevi WHERE status = 'matched')"""
_add("copilot_diagnostics", lambda s, d: _projection(s, d)["diagnostics"].select("session_id", "code", "severity", "subject", "sources"), _sql(
    f"+{_FINAL}, {_ITEM_SOURCES}, {_DIAG} SELECT CAST(s AS VARCHAR) AS session_id, code, severity, subject, count(*) AS sources FROM pdg GROUP BY ALL".replace("(session_id, pk) IN (SELECT (session_id, pk) FROM", "session_id || '/' || pk IN (SELECT session_id || '/' || pk FROM"), *_ALL))
_EVENTS = """pev AS (SELECT s, sum(1 + CAST(m IN (0, 3) AS INT) + CAST(asks AS INT) + CAST(asks AND c % 7 <> 0 AS INT) + CAST(c % 5 <> 0 AND (asks OR c % 11 = 0) AS INT) + CAST(ends AS INT) + CAST(aborts AS INT)
    + CAST(c % 17 = 0 AS INT) + CAST(c % 19 = 0 AS INT) + CAST(c % 23 = 0 AS INT) + CAST(k % 16 = 15 AS INT) + CAST(k % 16 = 8 AND asks AS INT)) AS events FROM pb GROUP BY s)"""
_add("copilot_counts", lambda s, d: _projection(s, d)["counts"].drop("platform"), _sql(
    f"""+{_FINAL}, {_PENDING}, {_EVENTS}, tall AS (SELECT s, 'turns' AS part FROM pl WHERE complete AND NOT child UNION ALL SELECT s, 'pending' FROM ppen UNION ALL SELECT CAST(session_id AS BIGINT), status FROM pevi WHERE status IN ('ambiguous', 'conflicting')
    UNION ALL SELECT CAST(session_id AS BIGINT), 'usage' FROM pu WHERE quarantine IS NULL AND ts IS NOT NULL AND model IS NOT NULL
    UNION ALL SELECT CAST(session_id AS BIGINT), 'errors' FROM (SELECT DISTINCT session_id, CASE WHEN quarantine = 'usage_row_id_reuse' THEN CAST(pk AS VARCHAR) ELSE logical_call_id END FROM pu WHERE quarantine IS NOT NULL))
    SELECT CAST(s AS VARCHAR) AS session_id, CAST(any_value(events) AS BIGINT) AS events, count(*) FILTER (WHERE part = 'usage') AS usage, count(*) FILTER (WHERE part = 'turns') AS turns, count(*) FILTER (WHERE part = 'pending') AS pending,
    count(*) FILTER (WHERE part = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE part = 'conflicting') AS conflicting, count(*) FILTER (WHERE part = 'errors') AS errors FROM pev LEFT JOIN tall USING (s) GROUP BY s""", *_ALL))


# --- spans -----------------------------------------------------------------------------
def _spans(s, d):
    """Rows with their attributes as sorted ``name=value`` text."""
    out = projection_spans(_projection(s, d))
    cells = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return out.withColumn("attributes", cells).drop("platform")


_ID = "substr(sha256('copilot/' || {0}), 1, 16)"
_UNDER = _ID.format("session_id || '/turn/' || {0}")
_SPANS = f"""pst AS (SELECT CAST(s AS VARCHAR) AS session_id, turn_id, child, iv, status, {_AT.format("(k0 * 16 + CASE WHEN child THEN 1 ELSE 0 END)")} AS start_ts, {_AT.format("(CASE WHEN early THEN last_end ELSE shut END)")} AS end_ts FROM pl WHERE complete AND NOT lost),
    psc AS (SELECT pc.* FROM pc JOIN pst ON pst.turn_id = pc.stored_turn_id),
    psa AS (SELECT o.*, u.input_tokens, u.output_tokens, o.call_id IN (SELECT call_id FROM psc) AS own FROM pown o JOIN pu u USING (session_id, logical_call_id) WHERE o.quarantine IS NULL AND o.ts IS NOT NULL AND um IS NOT NULL),
    prw AS (
    SELECT session_id, {_ID.format("session_id || '/root'")} AS span_id, NULL AS parent_span_id, 'session' AS kind, 'session' AS name, min(start_ts) AS start_ts, max(end_ts) AS end_ts, 'session.id=' || session_id AS attributes FROM pst GROUP BY session_id
    UNION ALL SELECT session_id, {_UNDER.format("turn_id")}, CASE WHEN child THEN {_UNDER.format("replace(turn_id, ':a' || iv, '')")} ELSE {_ID.format("session_id || '/root'")} END, 'turn', 'invoke_agent', start_ts, end_ts,
      'gen_ai.agent.name=copilot|status=' || status || '|turn.id=' || turn_id FROM pst
    UNION ALL SELECT c.session_id, {_ID.format("c.session_id || '/call/' || c.call_id")}, {_ID.format("c.session_id || '/turn/' || c.stored_turn_id")}, 'chat', 'chat ' || c.model, c.start_ts, c.end_ts,
      'gen_ai.response.model=' || c.model || coalesce('|gen_ai.usage.input_tokens=' || a.input_tokens || '|gen_ai.usage.output_tokens=' || a.output_tokens, '') FROM psc c LEFT JOIN (SELECT * FROM psa WHERE own) a ON a.call_id = c.call_id
    UNION ALL SELECT c.session_id, {_ID.format("c.session_id || '/tool/t' || k")}, {_ID.format("c.session_id || '/call/' || c.call_id")}, 'tool', 'execute_tool bash',
      {_AT.format("(k * 16 + CASE WHEN pb.c % 7 <> 0 THEN 3 ELSE 2 END)").replace("- s * 256", "- pb.s * 256")}, CASE WHEN pb.c % 5 <> 0 THEN {_AT.format("(k * 16 + 4)").replace("- s * 256", "- pb.s * 256")} ELSE '' END,
      'gen_ai.operation.name=execute_tool' || CASE WHEN pb.c % 7 <> 0 THEN '|gen_ai.tool.call.arguments={{"cmd":"ls ' || pb.c || '","n":' || k || '}}' ELSE '' END || '|gen_ai.tool.call.id=t' || k
      || CASE WHEN pb.c % 5 <> 0 THEN '|gen_ai.tool.call.result=out ' || pb.c ELSE '' END || '|gen_ai.tool.name=bash' || CASE WHEN pb.c % 7 <> 0 THEN '|schema_hint={{"arguments":"object"}}' ELSE '' END || CASE WHEN pb.c % 5 <> 0 THEN '|success=true' ELSE '' END
      FROM psc c JOIN pb ON pb.k = c.ordinal WHERE asks
    UNION ALL SELECT session_id, {_ID.format("session_id || '/call/accounting:' || coalesce(owner_turn_id, 'session') || ':' || logical_call_id")}, CASE WHEN owner_turn_id IS NULL THEN {_ID.format("session_id || '/root'")} ELSE {_UNDER.format("owner_turn_id")} END, 'accounting', 'accounting',
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'accounting.id=' || logical_call_id || '|accounting.status=' || status || '|gen_ai.usage.input_tokens=' || input_tokens || '|gen_ai.usage.output_tokens=' || output_tokens FROM psa WHERE NOT coalesce(own, false))"""
_add("copilot_spans", _spans, _sql(f"+{_FINAL}, {_SPANS} SELECT *, substr(sha256('copilot/' || session_id), 1, 32) AS trace_id FROM prw", *_ALL))
_add("historical_accounting", lambda s, d: historical_accounting(made := _projection(s, d), made["attributions"].where("cast(session_id as bigint) % 2 = 0")).select("session_id", "accounting_id"), _sql(
    f"""+{_FINAL} SELECT session_id, logical_call_id AS accounting_id FROM pown WHERE (owner_turn_id IS NOT NULL AND quarantine IS NULL AND ts IS NOT NULL AND um IS NOT NULL)
    OR (status IN ('ambiguous', 'conflicting') AND (CAST(session_id AS BIGINT) % 2 = 0 OR stored_turn_id IN (SELECT turn_id FROM pl WHERE complete AND NOT lost)))""", *_ALL))
