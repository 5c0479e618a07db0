"""Readers over log files: the given tables written as session logs, with broken lines among them, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import tags
from spanloom.sources import codex, copilot, tables
from spanloom.sources import star_views as V
from spanloom.sources.jsonl import malformed_lines, read_logs, write_logs
from spanloom.sources.star_views import SQL as VIEW_SQL
from spanloom.sources.star_views import with_views
from spanloom.streaming.jobs import work_folder

QUERIES: dict = {}
ORACLE: dict = {}

P = ["platform", "session_id"]
ISO = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
SHOWN = "yyyy-MM-dd HH:mm:ss"


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def _logs(s, rows: DataFrame, order: str, *, line_sep: str = "\n") -> DataFrame:
    path = work_folder(s, "logs")
    write_logs(rows, path, order, line_sep=line_sep)
    return read_logs(s, path)


def _time(column: str, fmt: str = SHOWN):
    return F.date_format(column, fmt)


# --- usage mirror ----------------------------------------------------------------------
#: A log holds the sessions of a block of orders; its order is order, place, line number.
def _usage_lines(s, d):
    line = (
        "case pos % 11 when 0 then '  ' when 1 then '{\"platform\": \"claude\", ' when 2 then '[1]' else to_json(named_struct("
        " 'platform', platform, 'session_id', session_id, 'call_id', case when pos % 11 = 3 then null else call_id end, 'seq', pos,"
        f" 'ts', case when pos % 13 = 0 then 'soon' else {ISO.format('ts')} end, 'gen_ai.provider.name', provider_name, 'gen_ai.response.model', response_model,"
        " 'gen_ai.operation.name', operation_name, 'gen_ai.usage.input_tokens', input_tokens, 'gen_ai.usage.output_tokens', output_tokens,"
        " 'gen_ai.usage.cache_read.input_tokens', cache_read_input_tokens, 'gen_ai.usage.cache_creation.input_tokens', cache_creation_input_tokens)) end"
    )
    rows = V.usage_raw(s, d).selectExpr(
        "platform", "concat('block-', cast(cast(session_id as bigint) div 8192 as string)) as session_id",
        "((cast(session_id as bigint) % 8192) * 8 + cast(call_id as bigint)) * 1099511627776 + pos % 1099511627776 as at", f"{line} as line",
    )
    return _logs(s, rows, "at")


_USAGE_SHOWN = ["seq", "call_id", "provider_name", "response_model", "operation_name", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
_add(
    "usage_log_rows",
    lambda s, d: tables.usage_rows(_usage_lines(s, d)).select(*P, *_USAGE_SHOWN, _time("ts").alias("ts")),
    with_views(f"""SELECT platform, session_id, pos AS seq, {', '.join(_USAGE_SHOWN[1:])}, CASE WHEN pos % 13 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts
    FROM usage_raw WHERE pos % 11 > 3""".replace("operation_name", "'chat' AS operation_name"), "usage_raw"),
)
_add(
    "usage_log_malformed",
    lambda s, d: malformed_lines(_usage_lines(s, d)).groupBy("platform", "line").agg(F.count("*").alias("n")),
    with_views("""SELECT platform, CASE pos % 11 WHEN 1 THEN '{"platform": "claude", ' ELSE '[1]' END AS line, count(*) AS n FROM usage_raw WHERE pos % 11 IN (1, 2) GROUP BY ALL""", "usage_raw"),
)


# --- tags ------------------------------------------------------------------------------
def _tag_lines(s, d):
    line = (
        "case pos % 9 when 0 then 'add tag-1' when 1 then '' else to_json(named_struct('seq', case when pos % 9 = 2 then null else seq end,"
        " 'tag', case when pos % 9 = 3 then null else tag end, 'op', case when pos % 9 = 4 then null else op end, 'source', source,"
        f" 'at', {ISO.format('at')})) end"
    )
    return _logs(s, V.tag_ops(s, d).selectExpr(*P, "pos as at", f"{line} as line"), "at")


VIEW_SQL["tag_log"] = "SELECT t.*, e.event_type AS source, e.ts AS at_ts FROM tag_ops t JOIN events e ON e.event_id = t.pos WHERE pos % 9 > 4"
_add(
    "tag_log_rows",
    lambda s, d: tables.tag_ops(_tag_lines(s, d)).select(*P, "seq", "tag", "op", "source", _time("at").alias("at")),
    with_views("""SELECT platform, session_id, seq, tag, op, source, strftime(at_ts, '%Y-%m-%d %H:%M:%S') AS "at" FROM tag_log""", "tag_ops", "tag_log"),
)
_add(
    "tag_log_effective",
    lambda s, d: tags.effective_tags(tables.tag_ops(_tag_lines(s, d))).select(*P, "seq", "tag"),
    with_views("""SELECT platform, session_id, seq, tag FROM (SELECT *, row_number() OVER (PARTITION BY platform, session_id, seq, tag ORDER BY pos DESC) AS rn
    FROM tag_log WHERE op IN ('add', 'remove')) WHERE rn = 1 AND op = 'add'""", "tag_ops", "tag_log"),
)


# --- evaluations -----------------------------------------------------------------------
def _eval_lines(s, d):
    finding = "named_struct('seq', f.seq, 'severity', case when pos % 5 = 0 then 'fatal' else f.severity end, 'category', case when pos % 6 = 0 then null else f.category end, 'note', f.note)"
    line = (
        "case pos % 8 when 0 then '{' when 1 then 'null' else to_json(named_struct('id', id, 'session_id', session_id, 'definition', definition,"
        " 'agent', case when pos % 8 = 2 then null else agent end, 'verdict', case when pos % 7 = 0 then upper(verdict) else verdict end,"
        f" 'started_at', {ISO.format('started_at')}, 'duration_ms', case when pos % 3 = 0 then null else pos end,"
        f" 'scores', scores, 'findings', transform(findings, f -> {finding}))) end"
    )
    rows = V.evals(s, d).selectExpr("platform", "concat('block-', cast(pos div 16384 as string)) as session_id", "pos as at", f"{line} as line")
    return _logs(s, rows, "at")


def _eval_log(s, d):
    e = tables.evals(_eval_lines(s, d)).withColumn("n_scores", F.size("scores")).withColumn("overall", F.try_element_at("scores", F.lit("overall")).cast("bigint"))
    e = e.select("id", "platform", "session_id", "definition", "agent", "verdict", "duration_ms", "summary", "overall", "n_scores", _time("started_at").alias("started_at"), F.posexplode("findings").alias("nth", "f"))
    return e.select(*[c for c in e.columns if c != "f"], "f.seq", "f.severity", "f.category", "f.note")


_add("eval_log_findings", _eval_log, with_views(
    """+f AS (SELECT id, 0 AS nth, CASE WHEN pos % 4 = 0 THEN NULL ELSE pos % 8 END AS seq, CASE pos % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' ELSE 'error' END AS severity, 'cat-' || CAST(pos % 5 AS VARCHAR) AS category, id AS note FROM evals
        UNION ALL SELECT id, 1, pos % 5, 'info', 'cat-' || CAST(pos % 7 AS VARCHAR), 'second' FROM evals)
    SELECT e.id, platform, session_id, definition, agent, CASE WHEN pos % 7 = 0 THEN 'unknown' ELSE verdict END AS verdict, CASE WHEN pos % 3 = 0 THEN 0 ELSE pos END AS duration_ms, '' AS summary,
    pos % 100 AS overall, 2 AS n_scores, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, nth, f.seq, CASE WHEN pos % 5 = 0 THEN 'info' ELSE severity END AS severity,
    CASE WHEN pos % 6 = 0 THEN '' ELSE category END AS category, note FROM evals e JOIN f USING (id) WHERE pos % 8 > 2""", "evals"))


# --- errors ----------------------------------------------------------------------------
def _error_lines(s, d):
    line = (
        "case k % 6 when 0 then 'Traceback (most recent call last):' when 1 then '' else to_json(named_struct("
        f" 'ts', {ISO.format('ts')}, 'level', case when is_error then 'error' else 'warning' end, 'platform', platform, 'session_id', session_id,"
        " 'phase', concat('phase-', cast(v % 3 as string)), 'error_class', 'ValueError', 'message', concat('m', cast(seq as string)))) end"
    )
    return _logs(s, V.events(s, d).selectExpr("'all' as platform", "'errors' as session_id", "seq as at", f"{line} as line"), "at")


def _last_errors(s, d):
    errors = tables.capture_errors(_error_lines(s, d))
    first = V.table(s, d, "events").agg(F.min("ts")).head()[0]
    found = tables.last_errors(errors, 25, platform="codex", phase="phase-1", since=first)
    return found.select(_time("ts").alias("ts"), "level", *P, "phase", "error_class", "message")


_add("error_log_last", _last_errors, with_views(
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN is_error THEN 'error' ELSE 'warning' END AS level, platform, session_id, 'phase-1' AS phase, 'ValueError' AS error_class,
    'm' || CAST(seq AS VARCHAR) AS message FROM ev WHERE k % 6 > 1 AND v % 3 = 1 AND platform = 'codex' ORDER BY seq DESC LIMIT 25""", "ev"))


# --- event logs up to the first unreadable record --------------------------------------
def _event_lines(s, d):
    line = (
        "case when (k * 31 + v) % 199 = 7 then concat('{\"seq\": ', cast(seq as string)) when k % 9 = 1 then '' else"
        f" to_json(named_struct('seq', case when k % 9 = 2 then null else seq end, 't', t, 'ts', {ISO.format('ts')}, 'data', named_struct('v', v))) end"
    )
    return _logs(s, V.events(s, d).selectExpr(*P, "seq as at", f"{line} as line"), "at")


_BROKEN = "cut AS (SELECT platform, session_id, min(seq) AS broken FROM ev WHERE (k * 31 + v) % 199 = 7 GROUP BY ALL)"
_add(
    "event_log_readable",
    lambda s, d: tables.events(tables.until_broken(_event_lines(s, d))).select(*P, "seq", "t", _time("ts").alias("ts"), F.to_json("data").alias("data")),
    with_views(f"""+{_BROKEN} SELECT platform, session_id, seq, t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, '{{"v":' || CAST(v AS VARCHAR) || '}}' AS data
    FROM ev LEFT JOIN cut USING (platform, session_id) WHERE (broken IS NULL OR seq < broken) AND k % 9 NOT IN (1, 2)""", "ev"),
)
_add(
    "event_log_truncated",
    lambda s, d: tables.truncated_sessions(_event_lines(s, d)).select(*P),
    with_views(f"+{_BROKEN} SELECT platform, session_id FROM cut", "ev"),
)


# --- transcripts and rollouts, whose last line is still being written --------------------
#: The rows carry their own newline and a space divides them, so the last line of a log can lack its newline.
def _open_lines(s, d, line: str):
    ev = V.events(s, d)
    last = ev.groupBy(*P).agg(F.max("seq").alias("last"))
    rows = ev.join(last, P).selectExpr(*P, "seq as at", f"concat({line}, case when seq = last then '' else '\\n' end) as line")
    return _logs(s, rows, "at", line_sep=" ")


_TRANSCRIPT = (
    "case k % 10 when 0 then '{\"id\": broken' when 1 then '[1, 2]' when 2 then to_json(named_struct('type', t, 'timestamp', {iso}))"
    " when 3 then to_json(named_struct('id', concat('e', cast(seq as string)), 'timestamp', 'soon')) when 4 then to_json(named_struct('id', '', 'type', t))"
    " else to_json(named_struct('id', concat('e', cast(seq as string)), 'timestamp', {iso}, 'type', t)) end"
).replace("{iso}", ISO.format("ts"))
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
VIEW_SQL["tline"] = f"""SELECT platform, session_id, seq, k, {_STAMP} AS stamp, CASE WHEN row_number() OVER w > 1 THEN ' ' ELSE '' END || CASE k % 10 WHEN 0 THEN '{{"id": broken' WHEN 1 THEN '[1, 2]'
    WHEN 2 THEN '{{"type":"' || t || '","timestamp":"' || {_STAMP} || '"}}' WHEN 3 THEN '{{"id":"e' || CAST(seq AS VARCHAR) || '","timestamp":"soon"}}' WHEN 4 THEN '{{"id":"","type":"' || t || '"}}'
    ELSE '{{"id":"e' || CAST(seq AS VARCHAR) || '","timestamp":"' || {_STAMP} || '","type":"' || t || '"}}' END AS line, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq DESC) = 1 AS open
    FROM ev WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq)"""
VIEW_SQL["trec"] = """SELECT *, CASE k % 10 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'non_object_json' END AS malformed, length(line) + 1 AS byte_length,
    sum(length(line) + 1) OVER (PARTITION BY platform, session_id ORDER BY seq) - length(line) - 1 AS byte_offset FROM tline WHERE NOT open"""


def _transcript(s, d):
    return copilot.transcript_records(_open_lines(s, d, _TRANSCRIPT), F.lit("transcript"), F.lit("g1"), F.lit("2026-01-01T00:00:00Z"))


_SOURCE = """'transcript/' || session_id || '/' || CASE WHEN k % 10 IN (0, 1, 2, 4) THEN 'g1/' || CAST(CAST(byte_offset AS BIGINT) AS VARCHAR) || '/' || sha256(line) ELSE 'e' || CAST(seq AS VARCHAR) END"""
_add(
    "transcript_records",
    lambda s, d: _transcript(s, d).select(*P, "source_id", "native_session_id", "ts", "malformed", "bad_ts", "raw", F.col("byte_offset").cast("bigint").alias("byte_offset"), F.col("byte_length").cast("bigint").alias("byte_length")),
    with_views(f"""SELECT platform, session_id, {_SOURCE} AS source_id, session_id AS native_session_id, CASE WHEN k % 10 = 2 OR k % 10 > 4 THEN stamp END AS ts, malformed, k % 10 = 3 AS bad_ts,
    CASE WHEN malformed IS NOT NULL THEN to_base64(encode(line)) END AS raw, CAST(byte_offset AS BIGINT) AS byte_offset, byte_length FROM trec""", "ev", "tline", "trec"),
)
_add(
    "transcript_diagnostics",
    lambda s, d: copilot.transcript_diagnostics(_transcript(s, d)).select(*P, "code", "source_id"),
    with_views(f"""SELECT platform, session_id, CASE k % 10 WHEN 0 THEN 'transcript_invalid_json' WHEN 1 THEN 'transcript_non_object' ELSE 'transcript_invalid_timestamp' END AS code, {_SOURCE} AS source_id
    FROM trec WHERE k % 10 IN (0, 1, 3)""", "ev", "tline", "trec"),
)
_add(
    "rollout_frames",
    lambda s, d: codex.rollout_frames(_open_lines(s, d, _TRANSCRIPT)).select(*P, F.col("byte_offset").cast("bigint").alias("byte_offset"), F.to_json("frame").alias("frame")),
    with_views("""SELECT platform, session_id, CAST(byte_offset AS BIGINT) AS byte_offset, CASE WHEN k % 10 = 2 THEN '{"timestamp":"' || stamp || '","type":' || substr(trim(line), 9, strpos(trim(line), ',') - 9) || '}' ELSE trim(line) END AS frame
    FROM trec WHERE malformed IS NULL""", "ev", "tline", "trec"),
)


# --- hook observations -----------------------------------------------------------------
def _hooks(s, d):
    payload = (
        "try_parse_json(concat('{', case when k % 7 = 0 then '' when k % 7 = 1 then '\"sessionId\":\"\",' else concat('\"sessionId\":\"', session_id, '\",') end,"
        f" '\"timestamp\":', case k % 5 when 0 then concat('\"', {ISO.format('ts')}, '\"') when 1 then cast(unix_millis(ts_) as string) when 2 then cast(unix_seconds(ts_) as string)"
        " when 3 then 'true' else '\"soon\"' end, '}'))"
    )
    rows = V.events(s, d).withColumn("ts_", F.col("ts").cast("timestamp")).selectExpr(
        f"{payload} as payload", "case t when 'user_message' then 'UserPromptSubmit' when 'tool_call' then 'PreToolUse' when 'assistant_message' then 'Stop' else 'other' end as event",
        "try_parse_json(concat('{\"env\":{\"A\":\"', cast(v as string), '\"},\"cwd\":\"/p\"}')) as context", "cast(seq as string) as observation_id", "'2026-01-01T00:00:00Z' as observed_at",
    )
    return tables.hook_records(rows).select("source_id", "source_kind", "native_session_id", "ts", "observed_at", "event", "context", "observation_id")


_add("hook_records", _hooks, with_views(
    f"""SELECT 'hook/' || session_id || '/' || CAST(seq AS VARCHAR) AS source_id, 'hook' AS source_kind, session_id AS native_session_id,
    CASE k % 5 WHEN 0 THEN {_STAMP} WHEN 1 THEN {_STAMP} WHEN 2 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS ts, '2026-01-01T00:00:00Z' AS observed_at,
    CASE t WHEN 'user_message' THEN 'userPromptSubmitted' WHEN 'tool_call' THEN 'preToolUse' WHEN 'assistant_message' THEN 'agentStop' ELSE 'other' END AS event,
    '{{"env":{{"A":"' || CAST(v AS VARCHAR) || '"}}}}' AS context, CAST(seq AS VARCHAR) AS observation_id FROM ev WHERE k % 7 > 1""", "ev"))


# --- exported cases --------------------------------------------------------------------
def _exported(s, d):
    out = work_folder(s, "export")
    # Every seventh session of the catalog has no events left.
    rows = V.events(s, d).where("cast(session_id as bigint) % 7 > 0").select(*P, "seq", "t", "event_text")
    tables.export_cases(V.sessions(s, d), rows, out, per_part=100)
    cases = s.read.schema("platform string, session_id string, status string, n_events bigint").json(f"{out}/cases")
    parts = s.read.schema("platform string, session_id string, part bigint, events array<struct<seq bigint, t string, event_text string>>").json(f"{out}/parts")
    per = parts.select(*P, "part", F.explode("events").alias("e")).groupBy(*P, "part").agg(F.min("e.seq").alias("first_seq"), F.max("e.seq").alias("last_seq"), F.count("*").alias("in_part"), F.min_by("e.event_text", "e.seq").alias("first_text"))
    return cases.join(per, P, "left")


_add("export_cases", _exported, with_views(
    """+n AS (SELECT platform, session_id, seq, event_text, (row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) - 1) // 100 AS part FROM ev WHERE CAST(session_id AS BIGINT) % 7 > 0),
    p AS (SELECT platform, session_id, part, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS in_part, arg_min(event_text, seq) AS first_text FROM n GROUP BY ALL)
    SELECT s.platform, s.session_id, status, CASE WHEN CAST(s.session_id AS BIGINT) % 7 > 0 THEN event_count ELSE 0 END AS n_events, part, first_seq, p.last_seq, in_part, first_text FROM sessions s LEFT JOIN p USING (platform, session_id)""", "sessions"))


# --- replies with a fenced result ------------------------------------------------------
def _envelopes(s, d):
    body = "case seq % 5 when 0 then concat('{\"verdict\": \"pass\", \"n\": ', cast(seq as string), '}') when 1 then '{\"verdict\": }' when 2 then '{}' end"
    rows = V.documents(s, d).selectExpr("seq", "event_text as said", f"case when seq % 5 < 3 then concat('Report ', cast(seq as string), '\\n```json\\n', {body}, '\\n```\\n', 'After.') else concat('Plain ', cast(seq as string)) end as reply")
    return rows.select("seq", F.length("said").cast("bigint").alias("n_said"), F.to_json(X.envelope_json(F.col("reply"))).alias("envelope"), X.envelope_narrative(F.col("reply")).alias("narrative"))


_add("parse_envelope", _envelopes, """WITH r AS (SELECT doc_id AS seq, length(text) AS n_said, CAST(doc_id AS VARCHAR) AS i FROM documents)
    SELECT seq, n_said, CASE seq % 5 WHEN 0 THEN '{"n":' || i || ',"verdict":"pass"}' WHEN 2 THEN '{}' END AS envelope,
    CASE seq % 5 WHEN 0 THEN 'Report ' || i || chr(10) || chr(10) || 'After.' WHEN 2 THEN 'Report ' || i || chr(10) || chr(10) || 'After.'
    WHEN 1 THEN 'Report ' || i || chr(10) || '```json' || chr(10) || '{"verdict": }' || chr(10) || '```' || chr(10) || 'After.' ELSE 'Plain ' || i END AS narrative FROM r""")
