"""Queries over usage, catalog, tags, search, turns, evaluations and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions.ordered import number, number_by
from spanloom.operators import catalog, evals, pairing, review, search, tags, turns, usage
from spanloom.sources import star_views as V
from spanloom.sources.star_views import with_views

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_STAMP = "%Y-%m-%d %H:%M:%S.%f"
SINCE, UNTIL = "1996-01-01 00:00:00", "1998-06-30 00:00:00"


def _calls(s, d):
    return usage.dedup_calls(V.usage_raw(s, d))


def _stamp(name):
    return F.date_format(name, STAMP).alias(name)


def _live(s, d):
    return tags.effective_tags(V.tag_ops(s, d))


def _prompt_events(s, d):
    return turns.turn_events(V.events(s, d), marker_platforms=())


CALL_COLS = [
    "platform", "session_id", "call_id", "pos", "response_model", "input_tokens", "output_tokens", "cache_read_input_tokens",
    "cache_creation_input_tokens",
]
TURN_SQL = """, marked AS (SELECT *, count(*) FILTER (WHERE t = 'user_message') OVER w AS turn_no,
    max(CASE WHEN t = 'user_message' THEN seq END) OVER w AS opened,
    max(CASE WHEN t = 'assistant_message' THEN seq END) OVER (PARTITION BY platform, session_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS replied
    FROM {src} WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    te AS (SELECT * FROM marked WHERE turn_no > 0 AND (replied IS NULL OR replied < opened)),
    tu AS (SELECT platform, session_id, turn_no, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS events,
        CAST(min(seq) AS VARCHAR) AS turn_id, session_id || ':' || CAST(min(seq) AS VARCHAR) AS id
        FROM te GROUP BY platform, session_id, turn_no)"""

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


# --- usage -----------------------------------------------------------------------------
_add("dedup_calls", lambda s, d: _calls(s, d).select(*CALL_COLS, "first_pos"), with_views(
    f"SELECT {', '.join('c.' + x for x in CALL_COLS)}, f.first_pos FROM usage_calls c JOIN (SELECT platform, session_id, call_id, min(pos) AS first_pos "
    "FROM usage_raw GROUP BY ALL) f USING (platform, session_id, call_id)", "usage_calls"))
_add("call_totals", lambda s, d: usage.call_totals(_calls(s, d)), with_views(
    "SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage_calls", "usage_calls"))
_DAYS = """, d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT platform || session_id) AS sessions, count(*) AS events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage_calls {where} GROUP BY 1),
    cal AS (SELECT CAST(unnest(generate_series({lo}, {hi}, INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT CAST(day AS VARCHAR) AS day, coalesce(sessions, 0) AS sessions, coalesce(events, 0) AS events, coalesce(input_tokens, 0) AS input_tokens,
    coalesce(output_tokens, 0) AS output_tokens, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS total_tokens FROM cal LEFT JOIN d USING (day)"""


def _day_text(df):
    return df.withColumn("day", F.col("day").cast("string"))


_add("usage_by_day", lambda s, d: _day_text(usage.usage_by_day(_calls(s, d))), with_views("+" + _DAYS.format(
    where="", lo="(SELECT CAST(min(day) AS TIMESTAMP) FROM d)", hi="(SELECT CAST(max(day) AS TIMESTAMP) FROM d)").lstrip(", "), "usage_calls"))
_add("usage_by_day_bounded", lambda s, d: _day_text(usage.usage_by_day(_calls(s, d), platform="codex", since=SINCE, until=UNTIL)), with_views("+" + _DAYS.format(
    where=f"WHERE platform = 'codex' AND ts >= TIMESTAMP '{SINCE}' AND ts <= TIMESTAMP '{UNTIL}'", lo=f"TIMESTAMP '{SINCE}'", hi=f"TIMESTAMP '{UNTIL}'").lstrip(", "), "usage_calls"))
_add("usage_totals", lambda s, d: usage.usage_totals(_calls(s, d)), with_views(
    """SELECT count(DISTINCT platform || session_id) AS sessions, count(*) AS events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM usage_calls""", "usage_calls"))
_ROLL = """SELECT platform, session_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM usage_calls {where} GROUP BY platform, session_id"""
_add("usage_rollup", lambda s, d: usage.usage_rollup(_calls(s, d)), with_views(_ROLL.format(where=""), "usage_calls"))
_add("usage_filter", lambda s, d: usage.usage_rollup(usage.usage_filter(_calls(s, d), platform="claude", model="-F", since=SINCE, until=UNTIL)), with_views(
    _ROLL.format(where=f"WHERE platform = 'claude' AND contains(response_model, '-F') AND ts >= TIMESTAMP '{SINCE}' AND ts <= TIMESTAMP '{UNTIL}'"), "usage_calls"))
_add("top_sessions", lambda s, d: usage.top_sessions(usage.usage_rollup(_calls(s, d)), 20), with_views(
    _ROLL.format(where="") + " ORDER BY total_tokens DESC, platform, session_id LIMIT 20", "usage_calls"))
_add("top_sessions_by_id", lambda s, d: usage.top_sessions(usage.usage_rollup(_calls(s, d)), 20, "ts"), with_views(
    _ROLL.format(where="") + " ORDER BY session_id, platform LIMIT 20", "usage_calls"))
_add("session_usage", lambda s, d: usage.with_total(usage.session_usage(_calls(s, d), "1", "output")).select(*CALL_COLS, "total_tokens"), with_views(
    f"SELECT {', '.join(CALL_COLS)}, input_tokens + output_tokens AS total_tokens FROM usage_calls WHERE session_id = '1'", "usage_calls"))
_add("session_calls_sorted", lambda s, d: number_by(
    usage.with_total(_calls(s, d)), ["platform", "session_id"], -F.col("total_tokens"), [F.col("total_tokens").desc(), F.col("first_pos")], "rank").select(
    "platform", "session_id", "call_id", "total_tokens", "rank"), with_views(
    """SELECT c.platform, c.session_id, c.call_id, input_tokens + output_tokens AS total_tokens, row_number() OVER (PARTITION BY c.platform, c.session_id
    ORDER BY input_tokens + output_tokens DESC, first_pos) - 1 AS rank FROM usage_calls c JOIN (SELECT platform, session_id, call_id, min(pos) AS first_pos
    FROM usage_raw GROUP BY ALL) USING (platform, session_id, call_id)""", "usage_calls"))
_add("usage_summary", lambda s, d: usage.usage_summary(_calls(s, d)), with_views(
    """+f AS (SELECT c.*, fp.first_pos FROM usage_calls c JOIN (SELECT platform, session_id, call_id, min(pos) AS first_pos FROM usage_raw GROUP BY ALL) fp
    USING (platform, session_id, call_id)), m AS (SELECT platform, session_id, response_model, count(*) AS n, min(first_pos) AS seen, sum(input_tokens) AS i, sum(output_tokens) AS o FROM f GROUP BY ALL)
    SELECT platform, session_id, CAST(sum(n) AS BIGINT) AS turns, string_agg(response_model || ' (' || CAST(n AS VARCHAR) || ' turns)', ', ' ORDER BY n DESC, seen) AS models,
    CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i) + sum(o) AS BIGINT) AS total_tokens FROM m GROUP BY platform, session_id""", "usage_calls"))
_add("cache_hit_ratio", lambda s, d: usage.cache_hit_ratio(_calls(s, d), ["platform"]).withColumn("cache_hit_ratio", F.round("cache_hit_ratio", 6)), with_views(
    """+g AS (SELECT platform, CAST(sum(input_tokens - coalesce(cache_read_input_tokens, 0) - coalesce(cache_creation_input_tokens, 0)) AS BIGINT) AS fresh_input,
    CAST(sum(coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS cached_read, CAST(sum(coalesce(cache_creation_input_tokens, 0)) AS BIGINT) AS cache_write,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage_calls GROUP BY platform)
    SELECT *, round(cached_read / CAST(fresh_input + cached_read + 0.0001 AS DOUBLE), 6) AS cache_hit_ratio FROM g""", "usage_calls"))
_add("token_spikes", lambda s, d: usage.token_spikes(_calls(s, d), output_over=80000, input_over=4800).select(
    "platform", "session_id", "call_id", "input_tokens", "output_tokens", "prev_call_id"), with_views(
    """+f AS (SELECT c.*, fp.first_pos FROM usage_calls c JOIN (SELECT platform, session_id, call_id, min(pos) AS first_pos FROM usage_raw GROUP BY ALL) fp
    USING (platform, session_id, call_id)), p AS (SELECT *, lag(call_id) OVER (PARTITION BY platform, session_id ORDER BY first_pos) AS prev_call_id FROM f)
    SELECT platform, session_id, call_id, input_tokens, output_tokens, prev_call_id FROM p WHERE output_tokens > 80000 OR input_tokens > 4800""", "usage_calls"))


def _prices(s, d):
    """One price row per model in use, derived from the calls."""
    return V.usage_raw(s, d).where("response_model <> 'R-F'").groupBy("response_model").agg(
        (F.min("input_tokens") / 100).alias("input_price"), F.lit(15.0).alias("output_price"), F.lit(0.25).alias("read_price"),
        F.lit(3.75).alias("write_price"))


_add("price_calls", lambda s, d: usage.price_calls(_calls(s, d), _prices(s, d)).select(
    "platform", "session_id", "call_id", F.floor(F.col("cost") * 1000000).alias("cost_micros")), with_views(
    """+pr AS (SELECT response_model, CAST(min(input_tokens) AS DOUBLE) / 100 AS ip FROM usage_raw WHERE response_model <> 'R-F' GROUP BY 1),
    c AS (SELECT *, coalesce(cache_read_input_tokens, 0) AS r, coalesce(cache_creation_input_tokens, 0) AS w FROM usage_calls)
    SELECT platform, session_id, call_id, CAST(floor((((input_tokens - r - w) * ip + output_tokens * CAST(15.0 AS DOUBLE) + r * CAST(0.25 AS DOUBLE) + w * CAST(3.75 AS DOUBLE)) / 1000000) * 1000000) AS BIGINT) AS cost_micros
    FROM c LEFT JOIN pr USING (response_model)""", "usage_calls"))
_add("turn_model", lambda s, d: usage.turn_model(_calls(s, d), ["platform", "session_id"], "first_pos"), with_views(
    """+f AS (SELECT c.platform, c.session_id, c.response_model, fp.first_pos FROM usage_calls c JOIN (SELECT platform, session_id, call_id, min(pos) AS first_pos FROM usage_raw GROUP BY ALL) fp
    USING (platform, session_id, call_id)), m AS (SELECT platform, session_id, response_model, count(*) AS n, min(first_pos) AS seen FROM f GROUP BY ALL)
    SELECT platform, session_id, arg_max(response_model, n * 100000000000000000 - seen) AS model, CAST(sum(n) AS BIGINT) AS calls FROM m GROUP BY platform, session_id""".replace(
        "arg_max(response_model, n * 100000000000000000 - seen)", "first(response_model ORDER BY n DESC, seen)"), "usage_calls"))


def _label_rows(s, d):
    return V.table(s, d, "lineitem").groupBy(
        F.expr("element_at(array('claude','codex','copilot','cursor'), cast(l_orderkey % 4 + 1 as int))").alias("platform"),
        F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_linenumber").cast("string").alias("call_id"),
    ).agg(F.max("l_partkey").alias("total_nano_aiu"), F.min("l_suppkey").alias("duration_ms")).where("duration_ms % 3 <> 0")


_add("usage_labels", lambda s, d: usage.usage_labels(_calls(s, d), _label_rows(s, d)).select(
    "platform", "session_id", "call_id", "input_tokens", "total_nano_aiu", "duration_ms"), with_views(
    """+n AS (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CAST(l_linenumber AS VARCHAR) AS call_id, max(l_partkey) AS total_nano_aiu, min(l_suppkey) AS duration_ms
    FROM lineitem GROUP BY 1, 2 HAVING min(l_suppkey) % 3 <> 0)
    SELECT platform, session_id, call_id, input_tokens, total_nano_aiu, duration_ms FROM usage_calls LEFT JOIN n USING (session_id, call_id)""", "usage_calls"))


def _upserted(s, d):
    raw = V.usage_raw(s, d)
    old = usage.dedup_calls(raw.where("pos % 2 = 0"))
    shrunk = raw.where("pos % 11 = 0").select("platform", "session_id").distinct()
    return usage.reload_sessions(old.select(*raw.columns), raw.where("pos % 2 = 1"), shrunk)


_add("usage_upsert", lambda s, d: _upserted(s, d).select(*CALL_COLS), with_views(
    f"""+sh AS (SELECT DISTINCT platform, session_id FROM usage_raw WHERE pos % 11 = 0),
    k AS (SELECT * FROM usage_raw WHERE pos % 2 = 1 UNION ALL SELECT u.* FROM usage_raw u ANTI JOIN sh USING (platform, session_id) WHERE pos % 2 = 0)
    SELECT {', '.join(CALL_COLS)} FROM k QUALIFY row_number() OVER (PARTITION BY platform, session_id, call_id ORDER BY pos DESC) = 1""", "usage_raw"))
_add("platform_union", lambda s, d: _union(s, d), with_views(
    "SELECT 'usage' AS kind, platform, count(*) AS n FROM usage_raw GROUP BY 2 UNION ALL SELECT 'event', platform, count(*) FROM ev GROUP BY 2 UNION ALL SELECT 'chat', platform, count(*) FROM chat GROUP BY 2",
    "usage_raw", "ev", "chat"))


def _union(s, d):
    parts = [
        V.usage_raw(s, d).select(F.lit("usage").alias("kind"), "platform", "call_id"),
        V.events(s, d).select(F.lit("event").alias("kind"), "platform", "tool_use_id"),
        V.chat_events(s, d).select(F.lit("chat").alias("kind"), "platform"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy("kind", "platform").agg(F.count(F.lit(1)).alias("n"))


# --- catalog ---------------------------------------------------------------------------
_SESS = ["platform", "session_id", "cwd", "status", "event_count", "last_seq"]
_add("read_sessions", lambda s, d: V.sessions(s, d).select(*_SESS, _stamp("started_at"), _stamp("last_ts")), with_views(
    f"SELECT {', '.join(_SESS)}, strftime(started_at, '{DUCK_STAMP}') AS started_at, strftime(last_ts, '{DUCK_STAMP}') AS last_ts FROM sessions", "sessions"))
_add("list_sessions", lambda s, d: catalog.list_sessions(
    V.sessions(s, d), platform="codex", status="open", since="2024-01-30 12:00:00", until="2024-01-01 20:00:00").select(*_SESS), with_views(
    f"""SELECT {', '.join(_SESS)} FROM sessions WHERE platform = 'codex' AND status = 'open' AND coalesce(last_ts, started_at) >= TIMESTAMP '2024-01-30 12:00:00'
    AND started_at <= TIMESTAMP '2024-01-01 20:00:00'""", "sessions"))
_add("list_sessions_by_cwd", lambda s, d: catalog.list_sessions(V.sessions(s, d), cwd="/p/.workbench/x/task-3").select(*_SESS), with_views(
    f"SELECT {', '.join(_SESS)} FROM sessions WHERE cwd = '/p/.workbench/x/task-3'", "sessions"))
_add("sessions_with_tags", lambda s, d: catalog.sessions_with_tags(V.sessions(s, d), _live(s, d), ["tag-0", "tag-3", "tag-4"]).select(*_SESS), with_views(
    f"SELECT {', '.join(_SESS)} FROM sessions WHERE (platform, session_id) IN (SELECT (platform, session_id) FROM live_tags WHERE tag IN ('tag-0','tag-3','tag-4') GROUP BY platform, session_id HAVING count(DISTINCT tag) = 3)".replace(
        "(platform, session_id) IN (SELECT (platform, session_id)", "platform || session_id IN (SELECT platform || session_id"), "sessions", "live_tags"))
_add("resolve_prefix", lambda s, d: catalog.resolve_prefixes(
    V.sessions(s, d), V.table(s, d, "events").selectExpr("cast(cast(floor(value) as bigint) as string) as prefix").distinct()), with_views(
    """+p AS (SELECT DISTINCT CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS prefix FROM events),
    m AS (SELECT prefix, count(*) AS matches, min(platform) AS platform, min(session_id) AS session_id FROM p JOIN sessions ON starts_with(session_id, prefix) GROUP BY prefix)
    SELECT prefix, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN platform END AS platform, CASE WHEN matches = 1 THEN session_id END AS session_id FROM p LEFT JOIN m USING (prefix)""", "sessions"))
_add("suggest_sessions", lambda s, d: catalog.suggest_sessions(V.sessions(s, d), "1").select(*_SESS), with_views(
    f"SELECT {', '.join(_SESS)} FROM sessions WHERE starts_with(session_id, '1') ORDER BY platform, session_id LIMIT 10", "sessions"))
_add("newest_sessions", lambda s, d: catalog.newest_sessions(V.sessions(s, d)).select(*_SESS), with_views(
    f"SELECT {', '.join(_SESS)} FROM sessions ORDER BY started_at DESC, platform, session_id", "sessions"))
_add("store_stats", lambda s, d: catalog.store_stats(V.sessions(s, d)), with_views(
    "SELECT count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM sessions", "sessions"))
_add("vocabulary", lambda s, d: catalog.vocabulary(V.sessions(s, d), _live(s, d)), with_views(
    """SELECT DISTINCT 'platform' AS kind, platform AS value, CAST(0 AS BIGINT) AS weight FROM sessions
    UNION ALL SELECT * FROM (SELECT 'cwd', cwd, CAST(0 AS BIGINT) FROM sessions GROUP BY cwd ORDER BY max(platform || chr(1) || session_id) DESC LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'tag', tag, count(DISTINCT platform || session_id) AS w FROM live_tags GROUP BY tag ORDER BY w DESC, tag LIMIT 50)""", "sessions", "live_tags"))
_add("recent_cwds", lambda s, d: catalog.recent_cwds(V.sessions(s, d), 20), with_views(
    """SELECT cwd, last(platform ORDER BY platform, session_id) AS platform, last(session_id ORDER BY platform, session_id) AS session_id
    FROM sessions GROUP BY cwd ORDER BY max(platform || chr(1) || session_id) DESC LIMIT 20""", "sessions"))
_add("top_tags", lambda s, d: catalog.top_tags(_live(s, d), 50), with_views(
    "SELECT tag, count(DISTINCT platform || session_id) AS sessions FROM live_tags GROUP BY tag ORDER BY sessions DESC, tag LIMIT 50", "live_tags"))
_add("cohort", lambda s, d: catalog.cohort(V.sessions(s, d), more_than=60, cwd_like=r"/\.workbench/.+/task-").select(*_SESS), with_views(
    f"SELECT {', '.join(_SESS)} FROM sessions WHERE event_count > 60 AND regexp_matches(cwd, '/\\.workbench/.+/task-')", "sessions"))

# --- tags ------------------------------------------------------------------------------
_add("effective_tags", lambda s, d: _live(s, d), with_views("SELECT platform, session_id, seq, tag FROM live_tags", "live_tags"))
_add("tag_inventory", lambda s, d: tags.tag_inventory(_live(s, d)), with_views(
    "SELECT tag, count(*) AS events, count(DISTINCT platform || session_id) AS sessions FROM live_tags GROUP BY tag", "live_tags"))
_add("tagged_seq_count", lambda s, d: tags.tagged_seq_count(_live(s, d)), with_views(
    "SELECT platform, session_id, count(DISTINCT seq) AS tagged FROM live_tags GROUP BY ALL", "live_tags"))
_add("inventory_tags", lambda s, d: tags.inventory_tags(_live(s, d)), with_views("SELECT DISTINCT tag FROM live_tags", "live_tags"))


def _twenty(s, d):
    """Events numbered per session and folded onto the 20 anchors of the tag log."""
    return number(V.events(s, d), ["platform", "session_id"], "seq", "n").withColumnRenamed("seq", "event_seq").withColumn("seq", F.col("n") % 20)


_TWENTY = "tw AS (SELECT *, seq AS event_seq, (row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) - 1) % 20 AS anchor FROM ev)"
_add("events_with_tags", lambda s, d: tags.events_with_tags(_twenty(s, d), _live(s, d)).select("platform", "session_id", "event_seq", "t", "tag"), with_views(
    f"+{_TWENTY} SELECT tw.platform, tw.session_id, tw.event_seq, tw.t, l.tag FROM tw JOIN live_tags l ON l.platform = tw.platform AND l.session_id = tw.session_id AND l.seq = tw.anchor", "ev", "live_tags"))

# --- events and search -----------------------------------------------------------------
_EV = ["platform", "session_id", "seq", "t", "tool_name"]
_add("scan_events", lambda s, d: search.scan_events(V.events(s, d), types=["tool_call", "tool_result"], first=100, before=7000).select(*_EV), with_views(
    f"SELECT {', '.join(_EV)} FROM ev WHERE t IN ('tool_call', 'tool_result') AND seq >= 100 AND seq < 7000", "ev"))


def _one_event(s, d):
    """Event 3 of every session, with one field read from its payload."""
    ev = number(V.events(s, d), ["platform", "session_id"], "seq", "n").where("n = 3")
    return ev.select("platform", "session_id", "n", search.event_field("tool_name").alias("tool_name"))


_add("get_event", _one_event, with_views(
    "SELECT platform, session_id, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) - 1 AS n, tool_name FROM ev QUALIFY n = 3", "ev"))
_add("tail", lambda s, d: search.tail(V.events(s, d), 5).select(*_EV, "from_end"), with_views(
    f"SELECT {', '.join(_EV)}, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq DESC) AS from_end FROM ev QUALIFY from_end <= 5", "ev"))
_SNIP = """CASE WHEN strpos(lower(event_text), '{q}') = 0 THEN substr(event_text, 1, 80) ELSE
    CASE WHEN strpos(lower(event_text), '{q}') - 40 > 1 THEN '…' ELSE '' END ||
    substr(event_text, greatest(strpos(lower(event_text), '{q}') - 40, 1), least(strpos(lower(event_text), '{q}') + {n} + 40, length(event_text) + 1) - greatest(strpos(lower(event_text), '{q}') - 40, 1)) ||
    CASE WHEN strpos(lower(event_text), '{q}') + {n} + 40 <= length(event_text) THEN '…' ELSE '' END END AS snippet"""


def _snip(q):
    return _SNIP.format(q=q, n=len(q))


_add("search_events", lambda s, d: search.search_events(
    V.events(s, d), 'Name":"GREP', sessions=V.sessions(s, d), platform="codex", since="2024-01-29 00:00:00"), with_views(
    f"""SELECT platform, session_id, seq, t, {_snip('name":"grep')} FROM ev WHERE contains(lower(event_text), 'name":"grep') AND platform = 'codex'
    AND session_id IN (SELECT session_id FROM sessions WHERE platform = 'codex' AND coalesce(last_ts, started_at) >= TIMESTAMP '2024-01-29 00:00:00')""", "ev", "sessions"))
_add("search_event_window", lambda s, d: search.search_events(
    V.events(s, d), "bash", event_since="2024-01-10 00:00:00", event_until="2024-01-20 00:00:00"), with_views(
    f"""SELECT platform, session_id, seq, t, {_snip('bash')} FROM ev WHERE contains(lower(event_text), 'bash') AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""", "ev"))
_add("search_documents", lambda s, d: search.search_events(V.documents(s, d), "The "), f"""WITH ev AS (SELECT source AS platform, CAST(doc_id AS VARCHAR) AS session_id, doc_id AS seq, 'user_message' AS t, text AS event_text FROM documents)
    SELECT platform, session_id, seq, t, {_snip('the ')} FROM ev WHERE contains(lower(event_text), 'the ')""")
_add("search_chat", lambda s, d: search.search_events(V.chat_events(s, d), "Tion"), with_views(
    f"SELECT platform, session_id, seq, t, {_snip('tion')} FROM chat WHERE contains(lower(event_text), 'tion')", "chat"))
_add("search_tagged", lambda s, d: search.search_events(
    _twenty(s, d), "read", live_tags=_live(s, d), tags=["tag-0", "tag-1"]).groupBy("platform", "session_id", "seq").agg(F.count(F.lit(1)).alias("hits")), with_views(
    f"""+{_TWENTY}, both_tags AS (SELECT platform, session_id, seq AS anchor FROM live_tags WHERE tag IN ('tag-0', 'tag-1') GROUP BY ALL HAVING count(DISTINCT tag) = 2)
    SELECT platform, session_id, anchor AS seq, count(*) AS hits FROM tw SEMI JOIN both_tags USING (platform, session_id, anchor) WHERE contains(lower(event_text), 'read') GROUP BY ALL""", "ev", "live_tags"))


def _hashtags(text: str) -> str:
    """A space after each sign that may stand before a hash leaves every tag a sign of its own to begin with."""
    word = r"\pL\pM\pN_"
    spaced = rf"regexp_replace({text}, '([^{word}])#', '\1 #', 'g')"
    found = f"regexp_extract_all({spaced}, '(?:^|[^{word}])#([a-zA-Z][{word}-]{{0,63}})', 1)"
    return f"SELECT doc_id AS seq, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform({found}, lambda x: lower(x)), lambda x: regexp_full_match(x, '[a-z0-9_.#-]{{1,64}}')))), ','), '') AS tags FROM documents"


_add("extract_hashtags", lambda s, d: V.documents(s, d).select("seq", F.array_join(F.array_sort(X.extract_hashtags(F.col("event_text"))), ",").alias("tags")), _hashtags("text"))
#: Words that begin with t become tags; a hash inside a word makes none.
_add("hashtags_in_texts", lambda s, d: V.documents(s, d).withColumn("event_text", F.expr("replace(replace(replace(event_text, ' t', ' #T'), 'a', 'a#'), '.', '-#e##u.#')")).select(
    "seq", F.array_join(F.array_sort(X.extract_hashtags(F.col("event_text"))), ",").alias("tags")), _hashtags("replace(replace(replace(text, ' t', ' #T'), 'a', 'a#'), '.', '-#e##u.#')"))
_add("condense_event", lambda s, d: V.events(s, d).select("platform", "session_id", "seq", X.condense_event(
    F.col("seq"), F.col("t"), F.col("tool_name"), F.col("command"), F.col("file_path"), F.col("event_text")).alias("line")), with_views(
    """SELECT platform, session_id, seq, rpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INTEGER), ' ') || ' ' || rpad(t, 20, ' ') || ' ' ||
    CASE t WHEN 'tool_call' THEN tool_name || ': ' || substr(command, 1, 80) WHEN 'user_message' THEN substr(file_path, 1, 80)
    WHEN 'assistant_message' THEN substr(event_text, 1, 80) WHEN 'tool_result' THEN tool_name ELSE '' END AS line FROM ev""", "ev"))

# --- turns -----------------------------------------------------------------------------
_TU = ["platform", "session_id", "turn_no", "start_seq", "end_seq", "events", "turn_id", "id"]
_add("turns", lambda s, d: turns.turns(_prompt_events(s, d)).select(*_TU), with_views(
    "+" + TURN_SQL.format(src="ev").lstrip(", ") + f" SELECT {', '.join(_TU)} FROM tu", "ev"))
_add("chat_turns", lambda s, d: turns.turns(turns.turn_events(V.chat_events(s, d), marker_platforms=())).select(*_TU), with_views(
    "+" + TURN_SQL.format(src="chat").lstrip(", ") + f" SELECT {', '.join(_TU)} FROM tu", "chat"))
_add("turns_codex", lambda s, d: turns.turns(turns.marker_turn_events(V.events(s, d), "permission_request")).select(*_TU), with_views(
    f"""+m AS (SELECT *, count(*) FILTER (WHERE t = 'permission_request') OVER (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS turn_no FROM ev)
    SELECT platform, session_id, turn_no, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS events, CAST(min(seq) AS VARCHAR) AS turn_id,
    session_id || ':' || CAST(min(seq) AS VARCHAR) AS id FROM m WHERE turn_no > 0 GROUP BY platform, session_id, turn_no""", "ev"))
_add("filter_turns", lambda s, d: turns.filter_turns(_prompt_events(s, d), query="Bash, read").select(*_TU), with_views(
    "+" + TURN_SQL.format(src="ev").lstrip(", ") + f""" SELECT {', '.join(_TU)} FROM tu SEMI JOIN (SELECT platform, session_id, turn_no FROM te GROUP BY ALL
    HAVING bool_or(contains(lower(event_text), 'bash')) AND bool_or(contains(lower(event_text), 'read'))) USING (platform, session_id, turn_no)""", "ev"))
_add("sessions_by_turn", lambda s, d: turns.sessions_by_turn(V.sessions(s, d), turns.filter_turns(_prompt_events(s, d), query="todowrite,skill,edit")).select(*_SESS), with_views(
    "+" + TURN_SQL.format(src="ev").lstrip(", ") + f""", hit AS (SELECT platform, session_id FROM te GROUP BY platform, session_id, turn_no
    HAVING bool_or(contains(lower(event_text), 'todowrite')) AND bool_or(contains(lower(event_text), 'skill')) AND bool_or(contains(lower(event_text), 'edit')))
    SELECT {', '.join(_SESS)} FROM sessions SEMI JOIN hit USING (platform, session_id)""", "sessions"))
_add("turn_seq_lower_bound", lambda s, d: turns.turn_lower_bounds(V.events(s, d), "permission_request").select("platform", "session_id", "seq", "seq_from"), with_views(
    "SELECT platform, session_id, seq, coalesce(lag(seq) OVER (PARTITION BY platform, session_id ORDER BY seq) + 1, 0) AS seq_from FROM ev WHERE t = 'permission_request'", "ev"))
_add("unmatched_user_message", lambda s, d: turns.open_prompt_at(V.events(s, d), "permission_request").select("platform", "session_id", "seq", "prompt_seq"), with_views(
    """+k AS (SELECT * FROM ev WHERE t IN ('user_message', 'assistant_message', 'permission_request')),
    l AS (SELECT *, max(CASE WHEN t = 'user_message' THEN seq END) OVER w AS u, max(CASE WHEN t = 'assistant_message' THEN seq END) OVER w AS a FROM k
    WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT platform, session_id, seq, CASE WHEN u > coalesce(a, -1) THEN u END AS prompt_seq FROM l WHERE t = 'permission_request'""", "ev"))
_add("elide_middle", lambda s, d: turns.elide_middle(V.events(s, d), F.concat_ws(" ", F.col("seq").cast("string"), "t"), read=60, keep=20), with_views(
    """+n AS (SELECT *, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) AS n FROM ev QUALIFY n <= 60),
    z AS (SELECT *, max(n) OVER (PARTITION BY platform, session_id) AS total FROM n)
    SELECT platform, session_id, n, CAST(seq AS VARCHAR) || ' ' || t AS line FROM z WHERE total <= 20 OR n <= 10 OR n > total - 9
    UNION ALL SELECT DISTINCT platform, session_id, CAST(11 AS BIGINT), '... (' || CAST(total - 19 AS VARCHAR) || ' lines elided) ...' FROM z WHERE total > 20""", "ev"))
_add("assign_seq", lambda s, d: number(V.events(s, d), ["platform", "session_id"], "seq", "n").select("platform", "session_id", "seq", "n"), with_views(
    "SELECT platform, session_id, seq, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) - 1 AS n FROM ev", "ev"))
_add("model_carry_forward", lambda s, d: _carry(s, d), with_views(
    """SELECT platform, session_id, seq, coalesce(last_value(CASE WHEN v % 5 = 0 THEN tool_name END IGNORE NULLS) OVER (PARTITION BY platform, session_id ORDER BY seq
    ROWS UNBOUNDED PRECEDING), 'unknown') AS model FROM ev""", "ev"))


def _carry(s, d):
    from spanloom.functions.ordered import scan

    out = scan(V.events(s, d), ["platform", "session_id"], "seq", lasts={"model": F.when(F.col("v") % 5 == 0, F.col("tool_name"))})
    return out.select("platform", "session_id", "seq", F.coalesce("model", F.lit("unknown")).alias("model"))


# --- evaluations -----------------------------------------------------------------------
_EVAL = ["id", "platform", "session_id", "definition", "agent", "verdict"]
_add("read_evals", lambda s, d: V.evals(s, d).select(*_EVAL, _stamp("started_at")), with_views(
    f"SELECT {', '.join(_EVAL)}, strftime(started_at, '{DUCK_STAMP}') AS started_at FROM evals", "evals"))
_add("list_evals", lambda s, d: evals.list_evals(V.evals(s, d), definition="1-URGENT", agent="judge-1", verdict="fail", since=SINCE, until=UNTIL).select(*_EVAL), with_views(
    f"""SELECT {', '.join(_EVAL)} FROM evals WHERE definition = '1-URGENT' AND agent = 'judge-1' AND verdict = 'fail'
    AND started_at >= TIMESTAMP '{SINCE}' AND started_at <= TIMESTAMP '{UNTIL}'""", "evals"))
_add("evals_of_definition", lambda s, d: evals.evals_of_definition(V.sessions(s, d), V.evals(s, d), "2-HIGH").select("id", "platform", "session_id", "cwd", "verdict"), with_views(
    "SELECT id, platform, session_id, cwd, verdict FROM sessions JOIN evals USING (platform, session_id) WHERE definition = '2-HIGH'", "sessions", "evals"))
_add("find_eval", lambda s, d: evals.find_eval(V.evals(s, d), "77").select(*_EVAL), with_views(f"SELECT {', '.join(_EVAL)} FROM evals WHERE id = '77'", "evals"))
_add("latest_eval", lambda s, d: evals.latest_evals(V.evals(s, d)).select(*_EVAL), with_views(
    f"SELECT {', '.join(_EVAL)} FROM evals QUALIFY row_number() OVER (PARTITION BY platform, session_id, definition ORDER BY pos DESC) = 1", "evals"))


def _eight(s, d):
    return number(V.events(s, d), ["platform", "session_id"], "seq", "n").withColumnRenamed("seq", "event_seq").withColumnRenamed("n", "seq")


_EIGHT = "nv AS (SELECT * EXCLUDE (seq), seq AS event_seq, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) - 1 AS seq FROM ev)"
_add("events_with_findings", lambda s, d: evals.events_with_findings(_eight(s, d), evals.explode_findings(V.evals(s, d), "3-MEDIUM")).select(
    "platform", "session_id", "event_seq", "t", "eval_id", "severity", "category"), with_views(
    f"""+{_EIGHT}, fm AS (SELECT * FROM findings WHERE definition = '3-MEDIUM' AND seq IS NOT NULL)
    SELECT nv.platform, nv.session_id, nv.event_seq, nv.t, fm.id AS eval_id, fm.severity, fm.category FROM nv LEFT JOIN fm USING (platform, session_id, seq)""", "ev", "findings"))
_add("annotated_events", lambda s, d: _annotated(s, d), with_views(
    f"""+{_EIGHT}, fc AS (SELECT platform, session_id, seq, count(*) AS findings FROM findings WHERE seq IS NOT NULL GROUP BY ALL),
    tc AS (SELECT platform, session_id, seq, count(*) AS tags FROM live_tags GROUP BY ALL)
    SELECT nv.platform, nv.session_id, nv.event_seq, nv.t, coalesce(findings, 0) AS findings, coalesce(tags, 0) AS tags
    FROM nv LEFT JOIN fc USING (platform, session_id, seq) LEFT JOIN tc USING (platform, session_id, seq)""", "ev", "findings", "live_tags"))


def _annotated(s, d):
    from spanloom.plans.context import annotated_events

    return annotated_events(_eight(s, d), evals.explode_findings(V.evals(s, d)), _live(s, d)).select(
        "platform", "session_id", "event_seq", "t", "findings", "tags")


_add("verdict_histogram", lambda s, d: evals.verdict_histogram(V.evals(s, d)), with_views("SELECT verdict, count(*) AS n FROM evals GROUP BY verdict", "evals"))
_add("avg_score", lambda s, d: evals.avg_score(V.evals(s, d)).withColumn("avg_score", F.round("avg_score", 6)), with_views(
    "SELECT definition, round(avg(CAST(pos % 100 AS DOUBLE)), 6) AS avg_score, count(*) AS n FROM evals GROUP BY definition", "evals"))
_add("rubric_disagreement", lambda s, d: evals.rubric_disagreement(V.evals(s, d)).select(
    "platform", "session_id", F.array_join(F.transform(F.map_entries("verdicts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("verdicts")), with_views(
    """+l AS (SELECT platform, session_id, definition, arg_max(verdict, pos) AS verdict FROM evals GROUP BY ALL),
    bad AS (SELECT platform, session_id FROM evals GROUP BY ALL HAVING count(DISTINCT verdict) > 1)
    SELECT platform, session_id, string_agg(definition || '=' || verdict, ',' ORDER BY definition) AS verdicts FROM l SEMI JOIN bad USING (platform, session_id) GROUP BY platform, session_id""", "evals"))
_add("findings_by_category", lambda s, d: evals.findings_by_category(evals.explode_findings(V.evals(s, d))), with_views(
    "SELECT category, count(*) AS n FROM findings GROUP BY category", "findings"))
_add("score_keys", lambda s, d: evals.score_keys(V.evals(s, d)).select("platform", "session_id", F.array_join("score_keys", ",").alias("score_keys")), with_views(
    """SELECT platform, session_id, string_agg(k, ',' ORDER BY k) AS score_keys FROM (SELECT DISTINCT platform, session_id, 's' || CAST(pos % 3 AS VARCHAR) AS k FROM evals
    UNION SELECT DISTINCT platform, session_id, 'overall' FROM evals) GROUP BY platform, session_id""", "evals"))

# --- review ----------------------------------------------------------------------------
_SHELL = "CASE WHEN regexp_matches(command, '\\b(find|ls|tree)\\b') THEN 'filesystem_explore' WHEN regexp_matches(command, '\\b(rg|grep)\\b') THEN 'grep_via_bash' WHEN regexp_matches(command, '\\bpytest\\b') THEN 'test_run' WHEN regexp_matches(command, '\\bgit\\b') THEN 'git' ELSE 'other' END"
_add("tool_mix", lambda s, d: review.tool_mix(V.events(s, d)), with_views(
    f"""SELECT platform, session_id, tool_name, CASE WHEN tool_name = 'Bash' THEN {_SHELL} END AS shell_class, count(*) AS calls,
    count(*) FILTER (WHERE tool_name = 'Read' AND coalesce(read_limit, 0) = 0) AS unbounded_reads FROM ev WHERE t = 'tool_call' GROUP BY ALL""", "ev"))
_add("re_reads", lambda s, d: review.re_reads(V.events(s, d)), with_views(
    "SELECT platform, session_id, file_path, count(*) AS reads FROM ev WHERE t = 'tool_call' AND tool_name = 'Read' GROUP BY ALL HAVING count(*) > 1", "ev"))
_MATRIX = """mx AS (SELECT platform, session_id, count(*) AS total, count(*) FILTER (WHERE tool_name = 'Read') AS reads,
    count(*) FILTER (WHERE tool_name = 'Bash' AND regexp_matches(command, '\\b(rg|grep)\\b')) AS bash_grep,
    count(*) FILTER (WHERE tool_name = 'Bash' AND NOT regexp_matches(command, '\\b(rg|grep)\\b') AND regexp_matches(command, '\\b(find|ls|tree)\\b')) AS bash_fs,
    count(*) FILTER (WHERE tool_name = 'Skill') AS skills, count(*) FILTER (WHERE tool_name = 'Edit') AS edits, count(*) FILTER (WHERE tool_name = 'TodoWrite') AS todos
    FROM ev WHERE t = 'tool_call' GROUP BY ALL)"""
_add("cohort_matrix", lambda s, d: review.cohort_matrix(V.events(s, d)), with_views(f"+{_MATRIX} SELECT * FROM mx", "ev"))
_add("cohort_medians", lambda s, d: review.cohort_medians(review.cohort_matrix(V.events(s, d))), with_views(
    f"+{_MATRIX} SELECT " + ", ".join(f"median({c}) AS median_{c}" for c in review.MATRIX) + " FROM mx", "ev"))
_add("tool_errors", lambda s, d: review.tool_errors(V.events(s, d), F.col("event_text")), with_views(
    "SELECT tool_name, substr(event_text, 1, 120) AS message, count(*) AS n FROM ev WHERE is_error GROUP BY ALL", "ev"))
_add("runs", lambda s, d: review.tool_runs(V.events(s, d)), with_views(
    """+c AS (SELECT *, CASE WHEN tool_name IS DISTINCT FROM lag(tool_name) OVER (PARTITION BY platform, session_id ORDER BY seq) THEN 1 ELSE 0 END AS new FROM ev WHERE t = 'tool_call'),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM c)
    SELECT platform, session_id, run_no, min(tool_name) AS tool_name, count(*) AS length, min(seq) AS first_seq FROM r GROUP BY platform, session_id, run_no""", "ev"))
_RUNS = """er AS (SELECT platform, session_id, max(CASE WHEN is_error THEN n ELSE 0 END) AS error_run FROM (SELECT platform, session_id, is_error, count(*) AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY platform, session_id ORDER BY seq) - row_number() OVER (PARTITION BY platform, session_id, is_error ORDER BY seq) AS g
    FROM ev WHERE t = 'tool_result') GROUP BY platform, session_id, is_error, g) GROUP BY platform, session_id)"""
_add("error_runs", lambda s, d: review.error_runs(V.events(s, d)), with_views(f"+{_RUNS} SELECT * FROM er", "ev"))
_add("recovery_shape", lambda s, d: review.recovery_shape(V.events(s, d).withColumn("args", F.col("command"))), with_views(
    """+rk AS (SELECT * EXCLUDE (k), count(*) FILTER (WHERE t = 'tool_call') OVER w AS k, last_value(CASE WHEN t = 'tool_call' THEN tool_name END IGNORE NULLS) OVER w AS ft,
    last_value(CASE WHEN t = 'tool_call' THEN command END IGNORE NULLS) OVER w AS fa FROM ev WHERE t = 'tool_call' OR is_error
    WINDOW w AS (PARTITION BY platform, session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT platform, session_id, k, tool_name AS nt, command AS na FROM rk WHERE t = 'tool_call'),
    j AS (SELECT f.platform, f.session_id, f.seq, i, CASE WHEN nt IS NULL THEN 'none' WHEN nt = ft AND na = fa THEN 'retried' WHEN nt = ft THEN 'narrowed' ELSE 'different' END AS sh
    FROM (SELECT rk.*, i FROM rk CROSS JOIN (VALUES (1), (2), (3)) AS v3(i) WHERE t = 'tool_result') f LEFT JOIN c ON c.platform = f.platform AND c.session_id = f.session_id AND c.k = f.k + f.i)
    SELECT platform, session_id, seq, max(CASE WHEN i = 1 THEN sh END) AS next_1, max(CASE WHEN i = 2 THEN sh END) AS next_2, max(CASE WHEN i = 3 THEN sh END) AS next_3 FROM j GROUP BY ALL""", "ev"))
_add("large_tool_results", lambda s, d: review.large_results(
    V.documents(s, d).withColumn("t", F.lit("tool_result")), F.col("event_text"), 20_000).select("seq", "size"),
    "SELECT doc_id AS seq, length(text) AS size FROM documents WHERE length(text) > 20000")
_add("skill_comparison", lambda s, d: review.skill_comparison(V.events(s, d), V.sessions(s, d)).select(
    "has_skill", "sessions", F.round("avg_events", 6).alias("avg_events"), F.round("avg_tools", 6).alias("avg_tools")), with_views(
    """+p AS (SELECT platform, session_id, count(*) FILTER (WHERE t = 'tool_call' AND tool_name = 'Skill') AS sk, count(*) FILTER (WHERE t = 'tool_call') AS tools FROM ev GROUP BY ALL)
    SELECT sk > 0 AS has_skill, count(*) AS sessions, round(avg(event_count), 6) AS avg_events, round(avg(tools), 6) AS avg_tools
    FROM sessions JOIN p USING (platform, session_id) WHERE event_count >= 30 GROUP BY 1""", "sessions"))
_SHAPE = """CASE WHEN regexp_matches(x, 'task description|dispatch|workbench') THEN 'wb' WHEN regexp_matches(x, 'fix|bug|error|fails|broken|regression') THEN 'bug'
    WHEN regexp_matches(x, 'refactor|rename|extract|move') THEN 'refactor' WHEN regexp_matches(x, '\\?$|how (do|does|can)') THEN 'question'
    WHEN regexp_matches(x, 'add|implement|build|create') THEN 'feature' ELSE 'other' END"""
_add("task_shape", lambda s, d: review.task_shape(V.chat_events(s, d), F.col("text")), with_views(
    f"""+f AS (SELECT platform, session_id, lower(substr(arg_min(text, seq), 1, 200)) AS x FROM chat WHERE t = 'user_message' GROUP BY ALL)
    SELECT platform, session_id, {_SHAPE} AS shape FROM f""", "chat"))
_PROFILE = f"""{_MATRIX}, {_RUNS}, b AS (SELECT platform, session_id, count(*) AS events, count(*) FILTER (WHERE t = 'tool_call') AS tool_calls,
    count(*) FILTER (WHERE t = 'tool_call' AND tool_name = 'Read') AS reads, count(*) FILTER (WHERE t = 'tool_call' AND tool_name = 'Read' AND coalesce(read_limit, 0) = 0) AS unbounded FROM ev GROUP BY ALL),
    pf AS (SELECT platform, session_id, tool_name, count(*) AS n FROM ev WHERE t = 'tool_call' AND tool_name IN ('Read', 'Edit')
    GROUP BY platform, session_id, tool_name, file_path, CASE WHEN tool_name = 'Edit' THEN command END),
    pp AS (SELECT platform, session_id, max(CASE WHEN tool_name = 'Read' THEN n END) AS max_reads, CAST(sum(CASE WHEN tool_name = 'Read' THEN n - 1 END) AS BIGINT) AS repeat_reads,
    max(CASE WHEN tool_name = 'Edit' THEN n END) AS max_edits FROM pf GROUP BY ALL),
    pr AS (SELECT b.*, coalesce(bash_grep, 0) AS bash_grep, coalesce(bash_fs, 0) AS bash_fs, coalesce(skills, 0) AS skills, coalesce(todos, 0) AS todos,
    coalesce(max_reads, 0) AS max_reads, coalesce(repeat_reads, 0) AS repeat_reads, coalesce(max_edits, 0) AS max_edits, coalesce(error_run, 0) AS error_run
    FROM b LEFT JOIN mx USING (platform, session_id) LEFT JOIN pp USING (platform, session_id) LEFT JOIN er USING (platform, session_id))"""


def _profile(s, d):
    return review.session_profile(V.events(s, d).withColumn("args", F.col("command")))


_FLAGS = ["grep_via_bash", "filesystem_explore", "re_read", "unbounded_reads", "chatty", "identical_edits", "error_streak"]
_add("waste_signatures", lambda s, d: review.waste_signatures(_profile(s, d)).select("platform", "session_id", "repeat_reads", "error_run", *_FLAGS), with_views(
    f"""+{_PROFILE} SELECT platform, session_id, repeat_reads, error_run, bash_grep > 8 AS grep_via_bash, bash_fs > 6 AS filesystem_explore, max_reads >= 3 AS re_read,
    unbounded > reads * 0.3 AS unbounded_reads, tool_calls > events * 0.75 AS chatty, max_edits >= 2 AS identical_edits, error_run >= 3 AS error_streak FROM pr""", "ev"))
_add("rule_eval", lambda s, d: evals.redundancy_rubric(_profile(s, d).withColumn("total", F.col("tool_calls"))).select("id", "definition", "verdict"), with_views(
    f"""+{_PROFILE} SELECT 'redundancy:' || platform || ':' || session_id AS id, 'redundancy' AS definition,
    CASE WHEN repeat_reads > tool_calls * 0.25 THEN 'fail' WHEN repeat_reads > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM pr""", "ev"))

# --- pairing ---------------------------------------------------------------------------
_add("pair_tools_by_id", lambda s, d: pairing.pair_tools_by_id(V.events(s, d)).select(
    "platform", "session_id", "tool_use_id", F.col("call.seq").alias("call_seq"), F.col("seq").alias("result_seq")), with_views(
    """+p AS (SELECT *, lag(t) OVER w AS pt, lag(seq) OVER w AS ps FROM ev WHERE t IN ('tool_call', 'tool_result') WINDOW w AS (PARTITION BY platform, session_id, tool_use_id ORDER BY seq))
    SELECT platform, session_id, tool_use_id, ps AS call_seq, seq AS result_seq FROM p WHERE t = 'tool_result' AND pt = 'tool_call'""", "ev"))
