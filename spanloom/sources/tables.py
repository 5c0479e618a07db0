"""The store's own logs: sessions, events, usage mirror, tags, evaluations, errors."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.payload import child, first_key, get, kind_of
from spanloom.functions.times import bound, parse_ts
from spanloom.operators.evals import normal_findings, normal_verdict
from spanloom.sources.jsonl import field, json_frames, read_lines

# Dotted keys of the usage mirror.
USAGE_KEYS = {
    "provider_name": "gen_ai.provider.name",
    "operation_name": "gen_ai.operation.name",
    "response_model": "gen_ai.response.model",
    "input_tokens": "gen_ai.usage.input_tokens",
    "output_tokens": "gen_ai.usage.output_tokens",
    "cache_read_input_tokens": "gen_ai.usage.cache_read.input_tokens",
    "cache_creation_input_tokens": "gen_ai.usage.cache_creation.input_tokens",
    "reasoning_output_tokens": "gen_ai.usage.reasoning.output_tokens",
}
SESSION_SCHEMA = (
    "platform string, session_id string, cwd string, started_at string, ended_at string, status string,"
    " event_count bigint, last_seq bigint, last_ts string, tag_count bigint, extra string"
)


def usage_rows(lines: DataFrame) -> DataFrame:
    """Usage mirror lines; blank, malformed or incomplete lines are dropped.

    A cache or reasoning count that is absent stays NULL.
    """
    f = json_frames(lines)
    numbers = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_output_tokens")
    columns = [field(c).alias(c) for c in ("platform", "session_id", "call_id")]
    columns += [field("seq", kind="bigint").alias("seq"), "file", "pos", field("ts").alias("ts_text")]
    columns += [field(USAGE_KEYS[c], kind="bigint" if c in numbers else "string").alias(c) for c in USAGE_KEYS]
    out = f.select(*columns)
    needed = ("platform", "session_id", "call_id", "seq", "ts_text", "provider_name", "response_model", "operation_name", "input_tokens", "output_tokens")
    for c in needed:
        out = out.where(F.col(c).isNotNull())
    return out.withColumn("ts", parse_ts(F.col("ts_text"))).drop("ts_text")


def tag_ops(lines: DataFrame) -> DataFrame:
    """Tag log entries; those without seq, tag or op are corrupt and skipped."""
    return json_frames(lines).select(
        "platform",
        "session_id",
        "pos",
        field("seq", kind="bigint").alias("seq"),
        field("tag").alias("tag"),
        field("op").alias("op"),
        field("source").alias("source"),
        parse_ts(field("at")).alias("at"),
    ).where("seq is not null and tag is not null and op is not null")


def evals(lines: DataFrame) -> DataFrame:
    """Evaluation results with verdicts and severities brought to the known words."""
    finding = "array<struct<seq:bigint,severity:string,category:string,note:string>>"
    out = json_frames(lines).select(
        "platform",
        "pos",
        *[field(c).alias(c) for c in ("id", "session_id", "definition", "agent", "agent_model", "agent_session_id")],
        parse_ts(field("started_at")).alias("started_at"),
        parse_ts(field("ended_at")).alias("ended_at"),
        F.coalesce(field("duration_ms", kind="bigint"), F.lit(0)).alias("duration_ms"),
        normal_verdict(field("verdict")).alias("verdict"),
        F.coalesce(field("summary"), F.lit("")).alias("summary"),
        F.coalesce(F.try_variant_get("frame", "$.scores", "map<string,double>"), F.create_map().cast("map<string,double>")).alias("scores"),
        normal_findings(F.from_json(F.to_json(child(F.col("frame"), "findings")), finding)).alias("findings"),
        F.coalesce(field("markdown"), F.lit("")).alias("markdown"),
        child(F.col("frame"), "cost").alias("cost"),
    )
    for c in ("id", "session_id", "definition", "agent"):
        out = out.where(F.col(c).isNotNull())
    return out


def events(lines: DataFrame) -> DataFrame:
    """Events ``{t, ts, seq, data}``; ``data`` may be any JSON value or absent."""
    return json_frames(lines).select(
        "platform",
        "session_id",
        field("seq", kind="bigint").alias("seq"),
        parse_ts(field("ts")).alias("ts"),
        field("t").alias("t"),
        child(F.col("frame"), "data").alias("data"),
        F.to_json("frame").alias("event_text"),
    ).where("seq is not null")


def truncated_sessions(lines: DataFrame) -> DataFrame:
    """First unreadable record of each session: readers stop there and flag the session."""
    bad = lines.where((F.trim("line") != "") & (F.coalesce(kind_of(F.try_parse_json(F.trim("line"))), F.lit("")) != "OBJECT"))
    return bad.groupBy("platform", "session_id").agg(F.min("pos").alias("broken_at"))


def until_broken(lines: DataFrame) -> DataFrame:
    """Lines before the first unreadable record of their session."""
    cut = truncated_sessions(lines)
    joined = lines.join(cut, ["platform", "session_id"], "left")
    return joined.where(F.col("broken_at").isNull() | (F.col("pos") < F.col("broken_at"))).drop("broken_at")


def capture_errors(lines: DataFrame) -> DataFrame:
    names = ("ts", "level", "platform", "session_id", "phase", "source_path", "error_class", "message", "traceback")
    return json_frames(lines).select("pos", *[field(c).alias(c) for c in names]).withColumn("ts", parse_ts(F.col("ts")))


def last_errors(
    errors: DataFrame,
    n: int,
    *,
    platform: str | None = None,
    phase: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """The last ``n`` matching errors, in file order."""
    for name, value in (("platform", platform), ("phase", phase)):
        if value is not None:
            errors = errors.where(F.col(name) == value)
    if since is not None:
        errors = errors.where(F.col("ts") >= bound(errors, "ts", since))
    if until is not None:
        errors = errors.where(F.col("ts") <= bound(errors, "ts", until))
    return errors.orderBy(F.col("pos").desc()).limit(n).orderBy("pos")


def import_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows from one small YAML file per session; defaults fill absent fields."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        names = [c.strip().split()[0] for c in SESSION_SCHEMA.split(",")]
        for batch in batches:
            rows = []
            for text in batch["value"]:
                try:
                    doc = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                if not isinstance(doc, dict) or not doc.get("session_id"):
                    continue
                row = {n: doc.get(n) for n in names}
                for n in ("started_at", "ended_at", "last_ts"):
                    row[n] = None if row[n] is None else str(row[n])
                row |= {"event_count": doc.get("event_count", 0), "last_seq": doc.get("last_seq", -1), "tag_count": doc.get("tag_count", 0)}
                row["extra"] = json.dumps(doc.get("extra") or {})
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.option("wholetext", True).text(path)
    out = files.mapInPandas(parse, SESSION_SCHEMA)
    for c in ("started_at", "ended_at", "last_ts"):
        out = out.withColumn(c, parse_ts(F.col(c)))
    return out.withColumn("extra", F.try_parse_json("extra"))


def hook_records(payloads: DataFrame) -> DataFrame:
    """Hook observations as source records: canonical event name, own session id, source time."""
    from spanloom.functions.payload import CONTEXT_KEYS, EVENT_ALIASES, text_at
    from spanloom.functions.times import iso_millis

    p = F.col("payload")
    aliases = F.create_map(*[F.lit(x) for pair in EVENT_ALIASES.items() for x in pair])
    shown = F.trim(get(p, "timestamp"))
    number = F.when(kind_of(child(p, "timestamp")) != "BOOLEAN", shown.try_cast("double"))
    seconds = F.when(F.abs(number) >= 1e12, number / 1000).otherwise(number)
    source_ts = F.when(kind_of(child(p, "timestamp")).eqNullSafe("STRING") & F.try_to_timestamp(shown).isNotNull() & number.isNull(), shown).otherwise(
        iso_millis(F.timestamp_micros((seconds * 1_000_000).cast("bigint")))
    )
    session = text_at(p, "sessionId")
    event = F.coalesce(F.try_element_at(aliases, F.col("event")), F.col("event"))
    context = F.map_filter(
        F.coalesce(F.try_variant_get("context", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
        lambda k, _v: k.isin(*CONTEXT_KEYS),
    )
    return payloads.where(session.isNotNull()).select(
        F.concat_ws("/", F.lit("hook"), session, "observation_id").alias("source_id"),
        F.lit("hook").alias("source_kind"),
        session.alias("native_session_id"),
        source_ts.alias("ts"),
        "observed_at",
        event.alias("event"),
        p.alias("payload"),
        F.to_json(context).alias("context"),
        "observation_id",
    )


def cursor_usage_rows(stops: DataFrame) -> DataFrame:
    """Usage of stop payloads; a repeat of the session's previous generation is skipped."""
    from spanloom.functions.ids import provider_of
    from spanloom.functions.ordered import scan
    from spanloom.functions.payload import GENERATION_KEYS, loose_integer

    p = F.col("payload")
    rows = stops.select(
        "platform",
        "session_id",
        "seq",
        "ts",
        first_key(p, *GENERATION_KEYS).alias("call_id"),
        first_key(p, "model", "model_name").alias("response_model"),
        loose_integer(p, "input_tokens", "inputTokens").alias("input_tokens"),
        loose_integer(p, "output_tokens", "outputTokens").alias("output_tokens"),
        loose_integer(p, "cache_read_tokens", "cacheReadTokens").alias("cache_read_input_tokens"),
        loose_integer(p, "cache_write_tokens", "cacheWriteTokens").alias("cache_creation_input_tokens"),
    )
    for c in ("call_id", "response_model", "input_tokens", "output_tokens"):
        rows = rows.where(F.col(c).isNotNull())
    rows = scan(rows, ["platform", "session_id"], "seq", befores={"__prev": F.col("call_id")})
    provider = provider_of(F.col("response_model"))
    return rows.where(F.col("__prev").isNull() | (F.col("__prev") != F.col("call_id"))).drop("__prev").withColumn(
        "provider_name", F.when(provider == "", "cursor").otherwise(provider)
    )


def _said(message: str = "message") -> Column:
    """Trimmed text blocks of a transcript message joined by newlines; NULL when there are none."""
    blocks = F.try_variant_get("frame", f"$.{message}.content", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: get(b, "type") == "text"), lambda b: F.trim(get(b, "text")))
    texts = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def transcript_messages(frames: DataFrame) -> DataFrame:
    return frames.select("platform", "session_id", "pos", field("role").alias("role"), _said().alias("text")).where(
        "role in ('user', 'assistant') and text is not null"
    )


def transcript_summary(messages: DataFrame) -> DataFrame:
    """First user text and last assistant text of each transcript."""
    return messages.groupBy("platform", "session_id").agg(
        F.coalesce(F.min_by("text", F.when(F.col("role") == "user", F.col("pos"))), F.lit("")).alias("input_text"),
        F.coalesce(F.max_by("text", F.when(F.col("role") == "assistant", F.col("pos"))), F.lit("")).alias("output_text"),
    )


def latest_transcript_turn(messages: DataFrame) -> DataFrame:
    """Last user message, last assistant message after it, number of user messages."""
    key = ["platform", "session_id"]
    users = messages.where("role = 'user'").groupBy(*key).agg(
        F.max("pos").alias("user_pos"), F.max_by("text", "pos").alias("input_text"), F.count(F.lit(1)).alias("user_messages")
    )
    replies = messages.where("role = 'assistant'").groupBy(*key).agg(F.max("pos").alias("reply_pos"), F.max_by("text", "pos").alias("reply"))
    answer = F.when(F.col("reply_pos") > F.col("user_pos"), F.col("reply"))
    return users.join(replies, key, "left").select(
        *key, "input_text", F.coalesce(answer, F.lit("")).alias("output_text"), "user_messages"
    )


def export_cases(sessions: DataFrame, rows: DataFrame, out: str, *, per_part: int = 1000, keys: tuple[str, ...] = ("platform", "session_id")) -> int:
    """Write one case per session or turn as JSON and return the number of cases.

    ``out``/cases holds one row per case: its catalog row and its number of events, 0 for a session
    without any.  ``out``/parts holds the events, in parts of at most ``per_part``, so no case is
    ever gathered whole.  An empty result is an error.
    """
    from spanloom.functions.ordered import number

    numbered = number(rows, list(keys), "seq", "n").withColumn("part", F.expr(f"n div {per_part}"))
    cell = F.struct(*[c for c in ("seq", "t", "ts", "event_text") if c in rows.columns])
    own = [k for k in keys if k in sessions.columns]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_events"))
    cases = sessions.join(counts, own, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    n = cases.count()
    if n == 0:
        raise LookupError("no session or turn matches the export")
    cases.write.mode("errorifexists").option("maxRecordsPerFile", 100).json(f"{out}/cases")
    parts = numbered.join(sessions.select(*own).distinct(), own, "left_semi").groupBy(*keys, "part").agg(F.sort_array(F.collect_list(cell)).alias("events"))
    parts.write.mode("errorifexists").option("maxRecordsPerFile", 100).json(f"{out}/parts")
    return n
