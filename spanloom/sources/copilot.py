"""Evidence of the copilot platform: immutable source records and their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import content_revision, percent_quote
from spanloom.functions.payload import child, computed, get, is_object, kind_of, text_at
from spanloom.sources.jsonl import complete_lines

SESSION = ["platform", "session_id"]
USAGE_TABLE = "assistant_usage_events"  # fixed value: table of model-call usage
SCHEMA_VERSION = 1

# Normal kind, evidence role and class of each native event type.
NATIVE_KINDS = {
    "user.message": ("user_prompt", "user_prompt", "main"),
    "assistant.message": ("assistant_message", "assistant_message", "main"),
    "assistant.turn_start": ("assistant_turn_start", "assistant_message", "main"),
    "assistant.turn_end": ("assistant_turn_end", "finish", "main"),
    "tool.execution_start": ("tool_execution_start", "tool_execution", "main"),
    "tool.execution_complete": ("tool_execution_complete", "tool_result", "main"),
    "tool.execution_error": ("tool_execution_failure", "tool_result", "main"),
    "tool.execution_failure": ("tool_execution_failure", "tool_result", "main"),
    "permission.request": ("permission_request", "permission_request", "main"),
    "permissionRequest": ("permission_request", "permission_request", "main"),
    "permission.decision": ("permission_decision", "permission_decision", "main"),
    "permissionDecision": ("permission_decision", "permission_decision", "main"),
    "prompt.transformation": ("prompt_transformation", "hook", "main"),
    "prompt.transformed": ("prompt_transformation", "hook", "main"),
    "assistant.abort": ("abort", "finish", "main"),
    "session.abort": ("abort", "finish", "main"),
    "abort": ("abort", "finish", "main"),
    "session.start": ("session_start", "hook", "main"),
    "session.resume": ("session_start", "hook", "main"),
    "session.end": ("session_end", "shutdown", "main"),
    "session.close": ("session_end", "shutdown", "main"),
    "session.shutdown": ("session_shutdown", "shutdown", "shutdown_validation"),
    "session.usage_checkpoint": ("compaction", "checkpoint", "checkpoint"),
    "preCompact": ("compaction", "compaction", "main"),
    "session.compaction": ("compaction", "compaction", "main"),
    "context.compaction": ("compaction", "compaction", "main"),
    "subagent.started": ("subagent_started", "nested_child", "main"),
    "subagent.completed": ("subagent_completed", "nested_child", "main"),
    "notification": ("notification", "hook", "main"),
    "session.notification": ("notification", "hook", "main"),
    "session.model_change": ("notification", "hook", "main"),
    "session.auto_mode_resolved": ("notification", "hook", "main"),
    "hook.start": ("notification", "hook", "main"),
    "hook.end": ("notification", "hook", "main"),
    "preToolUse": ("notification", "hook", "main"),
    "postToolUse": ("notification", "hook", "main"),
    "postToolUseFailure": ("notification", "hook", "main"),
    "subagent.configured": ("notification", "hook", "main"),
    "userPromptSubmitted": ("prompt_transformation", "hook", "main"),
    "agentStop": ("agent_stop", "finish", "main"),
    "subagentStart": ("subagent_started", "nested_child", "main"),
    "subagentStop": ("subagent_completed", "nested_child", "main"),
    "sessionStart": ("session_start", "hook", "main"),
    "sessionEnd": ("session_end", "hook", "main"),
}


def transcript_records(lines: DataFrame, source_key: Column, generation: Column, observed_at: Column) -> DataFrame:
    """Source records of complete transcript lines; unreadable lines stay as evidence.

    A line with an event id is known by it; any other by its place and digest.
    """
    rows = complete_lines(lines)
    parsed = F.try_parse_json(F.when(F.is_valid_utf8("line"), F.col("line")))
    rows = rows.withColumn("payload", parsed)
    bad = (
        F.when(~F.is_valid_utf8("line"), "invalid_utf8")
        .when(F.col("payload").isNull(), "invalid_json")
        .when(~is_object(F.col("payload")), "non_object_json")
    )
    event_id = F.when(kind_of(child(F.col("payload"), "id")).isin("STRING", "BIGINT"), F.nullif(get(F.col("payload"), "id"), F.lit("")))
    hash_ = F.sha2(F.col("line").cast("binary"), 256)
    stated = get(F.col("payload"), "timestamp")
    ts = F.when(F.try_to_timestamp(stated).isNotNull(), stated)
    own = F.when(bad.isNull(), event_id)
    place = F.coalesce(own, F.concat_ws("/", generation, F.col("byte_offset").cast("string"), hash_))
    return rows.select(
        *SESSION,
        "pos",
        F.concat_ws("/", source_key, F.col("session_id"), place).alias("source_id"),
        F.lit("transcript").alias("source_kind"),
        F.col("session_id").alias("native_session_id"),
        F.when(bad.isNull(), ts).alias("ts"),
        observed_at.alias("observed_at"),
        F.when(bad.isNull(), F.col("payload")).alias("payload"),
        bad.alias("malformed"),
        (bad.isNull() & stated.isNotNull() & ts.isNull()).alias("bad_ts"),
        F.when(bad.isNotNull(), F.base64(F.col("line").cast("binary"))).alias("raw"),
        "byte_offset",
        "byte_length",
    )


def transcript_diagnostics(records: DataFrame) -> DataFrame:
    """One row per unreadable line or unreadable time."""
    code = F.when(F.col("malformed").isNotNull(), F.concat(F.lit("transcript_"), F.regexp_replace("malformed", "_json$", ""))).when(
        F.col("bad_ts"), "transcript_invalid_timestamp"
    )
    fixed = F.when(code == "transcript_invalid", "transcript_invalid_json").otherwise(code)
    return records.withColumn("code", fixed).where("code is not null").select(*SESSION, "code", "source_id", "byte_offset")


def revision_id(source_key: Column, primary_key: Column, revision: Column) -> Column:
    """Source id of a revision of a usage row, whose session is a column."""
    return F.concat_ws(":", F.lit("copilot-db"), source_key, F.col("session_id"), F.lit(USAGE_TABLE), primary_key, revision)


def usage_snapshot(rows: DataFrame, source_key: Column, generation: Column, *kept: str) -> DataFrame:
    """Usage table rows as immutable revisions, with the columns ``kept`` of theirs.

    ``rows`` carries session columns, ``pos`` (archive order), ``pk`` and ``row_json``.  The revision is the digest of the
    canonical row; the logical call leaves it out, so a corrected row replaces the old one.
    """
    pk = percent_quote(F.col("pk").cast("string"))
    revision = content_revision(F.col("row_json"))
    return rows.select(
        *SESSION,
        "pos",
        generation.alias("generation"),
        revision.alias("content_revision"),
        pk.alias("primary_key"),
        revision_id(source_key, pk, revision).alias("source_id"),
        F.concat_ws(":", F.lit("copilot"), F.lit("usage"), source_key, F.lit(USAGE_TABLE), percent_quote(generation), pk).alias("logical_call_id"),
        "row_json",
        *kept,
    )


def stored_session_id(source_key: Column, native: Column) -> Column:
    return F.concat_ws("-", F.lit("copilot"), F.substring(source_key, 1, 16), native)


def _kinds() -> Column:
    cells = [(F.lit(native), F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "role", "classification"), said, strict=True)])) for native, said in NATIVE_KINDS.items()]
    return F.create_map(*[x for cell in cells for x in cell])


def foreign_version(payload: Column) -> Column:
    """Whether a record names another schema version; one that is there but null is unknown too."""
    other = (get(payload, "schema_version") != str(SCHEMA_VERSION)) | (kind_of(child(payload, "schema_version")) == "VOID")
    return F.coalesce(other, F.lit(False))


def normalize(records: DataFrame) -> DataFrame:
    """Normal events of transcript and hook records, one row per event and tool request.

    Native types map through a fixed table of a few dozen values; families (``model.*``, anything
    with ``error``) and records of another schema version follow by rule.  What kinds depend on is
    parsed once a record, which gives its event and its requests together.
    """
    hook = F.col("source_kind") == "hook"
    p, d = F.col("payload"), F.col("data")
    base = computed(
        records.where(F.col("source_kind").isin("transcript", "hook")),
        {
            "native_type": F.nullif(F.when(hook, F.col("event")).otherwise(text_at(p, "type")), F.lit("")),
            "data": F.when(hook, p).otherwise(child(p, "data")),
            "foreign_version": foreign_version(p) & ~hook,
        },
    )
    native = F.col("native_type")
    fixed = _kinds()[native]
    aux = native.startswith("model.")
    failed = (native == "tool.execution_complete") & F.coalesce(get(d, "success", kind="boolean") == F.lit(False), F.lit(False))
    err = fixed.isNull() & F.coalesce(F.lower(native).contains("error"), F.lit(False)) & ~F.coalesce(aux, F.lit(False))
    known = ~F.col("foreign_version")
    kind = (
        F.when(known & aux, "auxiliary_model_call").when(known & failed, "tool_execution_failure").when(known & err, "error").when(known, fixed["kind"])
    )
    role = F.when(known & aux, "auxiliary_model").when(known & err, "finish").when(known, fixed["role"])
    cls = F.when(known & aux, "title_generation").when(known, fixed["classification"])
    mapped = computed(
        base,
        {
            "kind": F.coalesce(kind, F.lit("unknown")),
            "role": F.coalesce(role, F.when(hook, "hook").otherwise("assistant_message")),
            "classification": F.coalesce(cls, F.lit("main")),
            "tool_call_id": F.coalesce(F.nullif(get(d, "toolCallId"), F.lit("")), F.nullif(get(d, "tool_call_id"), F.lit(""))),
        },
    )
    mapped = mapped.withColumns(
        {
            "interaction_id": F.nullif(get(d, "interactionId"), F.lit("")),
            "agent_id": F.coalesce(text_at(p, "agentId"), F.nullif(get(d, "agentId"), F.lit("")), F.nullif(get(d, "agent_id"), F.lit(""))),
            "native_turn_id": get(d, "turnId"),
            "model": get(d, "model"),
            "parent_tool_call_id": F.when(native.isin("subagent.started", "subagent.completed"), F.col("tool_call_id")).otherwise(get(d, "parentToolCallId")),
        }
    )
    # The event itself comes before the tools it asks for.
    none = F.array().cast("array<struct<id:string,name:string>>")
    requests = F.transform(
        F.try_variant_get("data", "$.toolRequests", "array<variant>"),
        lambda r: F.struct(F.nullif(get(r, "toolCallId"), F.lit("")).alias("id"), get(r, "name").alias("name")),
    )
    asked = F.filter(F.when(F.col("kind") == "assistant_message", F.coalesce(requests, none)).otherwise(none), lambda r: r["id"].isNotNull())
    own = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")))
    rows = mapped.select(*mapped.columns, F.posexplode(F.concat(own, asked)).alias("place", "request"))
    main = F.col("place") == 0
    event = F.concat(F.lit("copilot:event:"), F.col("source_id"))
    return rows.withColumns(
        {
            "id": F.when(main, event).otherwise(F.concat(event, F.lit(":tool:"), F.col("request.id"))),
            "kind": F.when(main, F.col("kind")).otherwise("tool_request"),
            "role": F.when(main, F.col("role")).otherwise("tool_request"),
            "tool_call_id": F.when(main, F.col("tool_call_id")).otherwise(F.col("request.id")),
            "tool_name": F.when(main, get(d, "toolName")).otherwise(F.col("request.name")),
        }
    ).drop("foreign_version", "place", "request")


def lifecycle_status(records: DataFrame) -> DataFrame:
    """Open or closed by the last explicit top-level hook; child stops never close a session."""
    p, c = F.col("payload"), F.try_parse_json("context")
    ids = ("agentId", "agent_id", "parentToolCallId", "parent_tool_call_id")
    of_child = F.lit(False)
    for source in (p, c):
        for key in ids:
            of_child = of_child | (F.coalesce(get(source, key), F.lit("")) != "")
    decision = F.when(F.col("event").isin("sessionEnd", "shutdown", "session_end") & ~of_child, "closed").when(
        F.col("event").isin("sessionStart", "resume", "activity", "session_start", "userPromptSubmitted"), "open"
    )
    return (
        records.where("source_kind = 'hook'")
        .withColumn("decision", decision)
        .where("decision is not null")
        .groupBy(*SESSION)
        .agg(F.max_by("decision", "pos").alias("status"))
    )
