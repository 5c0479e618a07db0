"""Reading dynamic payloads held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings payloads use for the same thing.
CALL_ID_KEYS = ("tool_call_id", "toolCallId", "tool_use_id", "toolUseId", "call_id", "callId")
CHILD_ID_KEYS = ("subagent_id", "subagentId", "agent_id", "agentId")
AGENT_KEYS = ("agent_id", "agent-id", "agentId", "thread_id", "thread-id", "threadId")
GENERATION_KEYS = ("generation_id", "generationId")
TOOL_NAME_KEYS = ("tool_name", "toolName", "name", "tool")
SIGNATURE_KEYS = ("command", "tool_input", "toolInput", "arguments", "file_path", "filePath", "path")
ARGUMENT_KEYS = ("tool_input", "toolInput", "arguments", "input", "command", "file_path", "filePath", "path")
RESULT_KEYS = ("tool_output", "toolOutput", "result", "output", "stdout", "response", "edits", "diff")
SPAN_ARGUMENT_KEYS = ("tool_input", "arguments", "input", "command")
SPAN_RESULT_KEYS = ("tool_response", "tool_result", "result", "output")
ERROR_WORDS = ("error", "failed", "failure")
INTERRUPTED_WORDS = ("aborted", "cancelled", "canceled", "interrupted")


def path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def get(value: Column, *keys: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path(*keys), kind)


def child(value: Column, *keys: str) -> Column:
    return F.try_variant_get(value, path(*keys), "variant")


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, computed once a row however often later filters and branches name them.

    A filter on a column of a projection is moved below it with a copy of its expression for each mention, parsing and
    all; on what a generator gives it is not.
    """
    cells = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(cells)))


def kind_of(value: Column) -> Column:
    """Type name of a VARIANT: OBJECT, ARRAY, STRING, BIGINT, …; VOID for JSON null, NULL when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_object(value: Column) -> Column:
    return F.coalesce(kind_of(value) == "OBJECT", F.lit(False))


def text_at(value: Column, *keys: str) -> Column:
    """A non-empty string at the path; other types are NULL."""
    there = child(value, *keys)
    return F.when(kind_of(there) == "STRING", F.nullif(get(value, *keys), F.lit("")))


def first_key(value: Column, *keys: str) -> Column:
    """The first spelling that is present and not empty, as text."""
    return F.coalesce(*[F.nullif(get(value, k), F.lit("")) for k in keys])


def metric_number(value: Column, *keys: str) -> Column:
    """A whole non-negative number; booleans, texts and fractions are NULL."""
    there = child(value, *keys)
    number = get(value, *keys, kind="double")
    whole = kind_of(there).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    return F.when(whole & (number >= 0) & (F.floor(number) == number), get(value, *keys, kind="decimal(38,0)").try_cast("bigint"))


def integer(value: Column, *keys: str) -> Column:
    """A non-negative number written without a fraction."""
    return F.when(kind_of(child(value, *keys)).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), metric_number(value, *keys))


def loose_integer(value: Column, *keys: str) -> Column:
    """First present spelling as a whole number; ``""`` and ``"--"`` count as absent."""
    shown = F.coalesce(*[get(value, k) for k in keys])
    return shown.try_cast("bigint")


def decoded(value: Column) -> Column:
    """Embedded JSON text read as structure; anything else unchanged."""
    inner = F.try_parse_json(value.try_cast("string"))
    return F.when(kind_of(value) == "STRING", F.coalesce(inner, value)).otherwise(value)


def semantic_value(value: Column, keys: tuple[str, ...]) -> Column:
    """The one present spelling's value as JSON text, or an object of all present ones."""
    cells = []
    for k in keys:
        there = child(value, k)
        present = there.isNotNull() & (kind_of(there) != "VOID") & (F.coalesce(get(value, k), F.lit("x")) != "")
        cells.append(F.when(present, F.struct(F.lit(k).alias("k"), F.to_json(decoded(there)).alias("v"))))
    found = F.filter(F.array(*cells), lambda x: x.isNotNull())
    several = F.concat(
        F.lit("{"), F.array_join(F.transform(found, lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), x["v"])), ","), F.lit("}")
    )
    return F.when(F.size(found) == 1, F.element_at(found, 1)["v"]).when(F.size(found) > 1, several)


def status_word(text: Column, *, interruptions: bool = True) -> Column:
    word = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(word.isin(*ERROR_WORDS), "errored")
    if interruptions:
        out = out.when(word.isin(*INTERRUPTED_WORDS), "interrupted")
    return out.otherwise("completed")


def content_part(block: Column) -> Column:
    """One message block as (type, id, name, content); NULL when it carries nothing."""
    kind = get(block, "type")

    def part(name: str, id_: Column, label: Column, body: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), id_.alias("id"), label.alias("name"), body.alias("content"))

    none, empty = F.lit(None).cast("string"), F.lit("")
    said = F.coalesce(get(block, "text"), empty)
    thought = F.coalesce(get(block, "thinking"), empty)
    return (
        F.when((kind == "text") & (said != ""), part("text", none, none, said))
        .when((kind == "thinking") & (thought != ""), part("reasoning", none, none, thought))
        .when(
            kind == "tool_use",
            part("tool_call", F.coalesce(get(block, "id"), empty), F.coalesce(get(block, "name"), empty), F.to_json(child(block, "input"))),
        )
        .when(
            kind == "tool_result",
            part("tool_call_response", F.coalesce(get(block, "tool_use_id"), empty), none, F.to_json(child(block, "content"))),
        )
    )


def content_parts(content: Column) -> Column:
    """Parts of a message whose content is a text or a list of blocks."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    parts = F.filter(F.transform(F.coalesce(blocks, F.array().cast("array<variant>")), content_part), lambda p: p.isNotNull())
    whole = content.try_cast("string")
    single = F.array(
        F.struct(
            F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), whole.alias("content")
        )
    )
    return F.when((kind_of(content) == "STRING") & (whole != ""), single).otherwise(parts)


def foreign_reason(payload: Column, expected: str) -> Column:
    """Positive evidence that a payload comes from another tool, else NULL."""
    if expected not in PLATFORMS:
        return F.lit(None).cast("string")
    name = text_at(payload, "hook_event_name")
    head = F.substring(name, 1, 1)
    lower, upper = head.rlike(r"^\p{Ll}"), head.rlike(r"^\p{Lu}")
    if expected == "cursor":
        return F.when(upper, F.concat(F.lit("PascalCase event "), name, F.lit(" received for cursor")))
    own = name.isin(*CLI_EVENTS) if expected == "copilot" else F.lit(False)
    out = None
    for marker in CURSOR_MARKERS:
        test, text = child(payload, marker).isNotNull(), F.lit(f"Cursor marker {marker} present")
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.when(lower & ~own, F.concat(F.lit("Cursor event "), name, F.lit(f" received for {expected}")))


# Platforms, marker fields, hook event names and their aliases.
PLATFORMS = ("claude", "codex", "cursor", "copilot")
CURSOR_MARKERS = ("cursor_version", "composer_mode")
CLI_EVENTS = (
    "sessionStart",
    "userPromptSubmitted",
    "preToolUse",
    "postToolUse",
    "postToolUseFailure",
    "agentStop",
    "subagentStart",
    "subagentStop",
    "sessionEnd",
    "errorOccurred",
    "permissionRequest",
    "notification",
    "preCompact",
)
EVENT_ALIASES = {
    "SessionStart": "sessionStart",
    "UserPromptSubmit": "userPromptSubmitted",
    "PreToolUse": "preToolUse",
    "PostToolUse": "postToolUse",
    "Stop": "agentStop",
    "SubagentStart": "subagentStart",
    "SubagentStop": "subagentStop",
    "SessionEnd": "sessionEnd",
}
CONTEXT_KEYS = ("env", "trace_id", "span_id", "parent_span_id", "trace_context", "traceparent")
