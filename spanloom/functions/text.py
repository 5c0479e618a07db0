"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag grammar, hashtag grammar, fenced block, leading blocks that are not typed by a person.
TAG_PATTERN = r"^[a-z0-9_\-.#]{1,64}$"
HASHTAG_PATTERN = r"(?U)(?<!\w)#([a-zA-Z][\w-]{0,63})"
FENCE_PATTERN = r"(?s)```json\s*(\{.*?\})\s*```"
SYNTHETIC_TAGS = (
    "environment_context",
    "recommended_plugins",
    "task-notification",
    "external_codex_apps_open_page",
)
SYNTHETIC_TAG_WITH_FIELDS = "in-app-browser-context"
INSTRUCTIONS_HEAD = "# AGENTS.md instructions"


def snippet(text: Column, needle: str, window: int = 80) -> Column:
    """The first hit with half a window of text on either side and … where text was cut."""
    half = window // 2
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - half, F.lit(1))
    stop = F.least(at + len(needle) + half, F.length(text) + 1)
    cut = F.concat(
        F.when(start > 1, F.lit("…")).otherwise(F.lit("")),
        text.substr(start, stop - start),
        F.when(stop <= F.length(text), F.lit("…")).otherwise(F.lit("")),
    )
    return F.when(at == 0, F.substring(text, 1, window)).otherwise(cut)


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_tag(tag: Column) -> Column:
    trimmed = strip(tag)
    return (trimmed == F.lower(trimmed)) & trimmed.rlike(TAG_PATTERN)


def validate_tag(tag: Column) -> Column:
    """The canonical tag, or NULL when it is not one."""
    return F.when(is_tag(tag), strip(tag))


def extract_hashtags(text: Column) -> Column:
    """Distinct lower-case tags in order of first appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(HASHTAG_PATTERN), F.lit(1)), F.lower)
    return F.coalesce(F.array_distinct(F.filter(found, lambda x: x.rlike(TAG_PATTERN))), F.array().cast("array<string>"))


def env_to_tag(name: Column, value: Column, prefix: str = "wb_") -> Column:
    """``key-value`` tag of an environment variable, or NULL when it makes none."""
    key = F.regexp_replace(F.lower(name), f"^{prefix}", "")
    body = F.regexp_replace(F.lower(value), r"[^a-z0-9_\-.#]", "-")
    body = F.regexp_replace(F.regexp_replace(body, "-+", "-"), "^-|-$", "")
    tag = F.concat(key, F.lit("-"), body)
    usable = (key != "") & (body != "") & ~value.rlike("[=,]") & tag.rlike(TAG_PATTERN)
    return F.when(usable, tag)


def select_env(env: Column, patterns: list[str]) -> Column:
    """Map entries whose name is listed exactly or starts with a ``PREFIX*`` pattern."""
    cleaned = [p.strip() for p in patterns]
    cleaned = [p for p in cleaned if p and p != "*"]
    exact = [p for p in cleaned if not p.endswith("*")]
    heads = [p[:-1] for p in cleaned if p.endswith("*")]

    def wanted(name: Column, _value: Column) -> Column:
        test = name.isin(exact) if exact else F.lit(False)
        for head in heads:
            test = test | name.startswith(head)
        return test

    return F.map_filter(env, wanted)


def env_attributes(env: Column) -> Column:
    """Names lower-cased with ``_`` read as ``.``."""
    return F.transform_keys(env, lambda k, _v: F.translate(F.lower(k), "_", "."))


def env_values(env: Column) -> Column:
    """Sorted distinct non-empty values."""
    return F.array_sort(F.array_distinct(F.filter(F.map_values(env), lambda v: v != "")))


def strip_synthetic_prefix(text: Column) -> Column:
    """Text after the leading generated blocks; an unclosed block hides everything."""
    names = "|".join(SYNTHETIC_TAGS)
    opening = rf"<(?:{names})>|<{SYNTHETIC_TAG_WITH_FIELDS}|{INSTRUCTIONS_HEAD}"
    closed = (
        rf"<({names})>.*?</\1>|<({SYNTHETIC_TAG_WITH_FIELDS}[^\s>]*)[^>]*>.*?</\2>|{INSTRUCTIONS_HEAD}.*?</INSTRUCTIONS>"
    )
    rest = strip(F.regexp_replace(strip(text), rf"(?s)^(?:(?:{closed})\s*)+", ""))
    return F.when(rest.rlike(rf"^(?:{opening})"), F.lit("")).otherwise(rest)


def envelope_json(text: Column) -> Column:
    """First fenced JSON object as VARIANT, NULL when absent or unreadable."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, FENCE_PATTERN, 1), F.lit("")))


def envelope_narrative(text: Column) -> Column:
    """The text around the fenced block, or all of it when the block is unreadable."""
    before = F.regexp_extract(text, r"(?s)^(.*?)```json\s*\{.*?\}\s*```", 1)
    after = F.regexp_extract(text, r"(?s)^.*?```json\s*\{.*?\}\s*```(.*)$", 1)
    narrative = strip(F.concat(before, after))
    return F.when(envelope_json(text).isNotNull(), narrative).otherwise(F.coalesce(text, F.lit("")))


def condense_event(seq: Column, t: Column, tool: Column, command: Column, prompt: Column, reply: Column) -> Column:
    """One timeline line: seq, type and what the event was about, cut at 80."""
    about = (
        F.when(t == "tool_call", F.concat(F.coalesce(tool, F.lit("?")), F.lit(": "), F.substring(F.coalesce(command, F.lit("")), 1, 80)))
        .when(t == "user_message", F.substring(F.coalesce(prompt, F.lit("")), 1, 80))
        .when(t == "assistant_message", F.substring(F.coalesce(reply, F.lit("")), 1, 80))
        .when(t == "tool_result", F.coalesce(tool, F.lit("?")))
        .otherwise(F.lit(""))
    )
    return F.format_string("%-4d %-20s %s", seq, t, about)
