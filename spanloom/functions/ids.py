"""Identifiers and digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percent_quote(text: Column) -> Column:
    """Percent-encoding with nothing left safe but letters, digits and ``_.-~``."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys and compact separators, non-ASCII kept.

    Python's number and escape rules decide the bytes that stored digests cover, so this
    one step runs in Arrow batches.
    """
    keep = {"sort_keys": True, "separators": (",", ":"), "ensure_ascii": False}
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), **keep))


def content_revision(json_text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(json_text), 256))


def digest(*columns: Column) -> Column:
    """Digest of plain columns that never leaves the JVM; for ids made and read here."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256))


def span_id(key: Column, size: int = 8, person: str = "") -> Column:
    """blake2b id of ``key`` as hex; ``person`` must be the writer's to match ids made elsewhere."""

    @F.pandas_udf(T.StringType())
    def run(keys: pd.Series) -> pd.Series:
        def one(k: str | None) -> str | None:
            if k is None:
                return None
            raw = hashlib.blake2b(k.encode(), digest_size=size, person=person.encode()).digest()
            return (raw if any(raw) else (1).to_bytes(size, "big")).hex()

        return keys.map(one)

    return run(key)


def trace_key(platform: Column, session: Column) -> Column:
    return F.concat_ws("/", platform, session)


def span_key(platform: Column, session: Column, kind: str, name: Column | None = None) -> Column:
    parts = [platform, session, F.lit(kind)]
    return F.concat_ws("/", *parts) if name is None else F.concat_ws("/", *parts, name.cast("string"))


def child_generation_id(call_id: Column) -> Column:
    """UUID-shaped id of the generation a dispatched child runs under."""

    def shaped(h: Column) -> Column:
        variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(h.substr(17, 1), 16, 10).cast("int") % 4 + 1))
        return F.concat(
            h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-4"), h.substr(14, 3), F.lit("-"), variant, h.substr(18, 3), F.lit("-"), h.substr(21, 12)
        )

    # As the argument of a function the digest is made once, not for each of its parts.
    digest_ = F.array(F.sha2(F.concat(F.lit("subagent-request-"), call_id), 256))
    return F.when(call_id == "", F.lit("")).otherwise(F.element_at(F.transform(digest_, shaped), 1))


def provider_of(model: Column) -> Column:
    name = F.lower(model)
    return (
        F.when(name.contains("claude"), "anthropic")
        .when(name.contains("gemini"), "gcp.gemini")
        .when(name.contains("deepseek"), "deepseek")
        .when(name.contains("grok"), "x_ai")
        .when(name.rlike("^(gpt-|o1|o3|o4)"), "openai")
        .otherwise("")
    )


def agent_name(platform: Column, model: Column) -> Column:
    """``name[model]``, or the bare name when no model is known."""
    name = F.coalesce(*[F.when(platform == k, v) for k, v in AGENT_NAMES.items()], platform)
    return F.when(F.coalesce(model, F.lit("")) != "", F.concat(name, F.lit("["), model, F.lit("]"))).otherwise(name)


# Agent name and default provider of a platform's spans.
AGENT_NAMES = {"claude": "claude-code", "cursor": "cursor"}
PROVIDER_NAMES = {"claude": "anthropic", "codex": "openai"}
