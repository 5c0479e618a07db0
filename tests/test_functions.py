"""Scalar expressions."""

import hashlib
import json
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ids, payload, text, times


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols) or "x string"
    df = spark.createDataFrame([tuple(cols.values()) or ("",)], schema)
    return df.select(expr.alias("r")).first().r


NOW = datetime(2026, 8, 22, 12, 30, tzinfo=UTC)


def test_parse_when():
    p = lambda s: times.parse_when(s, now=NOW)
    assert p(None) is None
    assert p("2d") == datetime(2026, 8, 20, 12, 30, tzinfo=UTC)
    assert p("90m") == datetime(2026, 8, 22, 11, 0, tzinfo=UTC)
    assert p("today") == datetime(2026, 8, 22, tzinfo=UTC)
    assert p("yesterday") == datetime(2026, 8, 21, tzinfo=UTC)
    assert p("2026-01-02") == datetime(2026, 1, 2, tzinfo=UTC)
    assert p("2026-01-02T03:00:00+02:00") == datetime(2026, 1, 2, 1, tzinfo=UTC)
    for bad in ("", "soon", "2x"):
        with pytest.raises(ValueError):
            p(bad)


def test_times(spark):
    assert one(spark, times.parse_ts(F.col("a")), a="nope") is None
    assert one(spark, times.parse_ts(F.col("a")), a="2026-01-02T03:04:05Z") == datetime(2026, 1, 2, 3, 4, 5)
    assert one(spark, times.valid_datetime(F.col("a")), a="2026-01-02") is None
    assert one(spark, times.valid_datetime(F.col("a")), a="2026-01-02T03:04") == datetime(2026, 1, 2, 3, 4)
    end = F.lit("2026-01-01 00:00:10").cast("timestamp")
    assert one(spark, times.start_from_duration(end, F.lit("2500"))) == datetime(2026, 1, 1, 0, 0, 7, 500000)
    assert one(spark, times.start_from_duration(end, F.lit("-1"))) == datetime(2026, 1, 1, 0, 0, 10)
    assert one(spark, times.minus_parts(end, F.lit(1), F.lit(500_000_000))) == datetime(2026, 1, 1, 0, 0, 8, 500000)


def test_snippet(spark):
    long = "a" * 100 + "Needle" + "b" * 100
    assert one(spark, text.snippet(F.col("a"), "nEEdle"), a=long) == "…" + "a" * 40 + "Needle" + "b" * 40 + "…"
    assert one(spark, text.snippet(F.col("a"), "x"), a=long) == long[:80]
    assert one(spark, text.snippet(F.col("a"), "hi"), a="hi you") == "hi you"


def test_tags(spark):
    got = one(spark, text.extract_hashtags(F.col("a")), a="See #Foo, #foo and x#no #été #ok-1 #Ünï # #9no")
    assert got == ["foo", "ok-1"]
    assert one(spark, text.validate_tag(F.col("a")), a=" ok.tag ") == "ok.tag"
    assert one(spark, text.validate_tag(F.col("a")), a="Bad") is None
    tag = text.env_to_tag(F.col("n"), F.col("v"))
    assert one(spark, tag, n="WB_PLAN", v="My  Plan!") == "plan-my-plan"
    assert one(spark, tag, n="X", v="a=b") is None
    assert one(spark, tag, n="WB_", v="v") is None
    env = F.create_map(F.lit("WB_A"), F.lit("1"), F.lit("HOME"), F.lit("/h"), F.lit("X"), F.lit(""))
    assert one(spark, text.select_env(env, ["WB_*", " X ", "*"])) == {"WB_A": "1", "X": ""}
    assert one(spark, text.env_attributes(env)) == {"wb.a": "1", "home": "/h", "x": ""}
    assert one(spark, text.env_values(env)) == ["/h", "1"]


def test_synthetic_prefix(spark):
    strip = text.strip_synthetic_prefix(F.col("a"))
    assert one(spark, strip, a="<environment_context>x</environment_context>\n hello") == "hello"
    assert one(spark, strip, a="# AGENTS.md instructions\n<INSTRUCTIONS>a</INSTRUCTIONS> go") == "go"
    assert one(spark, strip, a="<in-app-browser-context id=1>x</in-app-browser-context>typed") == "typed"
    assert one(spark, strip, a="<task-notification>never closed") == ""
    assert one(spark, strip, a="plain <environment_context>") == "plain <environment_context>"


def test_envelope(spark):
    doc = 'Intro\n```json\n{"verdict": "pass"}\n```\nOutro'
    assert json.loads(one(spark, F.to_json(text.envelope_json(F.col("a"))), a=doc)) == {"verdict": "pass"}
    assert one(spark, text.envelope_narrative(F.col("a")), a=doc).split() == ["Intro", "Outro"]
    bad = "```json\n{oops}\n```"
    assert one(spark, text.envelope_json(F.col("a")), a=bad) is None
    assert one(spark, text.envelope_narrative(F.col("a")), a=bad) == bad


def test_ids(spark):
    raw = '{"b": 1.0, "a": "é", "c": [1, null]}'
    canon = json.dumps(json.loads(raw), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, ids.content_revision(F.col("a")), a=raw) == "sha256:" + hashlib.sha256(canon.encode()).hexdigest()
    want = hashlib.blake2b(b"p/s/turn/3", digest_size=8, person=b"someone").hexdigest()
    assert one(spark, ids.span_id(ids.span_key(F.lit("p"), F.lit("s"), "turn", F.lit(3)), person="someone")) == want
    gid = one(spark, ids.child_generation_id(F.col("a")), a="call_1")
    digest = bytearray(hashlib.sha256(b"subagent-request-call_1").digest()[:16])
    assert gid == str(uuid.UUID(bytes=bytes(digest), version=4))
    assert one(spark, ids.percent_quote(F.col("a")), a="a b*c~/é:") == "a%20b%2Ac~%2F%C3%A9%3A"
    assert one(spark, ids.provider_of(F.col("a")), a="GPT-5") == "openai"
    assert one(spark, ids.agent_name(F.lit("claude"), F.col("a")), a="m") == "claude-code[m]"


def test_payloads(spark):
    p = F.try_parse_json("a")
    assert one(spark, payload.first_key(p, "x", "y"), a='{"x": "", "y": 3}') == "3"
    assert one(spark, payload.metric_number(p, "n"), a='{"n": 3.0}') == 3
    for bad in ('{"n": true}', '{"n": -1}', '{"n": 1.5}', '{"n": "3"}', "{}"):
        assert one(spark, payload.metric_number(p, "n"), a=bad) is None
    assert one(spark, payload.integer(p, "n"), a='{"n": 7}') == 7
    one_key = one(spark, payload.semantic_value(p, ("command", "path")), a='{"command": "{\\"k\\": 1}"}')
    assert json.loads(one_key) == {"k": 1}
    both = one(spark, payload.semantic_value(p, ("command", "path")), a='{"command": "ls", "path": "/x"}')
    assert json.loads(both) == {"command": "ls", "path": "/x"}
    assert one(spark, payload.status_word(F.col("a")), a="Cancelled") == "interrupted"
    assert one(spark, payload.status_word(F.col("a"), interruptions=False), a="Cancelled") == "completed"
    assert one(spark, payload.foreign_reason(p, "claude"), a='{"composer_mode": 1}') == "Cursor marker composer_mode present"
    assert one(spark, payload.foreign_reason(p, "copilot"), a='{"hook_event_name": "agentStop"}') is None
    assert one(spark, payload.foreign_reason(p, "cursor"), a='{"hook_event_name": "Stop"}') == "PascalCase event Stop received for cursor"
