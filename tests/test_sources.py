"""Readers over small synthetic files whose totals are known."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import tags as tag_ops
from spanloom.operators import usage
from spanloom.sources import claude, codex, copilot, jsonl, tables

# (raw input, cache read, cache write, output); the last call comes as six frames
CALLS = [
    (2, 21106, 20317, 465), (2, 41423, 1043, 202), (2, 42466, 606, 86), (2, 43072, 127, 115), (2, 43199, 2835, 277), (2, 46034, 341, 145), (2, 254643, 504, 3195),
]


def claude_lines():
    out = [{"type": "user", "timestamp": "2026-08-01T10:00:00.000Z", "message": {"role": "user", "content": "go"}}]
    clock = 1
    for n, (raw, read, wrote, said) in enumerate(CALLS):
        for i in range(6 if n == len(CALLS) - 1 else 1):
            out.append({
                "type": "assistant", "timestamp": f"2026-08-01T10:00:{clock:02d}.000Z", "requestId": None if n == 0 else f"r{n}", "uuid": f"u{n}{i}",
                "message": {"id": f"m{n}", "model": "claude-x", "usage": {"input_tokens": raw, "cache_read_input_tokens": read, "cache_creation_input_tokens": wrote, "output_tokens": said},
                            "content": [{"type": "tool_use", "id": f"t{n}{i}", "name": "Bash", "input": {"command": "ls"}}]},
            })
            clock += 1
    out.append({"type": "assistant", "timestamp": "2026-08-01T10:00:50.000Z", "message": {"id": "m9", "model": "<synthetic>", "usage": {"input_tokens": 0, "output_tokens": 0}, "content": []}})
    return out


def test_claude_golden(lines):
    frames = jsonl.json_frames(lines([*claude_lines(), "", "{broken", "[1]"]))
    raw = claude.usage_rows(frames)
    assert raw.count() == 12
    calls = usage.dedup_calls(raw)
    assert calls.count() == 7
    total = usage.call_totals(calls).first()
    assert (total.input_tokens, total.output_tokens) == (517730, 4485)
    grouped = claude.grouped_frames(frames, width=64)
    rows = {r.call_id: r for r in claude.calls(grouped).collect()}
    assert len(rows) == 7 and rows["m6"].frames == 6
    assert rows["m0"].start_ts.second == 0 and rows["m0"].end_ts.second == 1
    assert rows["m6"].start_ts.second == 6 and rows["m6"].end_ts.second == 12
    parts = claude.parts(frames, grouped)
    assert claude.tool_mentions(parts).count() == 12
    assert claude.input_roles(parts).first().input_role == "user"
    assert claude.first_input(parts).first().input_message == "go"


TOKENS = [(21243, 21039, 2432, 204), (45591, 21300, 20864, 3048), (85029, 39233, 24960, 205), (125123, 40021, 38784, 73)]


def rollout_lines(turn="t1"):
    out = [{"timestamp": "2026-08-01T10:00:00Z", "type": "turn_context", "payload": {"turn_id": turn, "model": "gpt-x"}},
           {"timestamp": "2026-08-01T10:00:01Z", "type": "event_msg", "payload": {"type": "user_message", "message": "fix it"}}]
    for n, (mark, i, c, o) in enumerate(TOKENS):
        out.append({"timestamp": f"2026-08-01T10:0{n + 1}:00Z", "type": "response_item", "payload": {"type": "function_call", "call_id": f"c{n}", "name": "shell", "arguments": "{}"}})
        token = {"timestamp": f"2026-08-01T10:0{n + 1}:10Z", "type": "event_msg", "payload": {"type": "token_count", "info": {
            "last_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "total_tokens": i + o}, "total_token_usage": {"total_tokens": mark}}}}
        out += [token, token] if n == 1 else [token]
        out.append({"timestamp": f"2026-08-01T10:0{n + 1}:20Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": f"c{n}", "output": f"o{n}"}})
    out.append({"timestamp": "2026-08-01T10:09:00Z", "type": "event_msg", "payload": {"type": "task_complete", "turn_id": turn, "last_agent_message": "done"}})
    return out


def test_codex_golden(lines):
    frames = codex.rollout_frames(lines([*rollout_lines(), '{"type": "event_msg"'], platform="codex", end=""))
    rows = codex.usage_rows(frames, width=64)
    assert rows.count() == 5
    calls = usage.dedup_calls(rows)
    total = usage.call_totals(calls).first()
    assert (calls.count(), total.input_tokens, total.output_tokens) == (4, 121593, 3530)
    assert calls.where("cache_creation_input_tokens is not null").count() == 0
    assert {r.response_model for r in rows.collect()} == {"gpt-x"}
    kinds = [r.t for r in codex.events(frames).orderBy("pos").collect()]
    assert kinds.count("tool_call") == 4 and kinds.count("tool_result") == 4 and kinds[0] == "notification"
    messages = codex.normal_messages(codex.turn_frames(frames))
    turn = codex.turns(messages).first()
    assert (turn.user_prompt, turn.assistant_output, turn.status, turn.model) == ("fix it", "done", "completed", "gpt-x")
    placed = codex.call_frames(messages, width=64)
    got = codex.calls(placed).orderBy("call_no").collect()
    assert [(r.call_no, r.input_tokens, r.output_tokens) for r in got] == [(n, i, o) for n, (_, i, _, o) in enumerate(TOKENS)]
    assert {r.tool_use_id: r.result for r in codex.tool_spans(placed).collect()} == {f"c{n}": f"o{n}" for n in range(4)}


def test_byte_offsets_and_unfinished_line(lines):
    got = jsonl.complete_lines(lines(['{"a":"é"}', "", '{"b":1}', '{"c":'], end="")).orderBy("pos").collect()
    assert [(r.byte_offset, r.byte_length) for r in got] == [(0, 11), (11, 1), (12, 8)]


def usage_line(call, tokens, **extra):
    return {"session_id": "s1", "seq": 1, "call_id": call, "ts": "2026-08-01T00:00:00Z", "platform": "claude", "gen_ai.provider.name": "anthropic", "gen_ai.operation.name": "chat",
            "gen_ai.response.model": "m", "gen_ai.usage.input_tokens": tokens, "gen_ai.usage.output_tokens": 1, **extra}


def test_usage_mirror(lines):
    bad = usage_line("x", 5)
    del bad["gen_ai.response.model"]
    df = tables.usage_rows(lines([usage_line("a", 1), usage_line("b", 7, **{"gen_ai.usage.cache_read.input_tokens": 0}), bad, "", "nope", usage_line("a", 3)]))
    assert df.count() == 3
    rows = {r.call_id: r for r in usage.dedup_calls(df).collect()}
    assert rows["a"].input_tokens == 3 and rows["a"].cache_read_input_tokens is None and rows["b"].cache_read_input_tokens == 0


def test_tag_log(lines):
    ops = tables.tag_ops(lines([
        {"seq": 0, "tag": "x", "op": "add"}, {"seq": 0, "tag": "x", "op": "remove"}, {"seq": 1, "tag": "x", "op": "add"}, {"seq": 1, "tag": "y", "op": "add"},
        {"seq": 1, "tag": "y", "op": "zap"}, {"tag": "z", "op": "add"}, "broken",
    ]))
    assert {(r.seq, r.tag) for r in tag_ops.effective_tags(ops).collect()} == {(1, "x"), (1, "y")}


def test_evals(lines):
    df = tables.evals(lines([
        {"id": "1", "session_id": "s1", "definition": "d", "agent": "a", "started_at": "2026-08-01T00:00:00Z", "ended_at": "x", "verdict": "meh", "scores": {"overall": 4}, "findings": [{"seq": 2, "severity": "odd", "note": "n"}, {"severity": "warn"}]},
        {"id": "2", "definition": "d", "agent": "a"},
    ]))
    row = df.first()
    assert df.count() == 1 and row.verdict == "unknown" and row.scores == {"overall": 4.0}
    assert [(f.seq, f.severity, f.category, f.note) for f in row.findings] == [(2, "info", "", "n"), (None, "warn", "", "")]


def test_events_stop_at_broken_record(lines):
    df = lines([{"t": "user_message", "ts": "2026-08-01T00:00:00Z", "seq": 0, "data": "hi"}, {"t": "x", "ts": "bad", "seq": 1}, "{oops", {"t": "y", "seq": 2}])
    rows = tables.events(tables.until_broken(df)).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1] and rows[1].data is None and rows[1].ts is None
    assert tables.truncated_sessions(df).count() == 1


def test_session_import(spark, tmp_path):
    folder = tmp_path / "claude" / "s1"
    folder.mkdir(parents=True)
    (folder / "meta.yaml").write_text("session_id: s1\nplatform: claude\ncwd: /p\nstarted_at: '2026-08-01T00:00:00Z'\nstatus: open\n")
    row = tables.import_sessions(spark, str(folder / "meta.yaml")).first()
    assert (row.session_id, row.event_count, row.last_seq, row.tag_count, row.last_ts) == ("s1", 0, -1, 0, None)


def test_errors(lines):
    df = tables.capture_errors(lines([{"ts": f"2026-08-0{i}T00:00:00Z", "platform": "claude" if i % 2 else "codex", "phase": "p", "message": str(i)} for i in range(1, 8)]))
    assert [r.message for r in tables.last_errors(df, 2, platform="claude", until="2026-08-06").collect()] == ["3", "5"]


def test_cursor_transcript(lines):
    frames = jsonl.json_frames(lines([
        {"role": "user", "message": {"content": [{"type": "text", "text": " Inspect the sample module "}]}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "wait"}]}},
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "The sample"}, {"type": "image"}, {"type": "text", "text": "module is valid."}]}}, {"type": "turn_ended"}, "junk",
    ], platform="cursor"))
    said = tables.transcript_messages(frames)
    row = tables.transcript_summary(said).first()
    assert (row.input_text, row.output_text) == ("Inspect the sample module", "The sample\nmodule is valid.")
    assert tables.latest_transcript_turn(said).first().user_messages == 1


def test_hooks(spark):
    data = [("Stop", json.dumps({"sessionId": "n1", "timestamp": 1_785_542_400_000}), "{}", "o1"), ("preToolUse", json.dumps({"sessionId": "n1", "timestamp": "later"}), '{"env": {"A": "1"}, "x": 1}', "o2"), ("Stop", "{}", "{}", "o3")]
    df = spark.createDataFrame([("copilot", "n1", e, p, c, o, "2026-08-01T00:00:00Z") for e, p, c, o in data], "platform string, session_id string, event string, p string, c string, observation_id string, observed_at string")
    df = df.withColumns({"payload": F.try_parse_json("p"), "context": F.try_parse_json("c")})
    rows = tables.hook_records(df).orderBy("observation_id").collect()
    assert [(r.source_id, r.event, r.ts) for r in rows] == [("hook/n1/o1", "agentStop", "2026-08-01T00:00:00.000Z"), ("hook/n1/o2", "preToolUse", None)]
    assert json.loads(rows[1].context) == {"env": {"A": "1"}}


def test_transcript_evidence(lines):
    src = lines([{"id": "e1", "type": "user.message", "timestamp": "2026-08-01T00:00:00Z"}, {"type": "x", "timestamp": "bad"}, "{oops", "[1]", '{"id": "late"'], platform="copilot", session="n1", end="")
    rec = copilot.transcript_records(src, F.lit("key"), F.lit("gen"), F.lit("now"))
    rows = rec.orderBy("pos").collect()
    assert [r.malformed for r in rows] == [None, None, "invalid_json", "non_object_json"]
    assert rows[0].source_id == "key/n1/e1" and rows[1].source_id.startswith("key/n1/gen/") and rows[1].bad_ts
    codes = [r.code for r in copilot.transcript_diagnostics(rec).collect()]
    assert sorted(codes) == ["transcript_invalid_json", "transcript_invalid_timestamp", "transcript_non_object"]


def test_export(spark, tmp_path):
    sessions = spark.createDataFrame([("p", "a", "/x"), ("p", "b", "/y")], "platform string, session_id string, cwd string")
    events = spark.createDataFrame([("p", "a", i, "t") for i in range(25)], "platform string, session_id string, seq bigint, t string")
    assert tables.export_cases(sessions, events, str(tmp_path / "out"), per_part=10) == 2
    cases = {r.session_id: r.n_events for r in spark.read.json(str(tmp_path / "out/cases")).collect()}
    assert cases == {"a": 25, "b": 0} and spark.read.json(str(tmp_path / "out/parts")).count() == 3
    with pytest.raises(LookupError):
        tables.export_cases(sessions.where("false"), events, str(tmp_path / "none"))


def test_logs_come_back_in_order_over_several_parts(spark, tmp_path):
    rows = [("claude", "s-1", i * 1000, f"line {i}") for i in range(25)] + [("codex", "s~2", 1, None), ("codex", "s~2", 2, "last")]
    jsonl.write_logs(spark.createDataFrame(rows, "platform string, session_id string, at long, line string"), f"{tmp_path}/logs", "at", part_rows=10)
    got = jsonl.read_logs(spark, f"{tmp_path}/logs")
    one = got.where("session_id = 's-1'").orderBy("pos").collect()
    assert [r.line for r in one] == [f"line {i}" for i in range(25)]
    assert [r.part for r in one] == [0] * 10 + [1] * 10 + [2] * 5
    assert [r.line for r in got.where("platform = 'codex' and session_id = 's~2'").orderBy("pos").collect()] == ["", "last"]
    # Offsets are those of each part's own file.
    placed = jsonl.complete_lines(got.where("session_id = 's-1'")).orderBy("pos").collect()
    assert [r.byte_offset for r in placed][:3] == [0, 7, 14] and placed[10].byte_offset == 0


def test_many_logs_share_files(spark, tmp_path):
    rows = spark.range(600).selectExpr("'claude' as platform", "concat('s/', id div 2) as session_id", "id as at", "concat('line ', id, case when id % 2 = 1 then '' else '\\n' end) as line")
    jsonl.write_logs(rows, f"{tmp_path}/logs", "at", line_sep=" ")
    assert len([p for p in (tmp_path / "logs").rglob("part-*")]) == 1
    got = jsonl.read_logs(spark, f"{tmp_path}/logs")
    assert {(r.session_id, r.line) for r in got.collect()} == {(f"s/{i // 2}", f"{' ' * (i % 2)}line {i}{' ' * (i % 2)}") for i in range(600)}
    # The last line of each log lacks its newline.
    done = jsonl.complete_lines(got).collect()
    assert {(r.line, r.byte_offset) for r in done} == {(f"line {i}", 0) for i in range(0, 600, 2)}


def test_parsed_columns_are_not_copied_into_filters(spark):
    from spanloom.sources import codex, star_frames, tables
    from spanloom.sources.jsonl import json_frames

    lines = spark.createDataFrame([("a", "s", "f", 1, '{"platform": "a", "session_id": "s", "call_id": "c", "seq": 1}'), ("a", "s", "f", 2, "[1]"), ("a", "s", "f", 3, None)], "platform string, session_id string, file string, pos long, line string")
    for rows in (codex.events(star_frames.codex_frames(spark, "/root/testdata/sf0.001")), tables.usage_rows(lines)):
        below = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[1]
        assert "Filter" not in below
    assert [r.pos for r in json_frames(lines).collect()] == [1]
