"""Accounting and attribution of the six-call session, and turn assembly of a small transcript."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import accounting as A
from spanloom.operators import attribution as AT
from spanloom.plans import copilot_turns
from spanloom.sources import copilot

SIX = [  # id, turn, agent, in, out, read, write, reason, nano, initiator, finish
    (13, 0, None, 6452, 107, 0, 6449, 29, 174125000, "user", "tool_calls"),
    (14, 0, None, 6587, 5, 6449, 135, 0, 16933000, "agent", "stop"),
    (15, 1, None, 6627, 112, 6449, 175, 10, 30773000, "user", "tool_calls"),
    (16, 1, "bf8c", 4429, 94, 0, 4426, 16, 121990000, "sub-agent", "tool_calls"),
    (17, 1, "bf8c", 4551, 5, 4426, 122, 0, 12562000, "sub-agent", "stop"),
    (18, 1, None, 6750, 5, 6624, 123, 0, 16983000, "agent", "stop"),
]
NAMES = ["id", "turn_index", "agent_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "total_nano_aiu", "initiator", "finish_reason"]


def snapshot(spark, rows):
    data = []
    for pos, (gen, row) in enumerate(rows):
        doc = {k: v for k, v in zip(NAMES, row, strict=True) if v is not None} | {"model": "m", "created_at": "2026-08-01T00:00:00Z"}
        if row[2]:
            doc["parent_tool_call_id"] = "task"
        data.append(("copilot", "n", pos, str(row[0]), gen, json.dumps(doc)))
    df = spark.createDataFrame(data, "platform string, session_id string, pos bigint, pk string, generation string, row_json string")
    return A.row_metrics(copilot.usage_snapshot(df, F.lit("k"), F.col("generation")))


def block(i, o, r, w, t, n):
    return {"m": {"usage": {"inputTokens": i, "outputTokens": o, "cacheReadTokens": r, "cacheWriteTokens": w, "reasoningTokens": t}, "totalNanoAiu": float(n)}}


def shutdown(spark, session):
    agents = {"main": {"modelMetrics": block(26416, 229, 19522, 6882, 39, 238814000)}, "bf8c": {"modelMetrics": block(8980, 99, 4426, 4548, 16, 134552000)}}
    doc = {"type": "session.shutdown", "data": {"modelMetrics": session, "agentMetrics": agents}}
    df = spark.createDataFrame([("copilot", "n", "shut", json.dumps(doc))], "platform string, session_id string, source_id string, p string")
    return A.shutdown_totals(df.withColumn("payload", F.try_parse_json("p")))


def test_totals_match_shutdown(spark):
    current = A.current_revisions(snapshot(spark, [("g", r) for r in SIX]))
    sums = {r.agent if not r.whole else "*": r for r in A.accounted_metrics(current).collect()}
    assert [sums["*"][m] for m in A.METRICS] == [35396, 328, 23948, 11430, 55, 373366000]
    good = shutdown(spark, block(35396, 328, 23948, 11430, 55, 373366000))
    assert A.shutdown_mismatch(good, A.accounted_metrics(current)).count() == 0
    off = A.shutdown_mismatch(shutdown(spark, block(1, 328, 23948, 11430, 55, 373366000)), A.accounted_metrics(current)).collect()
    assert [(r.agent, r.expected_input_tokens, r.accounted_input_tokens) for r in off] == [(None, 1, 35396)]
    broken = block(1, 2, 3, 4, 5, 6)
    del broken["m"]["usage"]["inputTokens"]
    assert not any(r.readable for r in shutdown(spark, broken).collect())


def test_revisions_and_quarantine(spark):
    fixed = (13, 0, None, 9000, 107, 0, 6449, 29, 1, "user", "tool_calls")
    bad = (14, 0, None, 10, 5, 6449, 135, 0, 1, "agent", "stop")
    rows = {r.primary_key: r for r in A.current_revisions(snapshot(spark, [("g", r) for r in SIX[:3]] + [("g", fixed), ("g", bad), ("h", SIX[2])])).where("generation = 'g'").collect()}
    assert rows["13"].input_tokens == 9000 and rows["13"].quarantine is None
    assert rows["14"].quarantine == "usage_revision_conflict"
    assert rows["15"].quarantine == "usage_row_id_reuse"


CALLS = [  # pos, id, interaction, agent, native turn, tool
    (1, "c1", "i1", None, "0", "t1"), (2, "c2", "i1", None, "1", None), (3, "c3", "i2", None, "0", "task"),
    (4, "c4", "i2", "bf8c", "0", "t4"), (5, "c5", "i2", "bf8c", "1", None), (6, "c6", "i2", None, "1", None),
]


def attribution_tables(spark):
    calls = spark.createDataFrame(
        [("copilot", "n", p, c, f"turn-{i}" + (f"-{a}" if a else ""), i, a, "task" if a else None, t, "m", f"2026-08-01T00:00:0{p}Z", tool is None) for p, c, i, a, t, tool in CALLS],
        "platform string, session_id string, pos bigint, call_id string, stored_turn_id string, interaction_id string, agent_id string, parent_tool_call_id string, native_turn_id string, model string, start_ts string, has_finish boolean",
    )
    tools = spark.createDataFrame([("copilot", "n", c, tool) for _, c, _, _, _, tool in CALLS if tool], "platform string, session_id string, call_id string, tool_call_id string")
    usage = A.current_revisions(snapshot(spark, [("g", r) for r in SIX])).withColumn("pk", F.col("primary_key").cast("bigint")).withColumnRenamed("source_id", "usage_source_id")
    return calls, tools, usage


def test_six_calls_match_in_order(spark):
    calls, tools, usage = attribution_tables(spark)
    got = AT.attribute_usage(calls, tools, usage)
    rows = {r.logical_call_id.rsplit(":", 1)[1]: r for r in got.collect()}
    assert {k: (r.call_id, r.status, r.join_kind) for k, r in rows.items()} == {str(12 + n): (f"c{n}", "matched", "inferred") for n in range(1, 7)}
    assert rows["16"].stored_turn_id == "turn-i2" and rows["16"].agent_id == "bf8c"
    placed = AT.place_accounting(got, calls, calls.selectExpr("platform", "session_id", "stored_turn_id as turn_id"))
    assert {r.owner_turn_id for r in placed.collect()} == {"turn-i1", "turn-i2", "turn-i2-bf8c"}


def test_conflicts_and_pending(spark):
    calls, tools, usage = attribution_tables(spark)
    cut = calls.where("call_id not in ('c3', 'c4', 'c5', 'c6')")
    rows = {r.logical_call_id.rsplit(":", 1)[1]: r.status for r in AT.attribute_usage(cut, tools.where("call_id = 'c1'"), usage).collect()}
    assert rows == {"13": "matched", "14": "matched", "15": "pending", "16": "pending", "17": "pending", "18": "pending"}
    ids = usage.selectExpr("platform", "session_id", "logical_call_id", "'x' as native_id").where("logical_call_id like '%:13' or logical_call_id like '%:18'")
    named = calls.selectExpr("platform", "session_id", "call_id", "'x' as native_id").where("call_id = 'c2'")
    rows = {r.logical_call_id.rsplit(":", 1)[1]: r.status for r in AT.attribute_usage(calls, tools, usage, usage_ids=ids, call_ids=named).collect()}
    assert rows["13"] == rows["18"] == rows["14"] == "conflicting" and rows["15"] == "matched"


def transcript(spark, records):
    data = []
    for pos, (kind, agent, body) in enumerate(records):
        doc = {"type": kind, "data": body} | ({"agentId": agent} if agent else {})
        data.append(("copilot", "n", pos, f"e{pos}", "transcript", f"2026-08-01T00:00:{pos:02d}Z", None, json.dumps(doc)))
    df = spark.createDataFrame(data, "platform string, session_id string, pos bigint, source_id string, source_kind string, ts string, event string, p string")
    return copilot.normalize(df.withColumn("payload", F.try_parse_json("p")))


def ix(i, turn=None, **extra):
    return {"interactionId": i} | ({"turnId": turn} if turn is not None else {}) | extra


def test_turn_assembly(spark):
    events = transcript(spark, [
        ("user.message", None, ix("i1", content="do it")),
        ("assistant.turn_start", None, ix("i1", "0")),
        ("assistant.message", None, ix("i1", "0", content="", model="m", toolRequests=[{"toolCallId": "task", "name": "task"}])),
        ("assistant.turn_end", None, {"turnId": "0"}),
        ("tool.execution_start", None, {"toolCallId": "task", "toolName": "task"}),
        ("subagent.started", "kid", {"toolCallId": "task"}),
        ("user.message", "kid", ix("i1", content="child")),
        ("assistant.message", "kid", ix("i1", "0", content="ok", phase="final_answer")),
        ("subagent.completed", "kid", {"toolCallId": "task"}),
        ("tool.execution_complete", None, {"toolCallId": "task", "success": True}),
        ("permission.request", None, ix("i1", toolName="shell")),
        ("permission.decision", None, ix("i1", toolName="shell", decision="allow")),
        ("assistant.turn_start", None, ix("i1", "1")),
        ("assistant.message", None, ix("i1", "1", content="all done", phase="final_answer")),
        ("assistant.turn_end", None, ix("i1", "1")),
        ("user.message", None, ix("i2", content="more")),
        ("assistant.message", None, ix("i2", "0", content="half")),
        ("abort", None, ix("i2", "0")),
        ("user.message", None, ix("i3", content="open")),
        ("assistant.turn_end", None, {"turnId": "7"}),
        ("user.message", None, {"content": "lost"}),
        ("model.title", None, {}),
    ])
    built = copilot_turns.build(events)
    turns = {(r.interaction_id, r.agent): r for r in built["turns"].collect()}
    main, kid = turns["i1", ""], turns["i1", "kid"]
    assert (main.input, main.output, main.status, main.complete, main.end_ts) == ("do it", "all done", "completed", True, "2026-08-01T00:00:14Z")
    assert kid.complete and kid.parent_turn_id == main.turn_id and kid.parent_tool == "task" and kid.end_ts == "2026-08-01T00:00:08Z"
    assert turns["i2", ""].status == "interrupted" and turns["i2", ""].complete
    assert not turns["i3", ""].complete
    calls = {r.source_id: r for r in built["calls"].collect()}
    assert calls["e2"].has_finish and calls["e2"].end_ts == "2026-08-01T00:00:03Z" and calls["e13"].finish_kind == "assistant_turn_end" and not calls["e7"].has_finish
    tool = built["tools"].first()
    assert (tool.tool_call_id, tool.start_ts, tool.end_ts, tool.failed) == ("task", "2026-08-01T00:00:04Z", "2026-08-01T00:00:09Z", False)
    assert [(r.tool_name, r.decision) for r in built["permissions"].collect()] == [("shell", "allow")]
    pending = sorted((r.kind, r.id.split(":")[-1]) for r in built["pending"].collect())
    assert pending == [("missing_identity", "e19"), ("missing_identity", "e20"), ("open_interaction", "i3")]
    assert [r.interaction_id for r in copilot_turns.main_turns(built["turns"]).collect()] == ["i1"]


def test_normal_kinds(spark):
    events = transcript(spark, [("model.x", None, {}), ("weird", None, {}), ("tool.execution_complete", None, {"success": False}), ("some.error", None, {})])
    assert [(r.kind, r.classification) for r in events.orderBy("pos").collect()] == [("auxiliary_model_call", "title_generation"), ("unknown", "main"), ("tool_execution_failure", "main"), ("error", "main")]


def test_null_schema_version_is_unknown(spark):
    docs = [{"type": "session.start"}, {"type": "session.start", "schema_version": copilot.SCHEMA_VERSION}, {"type": "session.start", "schema_version": None}, {"type": "session.start", "schema_version": 99}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "p string").withColumn("payload", F.try_parse_json("p"))
    assert [r[0] for r in df.select(copilot.foreign_version(F.col("payload"))).collect()] == [False, False, True, True]


def test_keys_follow_their_natural_order(spark):
    """Whole numbers by value before any text; the i-th key meets the i-th call."""
    keys = ["9", "10", "100", "011", "a2", "b"]
    calls = spark.createDataFrame(
        [("copilot", "n", p, f"c{p}", "t", "i", None, None, str(p), "m", f"2026-08-01T00:00:0{p}Z", True) for p in range(6)],
        "platform string, session_id string, pos bigint, call_id string, stored_turn_id string, interaction_id string, agent_id string, parent_tool_call_id string, native_turn_id string, model string, start_ts string, has_finish boolean",
    )
    tools = spark.createDataFrame([], "platform string, session_id string, call_id string, tool_call_id string")
    usage = spark.createDataFrame(
        [("copilot", "n", f"u{k}", k, f"s{k}", 0, None, None, "m", None, None) for k in reversed(keys)],
        "platform string, session_id string, logical_call_id string, primary_key string, usage_source_id string, turn_index bigint, agent_id string, parent_tool_call_id string, model string, finish_reason string, initiator string",
    )
    got = {r.logical_call_id: r for r in AT.attribute_usage(calls, tools, usage).collect()}
    assert [got[f"u{k}"].call_id for k in keys] == [f"c{i}" for i in range(6)]
    assert got["u10"].evidence == [
        "join_kind:inferred", "interaction_id:i", "turn_index:0", "agent_id:None", "parent_tool_call_id:None", "model:m", "finish:None", "initiator:None", "order:1", "call_id:c1"
    ]


def test_a_child_of_a_lost_child_is_lost(spark):
    """A completed chain counts only if it leads to a completed main turn; pending items name their records."""
    events = transcript(spark, [
        ("user.message", None, ix("i1", content="go")),
        ("assistant.message", None, ix("i1", "0", content="", toolRequests=[{"toolCallId": "a", "name": "task"}])),
        ("assistant.message", "kid", ix("i1", "0", content="", parentToolCallId="a", toolRequests=[{"toolCallId": "b", "name": "task"}])),
        ("assistant.message", "grand", ix("i1", "0", content="ok", parentToolCallId="b", phase="final_answer")),
        ("assistant.turn_end", "grand", ix("i1", "0")),
        ("subagent.completed", "kid", {"toolCallId": "a"}),
    ])
    built = copilot_turns.build(events)
    turns = {r.agent: r for r in built["turns"].collect()}
    assert turns["grand"].complete and turns["grand"].lost and turns["kid"].lost and not turns[""].complete
    assert {r.agent_id: r.stored_turn_id is None for r in built["calls"].collect()} == {None: False, "kid": True, "grand": True}
    rows = {r.id.rsplit(":", 1)[-1]: r for r in built["pending"].collect()}
    assert rows["grand"].evidence == ["interaction_id:i1", "agent_id:grand"] and rows["i1"].reason == "user interaction has no assistant.turn_end"
    sources = {(r.id.rsplit(":", 1)[-1], r.source_id) for r in built["pending_sources"].collect()}
    assert {("grand", "e3"), ("grand", "e4"), ("kid", "e2"), ("i1", "e0"), ("i1", "e1"), ("a", "e1"), ("b", "e2")} <= sources


def test_shutdown_totals_need_no_shuffle_and_revisions_carry_only_what_is_read(spark):
    from spanloom.operators import accounting

    def block(n):
        return {"usage": {"inputTokens": n, "outputTokens": 1, "cacheReadTokens": 0, "cacheWriteTokens": 0, "reasoningTokens": 0}, "totalNanoAiu": 2.0}

    docs = [
        {"data": {"modelMetrics": {"a": block(3), "b": block(4)}, "agentMetrics": {"main": {"modelMetrics": {"a": block(7)}}}}},
        {"data": {"modelMetrics": {"a": block(3), "b": block("4")}, "agentMetrics": {"main": {"modelMetrics": {"a": block(7)}}}}},
        {"data": {"modelMetrics": {"a": block(3)}, "agentMetrics": {"main": {"modelMetrics": {"a": block(7)}}, "x": {}}}},
        {"data": {}},
    ]
    rows = [("copilot", "s", f"r{i}", json.dumps(x)) for i, x in enumerate(docs)]
    made = spark.createDataFrame(rows, "platform string, session_id string, source_id string, doc string").selectExpr("platform", "session_id", "source_id", "parse_json(doc) as payload")
    totals = accounting.shutdown_totals(made)
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    got = {(r.source_id, r.agent): (r.readable, r.input_tokens, r.total_nano_aiu) for r in totals.collect()}
    assert got == {
        ("r0", None): (True, 7, 4), ("r0", "main"): (True, 7, 2), ("r1", None): (False, 3, 4), ("r1", "main"): (False, 7, 2), ("r2", None): (True, 3, 2), ("r2", "main"): (False, 7, 2),
        ("r2", "x"): (False, None, None), ("r3", None): (False, None, None),
    }
    revisions = spark.createDataFrame(
        [("copilot", "s", "c", p, "g1", "1", f"long{p}", p, 0, 0, 0, 0, 0) for p in (1, 2)],
        "platform string, session_id string, logical_call_id string, pos bigint, generation string, primary_key string, source_id string, " + ", ".join(f"{m} bigint" for m in accounting.METRICS))
    current = accounting.current_revisions(revisions, ("pos",))
    assert "source_id" not in current.columns and [(r.pos, r.input_tokens, r.first_pos) for r in current.collect()] == [(2, 2, 1)]
    assert accounting.current_revisions(revisions).head().source_id == "long2"


def test_agreeing_calls_are_built_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(AT, "cycle_order", lambda rooted, inner=AT.cycle_order: made.append(1) or inner(rooted))
    calls = spark.createDataFrame(
        [("copilot", "s", i, f"c{i}", "t", "i1", None, None, "0", "m", f"2026-01-01T00:00:0{i}", True) for i in range(3)],
        "platform string, session_id string, pos bigint, call_id string, stored_turn_id string, interaction_id string, agent_id string, parent_tool_call_id string,"
        " native_turn_id string, model string, start_ts string, has_finish boolean")
    tools = spark.createDataFrame([], "platform string, session_id string, call_id string, tool_call_id string")
    usage = spark.createDataFrame(
        [("copilot", "s", "u1", 1, "src", 0, None, None, "m", "tool_calls", None), ("copilot", "s", "u2", 2, "src", 0, None, None, "m", "stop", None)],
        "platform string, session_id string, logical_call_id string, pk bigint, usage_source_id string, turn_index bigint, agent_id string, parent_tool_call_id string,"
        " model string, finish_reason string, initiator string")
    done, sets = AT.attributions(calls, tools, usage)
    got = {r.logical_call_id: (r.status, r.candidate_set) for r in done.collect()}
    assert len(made) == 1 and got["u1"] == ("pending", None) and got["u2"][0] == "ambiguous"
    assert {(r.candidate_set, r.call_id) for r in sets.collect()} == {(got["u2"][1], f"c{i}") for i in range(3)}


def test_flatten_spans_builds_accounting_once(spark):
    from spanloom.plans.spans import flatten_spans

    turns = spark.createDataFrame([("copilot", "s", "t", None, "a", "b", "completed", "m")], "platform string, session_id string, turn_id string, parent_turn_id string, start_ts string, end_ts string, status string, model string")
    calls = spark.createDataFrame([("copilot", "s", "c", "t", "m", "a", "b", None, None)], "platform string, session_id string, call_id string, turn_id string, model string, start_ts string, end_ts string, input_tokens long, output_tokens long")
    rows = spark.range(3).selectExpr("'copilot' as platform", "'s' as session_id", "concat('u', id) as accounting_id", "case when id = 0 then 'c' end as call_id", "'t' as turn_id", "'matched' as status", "id as input_tokens", "id as output_tokens", "'a' as ts")
    out = flatten_spans(turns, calls, accounting=rows.repartition(3, "accounting_id"))
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.kind for r in out.collect()) == ["accounting", "accounting", "chat", "session", "turn"]


def test_projection_makes_only_what_is_read(spark, monkeypatch):
    from spanloom.plans import projection as P
    from spanloom.sources import star_frames

    made = []
    for name in ("row_metrics", "current_revisions", "shutdown_totals"):
        monkeypatch.setattr(P.accounting, name, lambda *a, inner=getattr(P.accounting, name), name=name: made.append(name) or inner(*a))
    d = "/root/testdata/sf0.001"
    tables = P.projection(star_frames.copilot_records(spark, d), star_frames.copilot_database(spark, d), F.lit("key"), F.lit("key"), F.col("generation"))
    assert tables["calls"].count() and not made
    assert tables["usage"].count() and made == ["row_metrics", "current_revisions"]
    assert tables["tools"].count() and "counts" in tables and made == ["row_metrics", "current_revisions"]


def test_small_files_are_spread_over_the_cores(spark):
    from spanloom.sources import star_frames

    cores = spark.sparkContext.defaultParallelism
    for rows in (star_frames.copilot_records(spark, "/root/testdata/sf0.01"), star_frames.copilot_database(spark, "/root/testdata/sf0.01")):
        assert sum(n > 0 for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) >= min(cores, 2)


def test_sessions_are_counted_once_for_all_scans(spark, monkeypatch):
    from spanloom.functions import ordered
    from spanloom.plans import projection as P
    from spanloom.sources import star_frames

    rows = spark.range(100).selectExpr("id % 2 as s", "id as pos")
    assert ordered.whole_keys(rows, ["s"], 50) and not ordered.whole_keys(rows, ["s"], 49)
    monkeypatch.setattr(ordered, "large_keys", lambda *a: pytest.fail("a scan counts its keys again"))
    d = "/root/testdata/sf0.001"
    tables = P.projection(star_frames.copilot_records(spark, d), star_frames.copilot_database(spark, d), F.lit("key"), F.lit("key"), F.col("generation"))
    assert tables["attributions"].count() and tables["pending"].count()


def test_cut_lineage_leaves_no_shuffle_files(spark):
    from spanloom.session import cut_lineage

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffles()
    out = cut_lineage(spark.range(100_000).selectExpr("id % 9999 as k", "id").groupBy("k").count())
    for _ in range(50):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 9999


def test_a_record_gives_its_event_and_requests_in_one_pass(spark):
    """Requests follow their message; those without an id, and what other kinds call requests, give none.  Records are read once."""
    asks = [{"toolCallId": "t1", "name": "bash"}, {"toolCallId": "", "name": "x"}, None, {"toolCallId": "t2"}]
    events = transcript(spark, [
        ("assistant.message", None, ix("i1", "0", toolRequests=asks)), ("user.message", None, ix("i1", toolRequests=asks)), ("assistant.message", None, ix("i1", toolRequests="none")),
        ("my.error", None, {}), ("other", None, {"toolCallId": "t3", "toolName": "ls"}),
    ])
    rows = {(r.pos, r.id, r.kind, r.tool_call_id, r.tool_name) for r in events.collect()}
    own = "copilot:event:e"
    assert rows == {
        (0, f"{own}0", "assistant_message", None, None), (0, f"{own}0:tool:t1", "tool_request", "t1", "bash"), (0, f"{own}0:tool:t2", "tool_request", "t2", None), (1, f"{own}1", "user_prompt", None, None),
        (2, f"{own}2", "assistant_message", None, None), (3, f"{own}3", "error", None, None), (4, f"{own}4", "unknown", "t3", "ls"),
    }
    assert "Union" not in events._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_sorted_by_the_session_before_the_platform(spark):
    from spanloom.functions.ordered import scan

    df = spark.createDataFrame([("p", "s", 1)], "platform string, session_id string, pos bigint")
    plan = scan(df, ["platform", "session_id"], "pos", sums={"n": F.lit(1)}, whole=True)._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"windowspecdefinition\((\w+)#", plan)
    assert keys and set(keys) == {"session_id"}


def test_following_pointers_broadcasts_no_stored_ids(spark, monkeypatch):
    """Millions of stored ids are a few MB of file, so a side that looks small may not fit the driver."""
    from spanloom.operators import lineage

    plans = []
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    nodes = spark.range(64).selectExpr("'p' as platform", "'s' as session_id", "id", "case when id % 16 > 0 then id - 1 when id = 48 then 63 end as up")
    out = lineage.resolve_roots(nodes, ["platform", "session_id"], "id", "up", F.expr("id % 16 = 0 and id < 48"), "root")
    assert out.columns == [*nodes.columns, "root"]
    assert {(r.id, r.root) for r in out.collect()} == {(i, i - i % 16 if i < 48 else None) for i in range(64)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in [*plans, plan(out)])


def test_usage_rows_meet_what_they_chose_once(spark):
    """Claims are counted over narrow rows, so the wide ones are read once to put the result together; a source id is text from its parts."""
    from spanloom.plans import projection as P
    from spanloom.sources import star_frames

    d = "/root/testdata/sf0.001"
    tables = P.projection(star_frames.copilot_records(spark, d), star_frames.copilot_database(spark, d), F.lit("key"), F.lit("key"), F.col("generation"))
    usage = spark.createDataFrame([], "platform string, session_id string, logical_call_id string, primary_key string, usage_source_id string, turn_index bigint, agent_id string, parent_tool_call_id string, model string, finish_reason string, initiator string")
    plan = AT.attribute_usage(tables["calls"], tables["call_tools"], usage)._jdf.queryExecution().analyzed().toString()
    assert sum("Relation [" in line and "usage_source_id" in line for line in plan.split("\n")) == 1
    assert dict(tables._revisions.dtypes)["source"] == "struct<source_key:string,primary_key:string,digest:binary>" and "source_id" not in tables._revisions.columns
    told = copilot.usage_snapshot(star_frames.copilot_database(spark, d), F.lit("key"), F.col("generation"))
    named = tables["attributions"].select("session_id", "logical_call_id", F.col("usage_source_id").alias("source_id"))
    assert named.count() and named.join(told, ["session_id", "logical_call_id", "source_id"], "left_anti").isEmpty()
