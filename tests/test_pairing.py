"""Pairing rules against plain loops over random sessions."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from spanloom.operators import pairing as P

EV = "platform string, session_id string, seq bigint, t string, tool_use_id string"


def tool_rows(seed, n=150, ids=4):
    rnd = random.Random(seed)
    return [
        ("p", f"s{rnd.randint(0, 1)}", i, rnd.choice(["tool_call", "tool_result"]), rnd.choice([None, "", *map(str, range(ids))]))
        for i in range(n)
    ]


def sessions(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[2]):
        groups[r[1]].append(r)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_by_id(spark, seed):
    rows = tool_rows(seed)
    got = {(r.session_id, r["call"].seq, r.seq) for r in P.pair_tools_by_id(spark.createDataFrame(rows, EV), width=9).collect()}
    want = set()
    for s, group in sessions(rows).items():
        waiting = {}
        for _, _, seq, t, i in group:
            if not i:
                continue
            if t == "tool_call":
                waiting[i] = seq
            elif i in waiting:
                want.add((s, waiting.pop(i), seq))
    assert got == want


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_fallback_takes_newest_open_call(spark, seed):
    rows = tool_rows(seed)
    got = {(r.session_id, r.seq): r.parent_seq for r in P.pair_tools_with_fallback(spark.createDataFrame(rows, EV), width=8, fan=3).collect()}
    want = {}
    for s, group in sessions(rows).items():
        named, stack = {}, []
        for _, _, seq, t, i in group:
            if t == "tool_call":
                stack.append(seq)
                if i:
                    named[i] = seq
            elif i and i in named:
                mate = named.pop(i)
                want[s, seq] = mate
                if mate in stack:
                    stack.remove(mate)
            else:
                want[s, seq] = stack.pop() if stack else None
    assert got == want


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_two_sided(spark, seed):
    rnd = random.Random(seed)
    schema = EV.replace("tool_use_id string", "generation string, family string, name string, call_ref string, signature string, instant boolean")
    rows = []
    for i in range(140):
        ref = rnd.choice([None, None, "a", "b"])
        rows.append(("p", "s", i, rnd.choice(["tool_call", "tool_result"]), f"g{rnd.randint(0, 1)}", rnd.choice(["shell", "file"]), rnd.choice(["x", "y"]), ref, rnd.choice([None, "sig"]), rnd.random() < 0.05))
    got = {(r.call_seq, r.result_seq, r.unmatched) for r in P.pair_two_sided(spark.createDataFrame(rows, schema), width=10).collect()}
    want = set()
    for g in ("g0", "g1"):
        wait = {"tool_call": [], "tool_result": []}
        for _, _, seq, t, gen, fam, name, ref, sig, instant in rows:
            if gen != g:
                continue
            if instant:
                want.add((seq, seq, None))
                continue
            key = f"id:{ref}" if ref else f"{fam}:{name}:{sig}" if sig else f"{fam}:{name}"
            other = wait["tool_result" if t == "tool_call" else "tool_call"]
            hit = next((w for w in other if w[0] == key), None)
            if hit is None and not ref and not sig:
                kin = [w for w in other if w[1] == fam]
                hit = kin[0] if kin and not kin[0][0].startswith("id:") else None
            if hit is None:
                wait[t].append((key, fam, seq))
            else:
                other.remove(hit)
                want.add((seq, hit[2], None) if t == "tool_call" else (hit[2], seq, None))
        want |= {(w[2], None, "call") for w in wait["tool_call"]} | {(None, w[2], "result") for w in wait["tool_result"]}
    assert got == want


def child_rows(seed, n=160):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = rnd.choice(["tool_call", "subagent_start", "subagent_message"])
        tool = rnd.choice(["Task", "Bash"]) if t == "tool_call" else None
        out.append(("p", f"s{rnd.randint(0, 1)}", i, t, tool, rnd.choice([None, "a", "b", "c"]) if t != "tool_call" else None))
    return out


CH = "platform string, session_id string, seq bigint, t string, tool_name string, agent_id string"


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_subagent_windows(spark, seed):
    rows = child_rows(seed)
    got = {(r.session_id, r.agent_id, r.start_seq, r.stop_seq, r.task_seq) for r in P.subagent_windows(spark.createDataFrame(rows, CH), width=9).collect()}
    want = set()
    for s, group in sessions(rows).items():
        starts, tasks, queue = {}, {}, deque()
        for _, _, seq, t, tool, agent in group:
            if t == "tool_call":
                if tool == "Task":
                    queue.append(seq)
            elif agent and t == "subagent_start":
                starts[agent] = seq
                if queue:
                    tasks[agent] = queue.popleft()
            elif agent and agent in starts:
                want.add((s, agent, starts.pop(agent), seq, tasks.pop(agent, None)))
    assert got == want


@pytest.mark.parametrize("seed", [14, 15])
def test_pair_subagents(spark, seed):
    rows = child_rows(seed)
    got = {(r.session_id, r.start_seq, r.stop_seq) for r in P.pair_subagents(spark.createDataFrame(rows, CH), width=9).collect()}
    want = set()
    for s, group in sessions(rows).items():
        named, stack = defaultdict(deque), []
        for _, _, seq, t, _tool, agent in group:
            if t == "subagent_start":
                named[agent].append(seq) if agent else stack.append(seq)
            elif t == "subagent_message":
                if agent and named[agent]:
                    want.add((s, named[agent].popleft(), seq))
                elif not agent and stack:
                    want.add((s, stack.pop(), seq))
    assert got == want


@pytest.mark.parametrize("seed", [16, 17, 18])
def test_lifecycle_with_resumes(spark, seed):
    rnd = random.Random(seed)
    schema = "platform string, session_id string, seq bigint, t string, child_id string, call_ref string, resume boolean"
    rows = []
    for i in range(160):
        t = rnd.choice(["tool_call", "subagent_start", "subagent_message"])
        child = rnd.choice(["a", "b", "c", "d", ""] if t != "tool_call" else ["a", "b"])
        ref = child if t == "tool_call" else rnd.choice([child, None]) if t == "subagent_start" else None
        rows.append(("p", "s", i, t, child, ref, t == "tool_call"))
    got = {(r.child_id, r.start_seq, r.start_ref, r.stop_seq) for r in P.lifecycle_windows(spark.createDataFrame(rows, schema), width=9).collect()}
    want, queues, finished = set(), defaultdict(list), set()
    for _, _, seq, t, child, ref, _r in rows:
        q = queues[child]
        if t == "tool_call":
            finished.discard(child)
            q.append([seq, ref, True])
        elif t == "subagent_start":
            if child:
                finished.discard(child)
                entry = [seq, ref or "", False]
                for held in q:
                    if held[2] and (not ref or held[1] == ref):
                        q.remove(held)
                        entry = [seq, ref or held[1], True]
                        break
                q.append(entry)
        elif child and q:
            start = q.pop(0)
            finished.add(child)
            want.add((child, start[0], start[1], seq))
        elif not (child and child in finished):
            want.add((child, None, "", seq))
    assert got == want


def test_owner_is_the_narrowest_window(spark):
    windows = spark.createDataFrame([("p", "s", "a", 0, 100), ("p", "s", "b", 10, 20), ("p", "s", "c", 15, 25)], "platform string, session_id string, agent_id string, start_seq bigint, stop_seq bigint")
    events = spark.createDataFrame([("p", "s", 5, None), ("p", "s", 12, None), ("p", "s", 18, None), ("p", "s", 24, None), ("p", "s", 200, None), ("p", "s", 18_000, "a"), ("p", "s", 7, "ghost")], "platform string, session_id string, seq bigint, agent_id string")
    got = {r.seq: r.owner for r in P.owning_agent(events, windows, width=8).collect()}
    assert got == {5: "a", 12: "b", 18: "b", 24: "c", 200: None, 18_000: "a", 7: None}


def test_points_in_windows_of_all_lengths(spark):
    """Windows from one to 2^51 seqs against every point; a window makes two rows at most, so long ones need no cell for every 4096 seqs."""
    rnd = random.Random(5)
    lengths = [0, 1, 7, 8, 9, 33, 500, 4096, 70_000, 10**9, 2**51]
    windows = [(g, f"c{i}", s := rnd.choice([0, 5, 8, 4095, 10**9, rnd.randint(0, 10**6)]), s + rnd.choice(lengths)) for i in range(120) for g in [rnd.choice("ab")]]
    windows += [("a", "none", 5, None), ("a", "back", 9, 3)]
    points = {("a", p) for _, _, a, b in windows if b is not None for p in (a - 1, a, a + 1, b - 1, b, b + 1) if p >= 0}
    points = sorted(points | {(g, rnd.randint(0, 2 * 10**6)) for g in "abz" for _ in range(50)})
    spans = spark.createDataFrame([("p", "s", *w) for w in windows], "platform string, session_id string, generation string, child_id string, start_seq bigint, stop_seq bigint")
    events = spark.createDataFrame([("p", "s", *e) for e in points], "platform string, session_id string, generation string, seq bigint")
    for width in (8, 4096):
        got = sorted((r.generation, r.seq, r.child_id) for r in P.events_for_subagent(events, spans, width=width).collect())
        assert got == sorted((g, p, c) for g, p in points for h, c, a, b in windows if g == h and b is not None and a < p <= b)
    narrow = defaultdict(list)
    for g, c, a, b in windows:
        if b is not None and a <= b:
            narrow[c] = [a, b]
    owners = {r.seq: r.owner for r in P.owning_agent(events.where("generation = 'a'").withColumn("agent_id", F.lit("")), spans.withColumn("agent_id", F.col("child_id"))).collect()}
    for seq, owner in owners.items():
        fits = sorted((b - a, a) for a, b in narrow.values() if a <= seq <= b)
        assert (owner is None) == (not fits) and (owner is None or (narrow[owner][1] - narrow[owner][0], narrow[owner][0]) == fits[0])


def test_overlaps_of_all_lengths(spark):
    """Windows from seconds to decades against every pair; missing ends overlap nothing, and their windows stay on request."""
    import random
    from datetime import datetime, timedelta

    from spanloom.operators import pairing

    rng = random.Random(4)
    begin = datetime(2001, 1, 1)

    def spans(n, name):
        out = []
        for i in range(n):
            a = begin + timedelta(seconds=rng.randrange(0, 10**8))
            b = a + timedelta(seconds=rng.choice([0, 1, 59, 60, 600, 10**5, 10**7, 10**9]) + rng.randrange(0, 50))
            out.append((rng.choice("pq"), "s", rng.choice("xy"), a, None if i % 17 == 5 else b, f"{name}{i}"))
        return out

    left, right = spans(60, "w"), spans(80, "c")
    windows = spark.createDataFrame(left, "platform string, session_id string, child_id string, start_ts timestamp, end_ts timestamp, name string")
    kids = spark.createDataFrame([(p, c, a, b, n, n, "done", 1) for p, _, c, a, b, n in right], "platform string, child_id string, start_ts timestamp, end_ts timestamp, prompt string, output string, status string, calls int")
    got = sorted((r["name"], r["prompt"]) for r in pairing.windows_with_children(windows, kids).collect())
    want = sorted((w[5], c[5]) for w in left for c in right if w[0] == c[0] and w[2] == c[2] and w[4] and c[4] and w[3] <= c[4] and c[3] <= w[4])
    assert got == want and len(want) > 100
    kept = pairing.child_turns_overlapping(windows, kids, keep=True)
    assert kept.count() == len(left) and kept.where("children = 0").count() == len({w[5] for w in left} - {w for w, _ in want})
