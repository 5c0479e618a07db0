"""Chunked scans against plain loops, with chunks far smaller than a session."""

import random

from pyspark.sql import functions as F

from spanloom.functions import ordered as O

K = ["platform", "session_id"]


def rows_for(seed, n=120, sessions=3):
    rnd = random.Random(seed)
    out = []
    for s in range(sessions):
        seq = 0
        for _ in range(n if s == 0 else rnd.randint(1, 25)):
            seq += rnd.randint(1, 4)
            out.append(("p", f"s{s}", seq, rnd.choice("+-x"), rnd.choice([None, 1, 2, 5])))
    rnd.shuffle(out)
    return out


def by_session(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(r[1], []).append(r)
    return groups


def frame(spark, rows):
    return spark.createDataFrame(rows, "platform string, session_id string, seq bigint, t string, v bigint")


def test_scan_matches_loop(spark):
    rows = rows_for(1)
    step = F.when(F.col("t") == "+", 1).when(F.col("t") == "-", -1).otherwise(0)
    got = O.scan(
        frame(spark, rows), K, "seq", sums={"total": F.col("v")}, lasts={"last": F.col("v")}, befores={"before": F.col("v")}, floors={"low": step}, width=7
    ).collect()
    want = {}
    for s, group in by_session(rows).items():
        total, last, bal, low = 0, None, 0, 0
        for r in group:
            before, low_before = last, low
            total += r[4] or 0
            last = r[4] if r[4] is not None else last
            bal += {"+": 1, "-": -1, "x": 0}[r[3]]
            low = min(low, bal)
            want[s, r[2]] = (total, last, before, low, low_before)
    assert {(r.session_id, r.seq): (r.total, r.last, r.before, r.low, r.low_before) for r in got} == want


def test_reverse_scan_gives_next(spark):
    rows = rows_for(2)
    got = O.scan(frame(spark, rows), K, "seq", befores={"nxt": F.col("v")}, reverse=True, width=5).collect()
    want = {}
    for s, group in by_session(rows).items():
        nxt = None
        for r in reversed(group):
            want[s, r[2]] = nxt
            nxt = r[4] if r[4] is not None else nxt
    assert {(r.session_id, r.seq): r.nxt for r in got} == want


def test_numbering(spark):
    rows = rows_for(3)
    want = {(s, r[2]): i for s, g in by_session(rows).items() for i, r in enumerate(g)}
    df = frame(spark, rows)
    assert {(r.session_id, r.seq): r.n for r in O.number(df, K, "seq", "n", width=6).collect()} == want
    other = O.number_by(df, K, F.floor(F.col("seq") / 9), [F.col("seq")], "n")
    assert {(r.session_id, r.seq): r.n for r in other.collect()} == want


def test_queue_and_stack(spark):
    opens, closes = F.col("t") == "+", F.col("t") == "-"
    for seed in (4, 5):
        rows = rows_for(seed)
        df = frame(spark, rows)
        queued = O.queue_pairs(df, K, "seq", opens, closes, width=7).where("pair_no is not null").collect()
        pairs = {}
        for r in queued:
            pairs.setdefault((r.session_id, r.pair_no), {})[r.t] = r.seq
        got = {(s, p["+"], p["-"]) for (s, _), p in pairs.items() if len(p) == 2}
        stacked = O.stack_pairs(df, K, "seq", opens, closes, width=7).where("partner is not null").collect()
        got_stack = {(r.session_id, r.partner, r.seq) for r in stacked}
        fifo, lifo = set(), set()
        for s, group in by_session(rows).items():
            q, st = [], []
            for r in group:
                if r[3] == "+":
                    q.append(r[2])
                    st.append(r[2])
                elif r[3] == "-" and q:
                    fifo.add((s, q.pop(0), r[2]))
                    lifo.add((s, st.pop(), r[2]))
        assert got == fifo
        assert got_stack == lifo


def test_latest_keeps_whole_row(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 3, "x"), ("a", 2, "y")], "k string, pos int, v string")
    assert [tuple(r) for r in O.latest(df, ["k"], "pos").collect()] == [("a", 3, "x")]
    assert [tuple(r) for r in O.latest(df, ["k"], "pos", first=True).collect()] == [("a", 1, None)]


def test_hot_session_is_spread_over_chunks(spark):
    """No window partition of a scan may hold a whole session."""
    df = spark.range(10_000).selectExpr("'p' as platform", "'hot' as session_id", "id as seq", "1 as v")
    out = O.scan(df, K, "seq", sums={"n": F.col("v")}, width=100)
    assert out.where("seq = 9999").first().n == 10_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "__chunk" in plan


def test_sparse_orders_are_cut_by_rows(spark):
    """A large key at a wide stride has a chunk per ``width`` rows, small keys one; clusters only move the cuts."""
    from spanloom.functions.ordered import CHUNK, chunked

    big = spark.range(100_000).selectExpr("'big' as k", "id * 100000 as pos")
    small = spark.range(3_000).selectExpr("concat('s', id % 30) as k", "id * 100000 as pos")
    nulls = spark.range(5).selectExpr("cast(null as string) as k", "id as pos")
    rows = big.unionByName(small).unionByName(nulls)
    chunks = {(r["k"], r[CHUNK]): r["n"] for r in chunked(rows, ["k"], "pos", 5_000).groupBy("k", CHUNK).agg(F.count("*").alias("n")).collect()}
    of_big = [n for (k, _), n in chunks.items() if k == "big"]
    assert len(of_big) == 20 and max(of_big) <= 5_001 and all(c == 0 for k, c in chunks if k != "big") and len(chunks) == 20 + 30 + 1
    out = O.scan(rows, ["k"], "pos", sums={"n": F.lit(1)}, befores={"prev": F.col("pos")}, width=5_000)
    wrong = out.where("k = 'big' AND (n <> pos div 100000 + 1 OR NOT (prev <=> IF(pos = 0, NULL, pos - 100000)))")
    assert wrong.isEmpty() and out.where("k = 'big'").count() == 100_000


def test_scan_without_a_large_key_shuffles_once(spark):
    rows = spark.range(1000).selectExpr("id % 50 as k", "id as pos")
    out = O.scan(rows, ["k"], "pos", sums={"n": F.lit(1)}, lasts={"last": F.col("pos")}, floors={"low": F.lit(-1)}, width=100)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.k, r.pos): (r.n, r.last, r.low, r.low_before) for r in out.collect()} == {(i % 50, i): (i // 50 + 1, i, -(i // 50 + 1), -(i // 50)) for i in range(1000)}


def test_a_lineage_cut_keeps_columns_apart(spark):
    from spanloom.session import cut_lineage

    rows = spark.range(100).selectExpr("id", "repeat('x', 1000) as wide", "null as none", "try_parse_json(concat('{\"a\":', id, '}')) as v")
    cut = cut_lineage(rows)
    assert cut.schema.names == rows.schema.names and cut.where("none is null").count() == 100
    assert cut.selectExpr("sum(variant_get(v, '$.a', 'bigint'))").head()[0] == 4950
    scan = cut.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in scan.lower() and "wide" not in scan
