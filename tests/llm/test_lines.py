"""Shared lines against a plain version."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import lines

from . import brute
from .conftest import CLASHES, KIND, awkward_rows


def many(seed=3, n=150):
    rng = random.Random(seed)
    pool = [f"Line {i} É{'x' * (i % 5)}" for i in range(60)] + ["", " ", "\t", "Ünder", "ünder", " nbsp", "a\rb"]
    rows = []
    for i in range(n):
        parts = [rng.choice(["", " ", "\t\x0b"]) + (p.upper() if rng.random() < 0.2 else p) + rng.choice(["", "\r", "  "]) for p in rng.choices(pool[: 8 + i % 59], k=rng.randrange(0, 12))]
        rows.append((i, "\n".join(parts), "en", "s", 1))
    return rows


@pytest.mark.parametrize("least, chars", [(10, 1), (2, 1), (4, 8), (1, 1)])
def test_against_the_plain_version(spark, docs, least, chars):
    rows = awkward_rows() + many()
    all_ = docs.unionByName(spark.createDataFrame(many(), KIND), allowMissingColumns=True)
    out = lines.deduplicated(all_, least, chars)
    want = brute.without_lines([r[1] for r in rows], least, chars)
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.select("doc_id", "text", "lines.*").collect())
    assert out.columns == [*all_.columns, "lines"] and got == Counter((r[0], *w) for r, w in zip(rows, want))
    assert sum(w[2] for w in want) > 50
    assert out.where(F.col("key").isNotNull()).count() == docs.count() and set(CLASHES) <= set(out.columns)


def test_runs_hold_the_same_counts_as_one_pass(spark, tmp_path):
    keys = [spark.createDataFrame([(h, 1, 1 + (h + b) % 3) for h in range(b, 40 + b)], lines.RUN) for b in range(7)]
    index = lines.LineRuns(spark, str(tmp_path), least_docs=9)
    sums = Counter()
    for b, part in enumerate(keys):
        index.add(part)
        sums.update({r["h1"]: r["n"] for r in part.collect()})
        assert {r["h1"] for r in index.settled().collect()} == {h for h, n in sums.items() if n >= 9}
        assert len(index.log) == bin(b + 1).count("1")
    assert max(level for level, _ in index.log) == 2


def test_settled_keys_are_not_added_again(spark, tmp_path):
    index = lines.LineRuns(spark, str(tmp_path), least_docs=3, fanout=9)
    for n in (3, 5, 1):
        index.add(spark.createDataFrame([(1, 1, n), (2, 2, 1)], lines.RUN))
    assert [r["n"] for r in index.counts().orderBy("h1").collect()] == [3, 3]


def test_hot_lines_and_copies(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    rows = [(i, f"hot\nown {i}", "en", "s", 1) for i in range(40)] + [(7, "hot\nsame", "en", "s", 1)] * 30 + [(None, "hot\nsame", None, None, None)] * 5
    out = lines.deduplicated(spark.createDataFrame(rows, KIND), into="text_")
    want = brute.without_lines([r[1] for r in rows])
    got = Counter((r["doc_id"], r["text"], *r["text_"]) for r in out.collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, want))


def test_one_very_long_text(spark):
    rows = [(i, "\n".join(f"line {j % 9000}" for j in range(20_000)), "en", "s", 1) for i in range(12)]
    got = {tuple(r) for r in lines.deduplicated(spark.createDataFrame(rows, KIND)).select("text", "lines.*").collect()}
    assert got == {("", 20_000, 20_000)}


def test_empty_table(empty):
    assert lines.deduplicated(empty).count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = lines.deduplicated(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
