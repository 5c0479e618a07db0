"""Importance resampling against a plain version."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import importance

from . import brute
from .conftest import CLASHES, KIND, awkward_rows, sentence


def test_crc_of_spans():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(200_000), np.uint8)
    length = np.array([rng.choice([1, 2, 5, 63, 64, 65, 127, 128, 129, 192, 500, 4097]) for _ in range(2000)] + [150_001])
    start = np.array([rng.randrange(0, 45_000) for _ in length])
    got = importance.span_crc(data, start, start + length)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, length)]


@pytest.mark.parametrize("words", [1, 7, 1 << 15])
def test_features(monkeypatch, words):
    monkeypatch.setattr(importance, "WORDS_AT_ONCE", words)
    monkeypatch.setattr(importance, "BLOCKS_AT_ONCE", words + 2)
    texts = ["Ab  c-é9\x0bd", "", None, "c", "x" * 1000 + " c Ab", "One_two THREE four\x00FIVE", "é", "--", "中文 ÄÖ a"]
    got = {}
    for doc, crc in importance.features(pa.array([t or "" for t in texts])):
        for d, c in zip(doc.tolist(), crc.tolist()):
            got.setdefault(d, []).append(c)
    assert [got.get(i, []) for i in range(len(texts))] == [brute.feature_crcs(t)[1] for t in texts]


def test_no_texts():
    assert list(importance.features(pa.array([], pa.string()))) == [] and list(importance.features(pa.array(["", ""]))) == []


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_against_the_plain_version(spark, docs):
    rng = random.Random(5)
    target = [sentence(rng, 30), sentence(rng, 25), None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    more = [(1000 + i, sentence(rng, 15 + i % 12), None, "s", 1) for i in range(120)]
    all_ = docs.drop(*CLASHES).union(spark.createDataFrame(more, KIND))
    got = importance.ranked(importance.weighed(all_.select("doc_id", "text"), bench).select("doc_id", "draw.*"))
    want = Counter(brute.importance([(r[0], r[1]) for r in awkward_rows() + more], target))
    assert rows_of(got) == want and sum(r[4] is not None for r in want) >= 4


def test_drawn_rows_stay_as_they_were(spark, docs, empty):
    rng = random.Random(6)
    more = spark.createDataFrame([(2000 + i, sentence(rng, 30), None, "s", 1) for i in range(60)], KIND)
    all_ = docs.unionByName(more, allowMissingColumns=True)
    bench = spark.createDataFrame([(sentence(rng, 30),)], "text string")
    out = importance.resampled(all_, bench, share=(20, 100))
    ranks = importance.ranked(importance.weighed(all_, bench).select("doc_id", "draw.*"), share=(20, 100)).where("rank IS NOT NULL")
    assert out.columns == all_.columns and sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in ranks.select("doc_id").collect())
    assert importance.resampled(empty, bench).count() == 0
    assert importance.ranked(importance.weighed(empty, bench).select("doc_id", "draw.*")).columns[-1] == "rank"
    assert importance.weighed(docs, bench.limit(0)).count() == docs.count()


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 30, 5) for i in range(100)] + [(200, 19, 99), (None, 40, None)], "doc_id long, n_words long, score long")
    got = {r["doc_id"]: r["rank"] for r in importance.ranked(rows).collect()}
    assert {d: r for d, r in got.items() if r} == {i: i + 1 for i in range(5)} and len(got) == 102


def test_one_row_many_times(spark):
    rows = spark.createDataFrame([(7, 30, 5)] * 400, "doc_id long, n_words long, score long")
    assert sorted(r["rank"] for r in importance.ranked(rows).collect() if r["rank"]) == list(range(1, 21))
