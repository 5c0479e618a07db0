"""Merkle manifests against a plain version."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle

from . import brute
from .conftest import awkward_rows

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

def altered():
    return F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def checked(docs):
    rows, root = merkle.manifest(docs, {"text": altered()})
    return Counter(tuple(r) for r in merkle.verified(rows, root).select(COLUMNS).collect())


def test_awkward_rows(spark, docs):
    want = Counter(brute.merkle([(r[0], r[3], r[2], r[4], r[1]) for r in awkward_rows()]))
    assert checked(docs) == want and {k[-1] for k in want} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4, 1], [9, 10, 1, 28, 27, 81, 82, 2], [1] * 7])
def test_trees_of_all_shapes(spark, sizes):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), f"t\n{i}", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert checked(docs) == Counter(brute.merkle([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))


def test_other_arities(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3 % 2}", i) for i in range(37)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for arity in (2, 5):
        out, root = merkle.manifest(docs, arity=arity)
        got = {r["doc_id"]: tuple(r) for r in merkle.verified(out, root).select(COLUMNS).collect()}
        want = {r[0]: r for r in brute.merkle([(r[0], r[3], r[2], r[4], r[1]) for r in rows], arity)}
        assert all(got[d][:5] == want[d][:5] and got[d][6] for d in want) and len(got) == len(want)


def test_empty_table(empty):
    rows, root = merkle.manifest(empty)
    assert root is None and merkle.verified(rows, root).count() == 0


def test_any_change_shows(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for field in ("lang", "text", "n_chars"):
        out, root = merkle.manifest(docs, {field: F.when(F.col("doc_id") == 11, None).otherwise(F.col(field))})
        assert [r["doc_id"] for r in merkle.verified(out, root).where("NOT verified").collect()] == [11]
