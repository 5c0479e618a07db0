"""Small tables with every awkward row."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Names that operators use inside themselves.
CLASHES = ["key", "verdict", "tokens", "leaked", "cuts", "rep", "start", "a", "b", "component", "size", "first", "shard", "seed", "kind", "label", "spans", "kept"]


def sentence(rng, n, words="the of and ration ting lorem ipsum zeta quod erat alpha beta gamma delta omega sum".split()):
    return " ".join(rng.choice(words) + rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n))


def awkward_rows(seed=1):
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (12, 40, 80, 150, 260)]
    near = base[3].split()
    near[20] = "changed"
    shared = sentence(rng, 60)
    texts = [*base, base[2], base[2], " ".join(near), base[4] + "\n" + shared, sentence(rng, 30) + " " + shared + "\n" + sentence(rng, 20), shared]
    texts += [None, "", "  \n\t ", "one", "One two", "ONE two", "a" * 5000, "x y " * 3000, "line here\n" * 30, "é€😀 " * 90, "'s 'll it's x y", "mail joe@a.example.com or +1 (555) 123-4567 at 10.0.0.255 card 4111 1111 1111 1111"]
    texts.append(sentence(rng, 9000))
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[1], "en", "s0", 5), (None, None, None, None, None), (500, base[0], "en", "s0", 9), (501, None, "en", "s0", 0)]
    return rows


def awkward(spark, seed=1):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    docs = spark.createDataFrame(awkward_rows(seed), KIND)
    return docs.withColumns({c: F.concat(F.lit("extra "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})


@pytest.fixture
def docs(spark):
    return awkward(spark)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def given():
    """Rows of the smallest generated table."""
    duckdb = pytest.importorskip("duckdb")
    return duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
