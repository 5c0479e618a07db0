"""Quality rules under weak supervision: votes, EM over vote patterns, posterior filter."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import documents, raw, runs, unused
from spanloom.llm.words import SPACE, U, mix, shingles, words

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks"]


def _of(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


CLASSES = {"n_symbols": _of(SYMBOLS), "n_upper": _of(range(65, 91)), "n_lower": _of([*range(97, 123), *range(0xC0, 0x100)]), "n_marks": _of(b"!?")}
CHARS = ~_of(range(0x80, 0xC0)) & ~SPACE


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    if "\n" not in text:
        return int(bool(text.strip(BLANKS))), 0
    full = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(full), len(full) - len(set(full))


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in COUNTS]))
def counts_of(column: pa.Array) -> pa.Array:
    """The counts of each whole text; a null text counts as empty."""
    parts = [_counts(texts) for texts in runs(column)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts] or [[]]), pa.int64()) for k in COUNTS], COUNTS)


def _counts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, at = raw(texts)
    w = words(texts, lower=False)
    got = {"n_words": np.diff(w.at), "word_chars": _sums(CHARS[data], at)} | {k: _sums(c[data], at) for k, c in CLASSES.items()}
    values, doc, first = shingles(w, WINDOW)
    key = mix(values ^ (doc.astype(np.uint64) * U(0x9FB21C651E98DF25)))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    twice = first[order[same[:-1] | same[1:]]]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    lines = np.array([_lines(t) for t in texts.to_pylist()]).reshape(-1, 2)
    return got | {"n_repeat_words": np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=len(texts)), "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1]}


def votes(of: Column | None = None) -> dict[str, Column]:
    """Each rule's vote: 1 for good text, -1 for bad, 0 to abstain.  ``of``: a struct with the counts.

    A rule for one symptom abstains where it sees none, as that says little about the text;
    ``prose`` takes the share of lower-case letters and code points beyond ASCII among these
    and capitals, symbols and marks.
    """

    def col(name):
        return F.col(name) if of is None else of[name]

    n, lines = F.greatest(col("n_words"), F.lit(1)), F.greatest(col("n_lines"), F.lit(1))
    letters = F.greatest(col("n_upper") + col("n_lower"), F.lit(1))

    def rule(bad, good):
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length = col("word_chars") / n
    prose = col("n_lower") / F.greatest(col("n_lower") + col("n_upper") + col("n_symbols") + col("n_marks"), F.lit(1))
    never = F.lit(False)
    return {
        "size": rule(col("n_words") < 10, never),
        "symbols": rule(col("n_symbols") > 0.1 * n, never),
        "repeats": rule(col("n_repeat_words") > 0.2 * n, never),
        "lines": rule(col("n_dup_lines") > 0.3 * lines, never),
        "capitals": rule(col("n_upper") > 0.4 * letters, never),
        "length": rule((length < 2) | (length > 15), never),
        "marks": rule(col("n_marks") > 0.3 * n, never),
        "prose": rule(prose < 0.9, prose >= 0.92),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, start: float = 0.8) -> dict:
    """Expectation-maximisation over counted vote patterns.

    Given the class, rules vote independently; each rule has, for either class, the
    probabilities of its three answers, starting from an accuracy of ``start``.  A pattern's
    posterior is that of all rows that share it, so the counts hold all the data has to say.
    """
    rules = len(patterns[0][0]) if patterns else 0
    prior = 0.5
    seen = np.array([p for p, _ in patterns], int).reshape(-1, rules) + 1
    weight = np.array([n for _, n in patterns], float)
    first = np.array([[start, 1, 1 - start], [1 - start, 1, start]])
    answer = np.repeat(first[:, None, :] / 2, rules, axis=1)
    for step in range(rounds):
        log = [math.log(p) + sum(np.log(answer[c, j, seen[:, j]]) for j in range(rules)) for c, p in ((0, 1 - prior), (1, prior))]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        was = prior
        for c, part in ((0, weight * (1 - good)), (1, weight * good)):
            for j in range(rules):
                answer[c, j] = np.bincount(seen[:, j], part, 3) + first[c]
                answer[c, j] /= answer[c, j].sum()
        prior = (float((weight * good).sum()) + 1) / (weight.sum() + 2)
        if abs(prior - was) < 1e-9 and step > 5:
            break
    return {"prior": prior, "answer": answer.tolist()}


def posterior(model: dict, cast: dict[str, Column]) -> Column:
    """Probability of good text given the votes."""
    odds = F.lit(math.log(model["prior"]) - math.log(1 - model["prior"]))
    for j, vote in enumerate(cast.values()):
        bad, good = model["answer"][0][j], model["answer"][1][j]
        w = [math.log(g) - math.log(b) for g, b in zip(good, bad)]
        odds = odds + F.when(vote < 0, w[0]).when(vote > 0, w[2]).otherwise(w[1])
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, least: float = 0.5, into: str = "verdict") -> DataFrame:
    """All rows and columns of ``docs`` with a struct in column ``into``: the counts, base_failed, p_good and kept.

    Rules vote or abstain; the votes of all rows are counted by pattern (at most 3 to the number
    of rules, so what the driver reads is bounded) and EM finds each rule's accuracy.  kept needs the
    base to pass and a posterior of ``least``; a text that no rule votes against is kept too.  The counts are computed once for the
    model and once more beside the rows, which so need no shuffle.

    Null and empty texts have no words and fail the base.  Repeated rows and rows without
    doc_id are judged one by one.  An empty table gives an empty result.  A column
    of ``docs`` with the name of ``into`` is replaced.
    """
    names = list(votes())
    counted = docs.select(counts_of.asNondeterministic()(F.col("text").cast("string")).alias("c")).select("c.*")
    rows = counted.select(*(v.alias(f"v_{k}") for k, v in votes().items())).groupBy(*(f"v_{k}" for k in names)).count().collect()
    model = fit(sorted((tuple(r)[:-1], r["count"]) for r in rows)) if rows else {"prior": 0.5, "answer": [[[1 / 3] * 3] * len(names)] * 2}
    c = F.col(into)
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    cast = votes(c)
    good = posterior(model, cast)
    against = F.least(*cast.values()) < 0
    return docs.withColumn(into, counts_of.asNondeterministic()(F.col("text").cast("string"))).withColumn(
        into, c.withField("base_failed", failed).withField("p_good", good).withField("kept", ~failed & (~against | (good >= least)))
    )


def good_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were."""
    into = unused(docs, "verdict")
    return judged(docs, into=into, **how).where(F.col(into)["kept"]).select(docs.columns)


def op9_quality_rules(spark, sf_dir):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    return judged(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *(f"verdict.{k}" for k in names))


QUERIES = {"op9_quality_rules": op9_quality_rules}
