"""Importance resampling towards a target distribution over hashed runs of words."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import documents, raw, runs, session, slices, unused, written
from spanloom.llm.numbering import numbered

BUCKETS, MOST, SEED, LEAST_WORDS, SHARE = 10_000, 3, 42, 20, (5, 100)
#: Bytes that the position table reaches back from a block's end (2 to the power of STEP).
STEP = 6
REACH = 1 << STEP
#: Words whose features, and blocks whose bytes, are worked on at a time.
WORDS_AT_ONCE, BLOCKS_AT_ONCE = 1 << 15, 1 << 14
U32 = np.uint32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# --- CRC by position -----------------------------------------------------------------------
@lru_cache(1)
def contributions() -> np.ndarray:
    """[d, b]: what byte b, d bytes before the end, adds (by XOR) to a CRC-32 without its constants.

    A CRC is affine over XOR: that of a text is the XOR of its bytes' contributions and of
    the CRC of as many zero bytes.
    """
    one = np.arange(256, dtype=U32)
    for _ in range(8):
        one = (one >> U32(1)) ^ (U32(0xEDB88320) * (one & U32(1)))
    out = np.empty((REACH, 256), U32)
    out[0] = one
    for d in range(1, REACH):
        out[d] = (out[d - 1] >> U32(8)) ^ one[out[d - 1] & U32(255)]
    return out


@lru_cache(64)
def _moves(power: int) -> np.ndarray:
    """[j, b]: byte j of a CRC register with value b, after 2^power zero bytes."""
    if power:
        return np.stack([moved(column, power - 1) for column in _moves(power - 1)])
    one = contributions()[0]
    register = np.stack([np.arange(256, dtype=U32) << U32(8 * j) for j in range(4)])
    return (register >> U32(8)) ^ one[register & U32(255)]


def moved(register: np.ndarray, power: int) -> np.ndarray:
    """CRC registers after 2^power zero bytes."""
    t = _moves(power)
    return t[0][register & U32(255)] ^ t[1][(register >> U32(8)) & U32(255)] ^ t[2][(register >> U32(16)) & U32(255)] ^ t[3][register >> U32(24)]


@lru_cache(1)
def _zeros() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], U32)


def zero_crc(length: np.ndarray) -> np.ndarray:
    """CRC-32 of that many zero bytes, each."""
    out = _zeros()[np.minimum(length, REACH)]
    far = np.flatnonzero(length > REACH)
    if len(far):
        register = np.full(len(far), 0xFFFFFFFF, U32)
        for power in range(int(length[far].max()).bit_length()):
            on = (length[far] >> power) & 1 == 1
            register[on] = moved(register[on], power)
        out[far] = ~register
    return out


def _ranges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0..c-1 for each count c, one after another, and where each begins."""
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    return np.arange(at[-1]) - np.repeat(at[:-1], count), at[:-1]


def span_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each non-empty span of ``data``.

    Spans are cut into blocks of REACH bytes from their ends; the blocks' contributions are
    gathered by distance from the block's end and XORed by ``reduceat``; blocks of
    one span then fold in pairs, the earlier one moved on by the later one's length.
    """
    near = contributions().ravel()
    length = end - start
    count = -(-length // REACH)
    back, _ = _ranges(count)  # 0: a span's last block
    stop = np.repeat(end, count) - back * REACH
    begin = np.maximum(np.repeat(start, count), stop - REACH)
    folded = np.empty(len(stop), U32)
    for a in range(0, len(stop), BLOCKS_AT_ONCE):
        b, e = begin[a : a + BLOCKS_AT_ONCE], stop[a : a + BLOCKS_AT_ONCE]
        along, at = _ranges(e - b)
        size = e - b
        where = along + np.repeat(b, size)
        distance = np.repeat(size - 1, size) - along
        folded[a : a + BLOCKS_AT_ONCE] = np.bitwise_xor.reduceat(near[distance * 256 + data[where]], at)
    power = STEP
    while len(folded) > len(count):
        place, _ = _ranges(count)
        odd = place & 1 == 1
        folded[odd] = moved(folded[odd], power)
        folded = np.bitwise_xor.reduceat(folded, np.flatnonzero(~odd))
        count = (count + 1) // 2
        power += 1
    return folded ^ zero_crc(length)


# --- features --------------------------------------------------------------------------------
def joined_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts with one space after each; their starts and ends there, and n + 1 word offsets of the texts."""
    data, at = raw(texts)
    n = len(data)
    inside = INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    begin = np.flatnonzero(first)
    rank = np.cumsum(inside)
    word = np.cumsum(first) - 1
    out = np.full(int(rank[-1] if n else 0) + len(begin), 0x20, np.uint8)
    out[rank[inside] - 1 + word[inside]] = LOWER[data[inside]]
    number = np.arange(len(begin))
    return out, rank[begin] - 1 + number, rank[last] + number, np.searchsorted(begin, at)


def features(texts: pa.Array, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers ascending, CRC-32) of all runs of 1 to ``most`` successive words of each text."""
    data, start, end, at = joined_words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    for a in range(0, len(start), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, len(start))
        left = np.minimum(at[doc[a:b] + 1] - np.arange(a, b), most)
        longer, _ = _ranges(left)
        word = np.repeat(np.arange(a, b), left)
        yield doc[word], span_crc(data, start[word], end[word + longer])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST) -> np.ndarray:
    """Features of all texts of ``docs`` by bucket; each task adds up its own rows first, so that
    what is shuffled and what the driver reads are bounded by ``buckets``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in slices(batches):
            for _, crc in features(texts, most):
                total += np.bincount(crc % U32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    s, t, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(text: Column, gain: np.ndarray, most: int = MOST) -> Column:
    """Struct of a whole text's n_words, n_features and weight, the sum of its features' gains."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(column: pa.Array) -> pa.Array:
        out = [np.zeros((0, 3), np.int64)]
        for texts in runs(column):
            part = np.zeros((len(texts), 3), np.int64)
            for doc, crc in features(texts, most):
                cut = np.flatnonzero(np.diff(doc, prepend=-1))
                part[doc[cut], 2] += np.add.reduceat(gain[crc % U32(len(gain))], cut)
                part[doc[cut], 1] += np.diff(np.append(cut, len(doc)))
            part[:, 0] = np.diff(joined_words(texts)[3])
            out.append(part)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(out).T], ["n_words", "n_features", "weight"])

    return weigh.asNondeterministic()(text.cast("string"))


def luck(doc_id: Column, seed: int = SEED) -> Column:
    """A document's Gumbel draw in thousandths, from the hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST, seed: int = SEED, into: str = "draw") -> DataFrame:
    """All rows and columns of ``docs`` with a struct in column ``into``: n_words, n_features, weight, score.

    The texts are read twice, for the corpus counts and for the weights; nothing but
    counts by bucket is shuffled.  Null and empty texts have no features and weight 0; a row
    without doc_id has a weight but no score.  Repeated rows count and are scored one by one.  With an empty
    table, or an empty target, its counts are 0.  A column of ``docs`` with the name of ``into`` is replaced.
    """
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    of = F.col(into)
    return docs.withColumn(into, weights(F.col("text"), gain, most)).withColumn(into, of.withField("score", of["weight"] + luck(F.col("doc_id"), seed)))


def ranked(rows: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows(doc_id, n_words, score, ...)`` with ``rank``: 1, 2, 3, ... for the drawn ones, else null.

    Of the rows with ``least_words`` words and a score, the ``share`` with the highest scores is drawn, ties
    going to the smaller doc_id and, between rows of one doc_id, to any.  Rows are ranked over range partitions.
    """
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "weights")
    order = numbered(rows.where(fit), [F.desc("score"), F.asc("doc_id"), F.asc("row")])
    drawn = order.count() * share[0] // share[1]
    rank = F.when(F.col("n") < drawn, F.col("n") + 1).cast("long").alias("rank")
    columns = [c for c in rows.columns if c != "row"]
    return order.select(*columns, rank).union(rows.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, **how) -> DataFrame:
    """The drawn rows of ``docs``, with their columns as they were.

    The last drawn (score, doc_id) is found on narrow rows, and the texts are filtered by it without a shuffle;
    so rows that equal it in both are all drawn.
    """
    into = unused(docs, "draw")
    rows = weighed(docs, target, into=into, **how)
    narrow = ranked(rows.select("doc_id", f"{into}.n_words", f"{into}.score"), share, least_words).where("rank IS NOT NULL")
    last = narrow.orderBy(F.desc("rank")).select("score", "doc_id").head()
    score, drawn = F.col(into)["score"], F.lit(False)
    if last is not None:
        drawn = (F.col(into)["n_words"] >= least_words) & ((score > last[0]) | ((score == last[0]) & (F.col("doc_id") <= last[1])))
    return rows.where(drawn).select(docs.columns)


def op11_importance_resampling(spark, sf_dir):
    target = session(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = weighed(documents(spark, sf_dir).select("doc_id", "text"), target).select("doc_id", "draw.*")
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = {
    "op11_importance_resampling": r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, false AS target, text FROM documents
  UNION ALL SELECT NULL, NULL, true, text FROM benchmark
),
words AS (
  SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
),
runs AS (SELECT r, target, w, unnest(range(1, len(w) + 1)) AS i FROM words),
features AS (SELECT r, target, array_to_string(w[i : i + k - 1], ' ') AS f FROM runs, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
distinct_ AS (SELECT DISTINCT f, hex(f) AS x FROM features),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(strlen(f)), lambda p: ('0x' || substr(x, 2 * p + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM distinct_, crc_table
),
bucketed AS (SELECT r, target, bucket FROM features JOIN hashed USING (f)),
sums AS (SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM bucketed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM sums, totals),
weights AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM bucketed JOIN gains USING (bucket) WHERE NOT target GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE NOT target
),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scored WHERE n_words >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * many // 100 THEN place END AS rank FROM scored LEFT JOIN fit USING (r)
""",
}
QUERIES = {"op11_importance_resampling": op11_importance_resampling}
