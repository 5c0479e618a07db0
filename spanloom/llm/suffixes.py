"""Exact repeated substrings: sampled suffixes in sorted buckets, compared with their neighbours.

A byte string of ``length`` that occurs twice has the same smallest token (a token: the hash of
``TOKEN`` bytes) at the same place in both occurrences.  So suffixes are sampled at the smallest
token of each string of ``length``, about one in 85; strings with the same smallest token make one row.
A suffix is ordered by its leading token, then by the hash of all bytes its strings cover:
an order of suffixes under another alphabet, in which equal beginnings are adjacent.

Rows go to buckets by sampled splitters, each bucket is sorted by multikey quicksort, and rows
compare with their neighbours, those at a bucket's ends with the next bucket's.  A row whose
leading token is alone repeats nothing; one whose covered bytes are not alone repeats in all its
strings.  What lies between is cut into cells of ``CELL`` strings, for which the bytes that all
of them share and those that any covers play the same two parts, and at last into single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import documents, raw, slices, written
from spanloom.llm.words import U, mix, prefix_hash, span_hash

LENGTH = 200
TOKEN = 32
CELL = 16
#: Rows of a bucket, about; so many meet in the memory of one task.
BUCKET_ROWS = 400_000
#: Buckets below this size are sorted by one call.
SMALL = 1 << 15
#: Ids shared by several texts that are broadcast at most.
SHARED = 1 << 20
#: Window starts worked on at a time within a long text.
BLOCK = 1 << 20
POSITION = 24
#: ``place`` packs the first string's start, the token's place after it, the number of strings, and whether the
#: row's own strings are in question (1) or it only bears witness for others (0).
ROW = "k1 long, k2 long, doc_id long, place long"
NAMES = ["k1", "k2", "doc_id", "place"]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from minima running forth and back inside blocks."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    forth = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def _cover(prefix, first, last, length, salt):
    """Hash of the bytes that the strings starting at first .. last cover, with ``salt`` mixed in."""
    return mix(span_hash(prefix, first, last + length) ^ mix(salt.astype(np.uint64)))


def sampled(data: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Rows of the sampled suffixes of texts one after another: text number, place of the
    token, first string, number of strings (within the text), leading token, hash of the cover."""
    width = length - TOKEN + 1
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("doc", "m", "lo", "n", "k1", "k2")}
    prefix = prefix_hash(data)
    place = np.arange(len(data) - TOKEN + 1)
    token = span_hash(prefix, place, place + TOKEN)
    low = U((1 << POSITION) - 1)
    least = sliding_min((token & ~low) | place.astype(np.uint64), width)
    end = np.repeat(at[1:], np.diff(at))
    start = np.flatnonzero(np.arange(len(least)) + length <= end[: len(least)])
    m = (least[start] & low).astype(np.int64)
    opens = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, np.int64)
    n = np.diff(np.append(opens, len(m)))
    lo, m = start[opens], m[opens]
    doc = np.searchsorted(at, lo, "right") - 1
    k2 = _cover(prefix, lo, lo + n - 1, length, (m - lo) * 1024 + n)
    return {"doc": doc, "m": m - at[doc], "lo": lo - at[doc], "n": n, "k1": token[m].view(np.int64), "k2": k2.view(np.int64)}


def _rows(ids: pa.Array, got: dict[str, np.ndarray], need: np.ndarray | int = 1) -> pa.RecordBatch:
    place = (((got["lo"] << 12 | got["m"] - got["lo"]) << 12 | got["n"]) << 1) | need
    return pa.RecordBatch.from_arrays([pa.array(got["k1"]), pa.array(got["k2"]), ids.take(pa.array(got["doc"])), pa.array(place)], NAMES)


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """All sampled suffixes of ``docs(doc_id, text)``; texts shorter than ``length`` have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            data, at = raw(texts)
            if len(data) <= 4 * BLOCK:
                yield _rows(batch.column(0), sampled(data, at, length))
                continue
            for a in range(0, len(data) - length + 1, BLOCK):
                part = data[a : a + BLOCK + length - 1]
                got = sampled(part, np.array([0, len(part)]), length)
                yield _rows(batch.column(0), got | {"m": got["m"] + a, "lo": got["lo"] + a})

    return docs.mapInArrow(run, ROW)


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the columns: three-way partitions, in which only equal rows go on to the next column."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(columns):
            continue
        part = order[a:b]
        if b - a <= SMALL:
            order[a:b] = part[np.lexsort([c[part] for c in columns[depth:][::-1]])]
            continue
        v = columns[depth][part]
        pivot = np.sort(v[:: max(1, len(v) // 255)])[len(v[:: max(1, len(v) // 255)]) // 2]
        less, more = v < pivot, v > pivot
        x, y = int(less.sum()), int(more.sum())
        order[a:b] = np.concatenate([part[less], part[~(less | more)], part[more]])
        todo += [(a, a + x, depth), (a + x, b - y, depth + 1), (b - y, b, depth)]
    return order


FOUND = "bucket int, k1 long, k2 long, doc_id long, place long, twice1 boolean, twice2 boolean, mixed boolean, lead boolean, head1 boolean, head2 boolean, tail1 boolean, tail2 boolean"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket; keep rows whose k1 repeats in it and the runs at its two ends, which alone keep their keys."""
    from pyspark import TaskContext

    parts = list(batches)
    if not sum(b.num_rows for b in parts):
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    k1, k2, doc, place = (table.column(i).to_numpy() for i in range(4))
    order = multikey_quicksort([k1, k2, doc, place])
    k1, k2 = k1[order], k2[order]
    new1 = np.concatenate([[True], k1[1:] != k1[:-1]])
    new2 = new1 | np.concatenate([[True], k2[1:] != k2[:-1]])
    run1, run2 = np.cumsum(new1) - 1, np.cumsum(new2) - 1
    size1, size2 = np.bincount(run1), np.bincount(run2)
    kinds = np.bincount(run1[new2])
    got = [size1[run1] > 1, size2[run2] > 1, kinds[run1] > 1, new2, run1 == 0, run2 == 0, run1 == run1[-1], run2 == run2[-1]]
    keep = np.flatnonzero(got[0] | got[4] | got[6])
    inside = ~(got[4] | got[6])[keep]
    bucket = pa.array(np.full(len(keep), TaskContext.get().partitionId()), pa.int32())
    names = [x.split()[0] for x in FOUND.split(", ")]
    out = pa.Table.from_arrays([bucket, pa.array(k1[keep], mask=inside), pa.array(k2[keep], mask=inside), pa.array(doc[order[keep]]), pa.array(place[order[keep]]), *(pa.array(g[keep]) for g in got)], names)
    yield from out.to_batches(max_chunksize=20_000)


def compared(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose k1 occurs elsewhere, with ``twice`` (k2 does too), and ``pass_on``: rows for the
    next level, which are those that are not settled and one witness for each settled (k1, k2) beside them.

    Row and bucket ends are all that crosses buckets: the driver reads two rows of each.
    """
    spark = rows.sparkSession
    rows = written(rows, f"{name}-rows")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    found = written(rows.repartitionByRange(buckets, "k1", "k2", "doc_id", "place").mapInArrow(_bucket, FOUND), f"{name}-found")
    key = F.struct("k1", "k2")
    ends = found.where("head1 OR tail1").groupBy("bucket").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("bucket").collect()
    joins = {r["bucket"]: [False] * 4 for r in ends}
    for p, q in zip(ends, ends[1:]):
        if p["last"]["k1"] == q["first"]["k1"]:
            same = p["last"]["k2"] == q["first"]["k2"]
            joins[p["bucket"]][2:], joins[q["bucket"]][:2] = [True, same], [True, same]
    kind = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(k, T.BooleanType()) for k in ("prev1", "prev2", "next1", "next2")])
    patch = spark.createDataFrame([(b, *v) for b, v in joins.items() if any(v)], kind)
    both = found.join(F.broadcast(patch), "bucket", "left").fillna(False, ["prev1", "prev2", "next1", "next2"])
    crosses = F.expr("(head1 AND prev1) OR (tail1 AND next1)")
    twice = F.expr("twice2 OR (head2 AND prev2) OR (tail2 AND next2)")
    return both.where(F.col("twice1") | crosses).select("doc_id", "place", twice.alias("twice"), ((F.col("mixed") | crosses) & (~twice | F.col("lead"))).alias("pass_on"))


NEED = "place % 2 = 1"


def _listed(found: DataFrame) -> DataFrame:
    """Per document, the places of its rows to pass on; no more than the document has bytes."""
    rows = found.where("pass_on").select("doc_id", F.expr(f"place - IF(twice AND {NEED}, 1, 0)").alias("p"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("p")).alias("places"))


def refined(texts: DataFrame, found: DataFrame, length: int, cell: int) -> DataFrame:
    """Rows of the cells (``cell`` > 1) or single strings (1) of the rows that ``found`` passes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches):
            data, at = raw(text)
            column = batch.column(2)
            counts = np.diff(column.offsets.to_numpy())
            place = column.flatten().to_numpy()
            doc = np.repeat(np.arange(len(text)), counts)
            lo, n, need = place >> 25, place >> 1 & 4095, place & 1
            m = lo + (place >> 13 & 4095)
            near, far = m - (lo + n - 1), m - lo
            first, last = near // cell, far // cell
            many = last - first + 1
            of = np.repeat(np.arange(len(m)), many)
            j = np.repeat(first, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            d1, d2 = np.maximum(j * cell, near[of]), np.minimum(j * cell + cell - 1, far[of])
            base = at[doc[of]] + m[of]
            for a in range(0, len(of), 1 << 18):
                s = slice(a, a + (1 << 18))
                offset = int((base[s] - d2[s]).min()) if len(of[s]) else 0
                top = int((base[s] - d1[s]).max()) + length
                prefix, b = prefix_hash(data[offset:top]), base[s] - offset
                if cell > 1:
                    core = b - j[s] * cell
                    k1 = mix(span_hash(prefix, core, core + length - cell + 1) + j[s].astype(np.uint64))
                else:
                    lead = (offset + b - d2[s])[:, None] + np.arange(8)
                    k1 = data[lead].copy().view(">u8").reshape(-1).astype(np.uint64)
                k2 = _cover(prefix, b - d2[s], b - d1[s], length, (d1[s] * 1024 + d2[s]) if cell > 1 else 0 * d1[s])
                got = {"doc": doc[of[s]], "m": m[of[s]], "lo": m[of[s]] - d2[s], "n": d2[s] - d1[s] + 1, "k1": k1.view(np.int64), "k2": k2.view(np.int64)}
                yield _rows(batch.column(0), got, need[of[s]])

    return texts.join(_listed(found), "doc_id").select("doc_id", "text", "places").mapInArrow(run, ROW)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, start, end; bytes) whose union is what repeated strings cover, and the texts with such spans or candidates."""
    level = written(compared(suffixes(docs, length), "suffixes"), "suffixes")
    texts = written(docs.join(level.where(f"({NEED} AND twice) OR pass_on").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")
    spans = None
    for name, cell in (("cells", CELL), ("strings", 1), (None, 0)):
        start = F.shiftright("place", 25)
        done = level.where(f"{NEED} AND twice").select("doc_id", start.alias("start"), (start + F.shiftright("place", 1).bitwiseAND(4095) - 1 + length).alias("end"))
        spans = done if spans is None else spans.union(done)
        if name:
            level = written(compared(refined(texts, level, length, cell), name), name)
    return spans, texts


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` with a number ``doc_id`` that stands for both.

    It is the id itself where one text only has it, which keeps the sampled rows small; a negative hash of both where
    several texts share an id, and for rows without id or below 0.  The ids that texts share are broadcast when they are
    counted to be at most ``SHARED``, and shuffled beyond.
    """
    hash_ = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("-")), "text")
    shared = docs.where("id >= 0").groupBy("id").agg(F.min(hash_).alias("lo"), F.max(hash_).alias("hi")).where("lo <> hi").select("id", F.lit(True).alias("shared"))
    shared = written(shared, "shared-ids")
    n = shared.count()
    marked = docs.join(F.broadcast(shared) if n <= SHARED else shared, "id", "left") if n else docs.withColumn("shared", F.lit(None).cast("boolean"))
    key = F.when((F.col("id") >= 0) & F.col("shared").isNull(), F.col("id")).otherwise(-hash_.bitwiseAND((1 << 62) - 1) - 1)
    return marked.select("id", key.alias("doc_id"), "text")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; null where nothing is removed) and kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same
    text or another, is removed; strings are judged on the input.  Null and empty texts have no
    bytes.  A row is known by its doc_id and text (``keyed``), so rows of one doc_id may have different
    texts, and rows without doc_id count as all others.  Repeated rows are occurrences of each
    other and get equal answers.  Other columns are not read.
    """
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    spans, texts = repeated_spans(docs.select("doc_id", "text"), length)
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches):
            data, at = raw(text)
            column = batch.column(2)
            counts = column.offsets.to_numpy()
            counts = counts - counts[0]
            places = column.flatten()
            start, end = (places.field(i).to_numpy().astype(np.int64) for i in range(2))
            out = []
            for i in range(batch.num_rows):
                own, marks = data[at[i] : at[i + 1]], slice(counts[i], counts[i + 1])
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, start[marks], 1)
                np.add.at(change, end[marks], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = own[~gone].tobytes()
                out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) > 0).sum()), kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_removed", "n_spans", "kept", "cut_sha256"])

    cut = texts.join(listed, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept binary, cut_sha256 string")
    whole = docs.select("id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, "doc_id", "left").select(F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), "kept", F.coalesce("cut_sha256", "sha").alias("kept_sha256"))


def op4_suffix_array_dedup(spark, sf_dir):
    return without_repeats(documents(spark, sf_dir)).drop("kept")


QUERIES = {"op4_suffix_array_dedup": op4_suffix_array_dedup}
