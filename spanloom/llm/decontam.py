"""Benchmark decontamination by spaced seeds: masked hashes, join, verification around hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import documents, packed, slices, unused, written
from spanloom.llm.words import U, mix, words

#: Fixed masks of word positions; a 1 counts.  However 4 words of 16, or 3 of 12 to 15, are changed, one mask fits
#: somewhere on unchanged words: found by greedy search, proved by enumeration in the tests.
MASKS = ("110111", "1101000011", "11100011", "110000001011")
SPAN = max(map(len, MASKS))
#: A passage is a benchmark's if this many successive words (all of a shorter item) ...
LENGTH = 16
#: ... differ in this share of places at most.
DIFFER = 0.25
#: Bits of the fixed-size filter that spares training seeds the shuffle; a full filter only lets all pass.
FILTER_BITS = 1 << 26
#: Hits of a text this many words apart are sent along together.
REACH = LENGTH + SPAN


def mask_of(n: int) -> str:
    """The mask of an item of n words, fewer than ``SPAN``: successive words that are left unchanged however a quarter is changed."""
    changed = int(n * DIFFER)
    return "1" * -(-(n - changed) // (changed + 1))


def seeds(hashes: np.ndarray, doc: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask: the seed hash at every word where the mask fits into the text, and these words."""
    out = []
    for mask in masks:
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        first = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
        value = np.full(len(first), int(mask, 2), np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                value = mix(value + hashes[first + j])
        out.append((value, first))
    return out


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """item_id and the word hashes of each item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            w = words(texts)
            out = pa.RecordBatch.from_arrays([batch.column(0), packed(w.hash.view(np.int64), np.diff(w.at), pa.int64())], ["item_id", "item"])
            yield out.filter(pa.array(np.diff(w.at) > 0))

    return benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, item array<long>")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """seed, key and the word of the item where it lies; an item shorter than ``SPAN`` has seeds of its own mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            counts = np.diff(column.offsets.to_numpy())
            doc = np.repeat(np.arange(len(ids)), counts)
            at = np.concatenate([[0], np.cumsum(counts)])
            hashes = column.flatten().to_numpy().view(np.uint64)
            of = np.array([mask_of(n) if n < SPAN else "" for n in counts.tolist()])
            for mask in {*of.tolist()}:
                for value, first in seeds(hashes, doc, (mask,) if mask else MASKS):
                    mine = of[doc[first]] == mask
                    value, first = value[mine], first[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids[doc[first]], pa.int64()), pa.array(first - at[doc[first]])], ["seed", "key", "item_word"])

    return items.mapInArrow(run, "seed long, key long, item_word long")


def seed_filter(found: DataFrame) -> np.ndarray:
    """Bits of all seeds in a map of ``FILTER_BITS``; what the driver reads is 64 bits a row, a million rows at most."""
    place = found.select(F.shiftrightunsigned("seed", 38).alias("place"))
    cells = place.groupBy(F.expr("place div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return out.view(np.uint8)


def clusters(docs: DataFrame, bits: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Stretches of texts around words whose seeds pass the filter.

    One row per stretch: doc_id, its first word, its word hashes, and the seeds in it.
    Words away from any hit don't leave the task.
    """
    filter_ = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filter_.value
        for batch, texts in slices(batches):
            w = words(texts)
            ids = batch.column(0)
            value, first = (np.concatenate(x) for x in zip(*seeds(w.hash, w.doc, masks)))
            place = (value >> U(38)).astype(np.int64)
            hit = (known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            value, first = value[hit], first[hit]
            if not len(first):
                continue
            order = np.lexsort((value, first))
            value, first = value[order], first[order]
            doc = w.doc[first]
            opens = np.ones(len(first), bool)
            opens[1:] = (doc[1:] != doc[:-1]) | (first[1:] - first[:-1] > REACH)
            start = np.flatnonzero(opens)
            stop = np.append(start[1:], len(first))
            of = doc[start]
            lo = np.maximum(first[start] - REACH, w.at[of])
            hi = np.minimum(first[stop - 1] + SPAN + REACH, w.at[of + 1])
            take = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(of)), pa.array(lo - w.at[of]), packed(w.hash[take].view(np.int64), hi - lo, pa.int64()), packed(value.view(np.int64), stop - start, pa.int64()), packed(first - np.repeat(lo, stop - start), stop - start, pa.int64())],
                ["doc_id", "start", "stretch", "seeds", "places"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, stretch array<long>, seeds array<long>, places array<long>")


def verified(stretch: np.ndarray, item: np.ndarray, shift: int, length: int, differ: float) -> tuple[int, int, int] | None:
    """The longest run of places, of at least ``length``, in which no window of that length differs too much.

    ``shift``: the place in the stretch at which the item would start.  Returns the first and
    last + 1 place in the stretch and the number of equal words, or None.  A run doesn't begin or end with a difference.
    """
    lo, hi = max(0, shift), min(len(stretch), shift + len(item))
    length = min(length, len(item))
    if hi - lo < length:
        return None
    same = stretch[lo:hi] == item[lo - shift : hi - shift]
    total = np.concatenate([[0], np.cumsum(~same)])
    fine = total[length:] - total[:-length] <= differ * length
    if not fine.any():
        return None
    edge = np.flatnonzero(np.diff(np.concatenate([[0], fine.astype(np.int8), [0]])))
    runs_ = [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]
    a, b = max(runs_, key=lambda r: (r[1] - r[0], -r[0]))
    inside = np.flatnonzero(same[a:b])
    return lo + a + int(inside[0]), lo + a + int(inside[-1]) + 1, int(len(inside))


def contaminated(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, differ: float = DIFFER) -> DataFrame:
    """Passages of benchmark items in documents: doc_id, item_id, start and end (words of the
    document, end exclusive), item_start, n_words and n_equal; one row per document, item and alignment.

    Words are lower-cased.  A passage is ``length`` words (the whole of a shorter item) of which
    ``differ`` of the places at most are other words.  Seeds ignore the free positions of their
    masks, so that a substituted word there hides nothing.  Short items, of one word too, are found by
    masks of their own, which texts are searched with only if the benchmark has such items.  All
    different texts of an item_id are searched.

    Training seeds are held against a filter of fixed size that knows the benchmark's seeds, so
    only stretches around likely hits are joined; a bigger benchmark only fills the
    filter.  Null or empty texts, rows without doc_id and items without id have no passages;
    repeated rows give one.  Other columns of either table are not read.
    """
    items = written(benchmark_words(benchmark).distinct().withColumn("key", F.xxhash64("item_id", "item")), "items")
    short = items.select(F.size("item").alias("n")).where(F.col("n") < SPAN).distinct().collect()
    masks = (*MASKS, *sorted({mask_of(r["n"]) for r in short}))
    known = written(benchmark_seeds(items.select("key", "item")), "seeds")
    near = clusters(docs.where("doc_id IS NOT NULL"), seed_filter(known), masks)
    near = written(near.dropDuplicates(["doc_id", "start"]), "stretches")
    hits = near.select("doc_id", "start", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("doc_id", "start", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    lines = hits.join(known, "seed").select("doc_id", "start", "key", (F.col("place") - F.col("item_word")).alias("shift")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, item_id, shift, stretch, item in zip(*(batch.column(i).to_pylist() if i < 4 else batch.column(i) for i in range(6))):
                found = verified(stretch.values.to_numpy(), item.values.to_numpy(), shift, length, differ)
                if found:
                    rows.append((doc, item_id, start + found[0], start + found[1], found[0] - shift, found[1] - found[0], found[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], ["doc_id", "item_id", "start", "end", "item_start", "n_words", "n_equal"])

    full = lines.join(items, "key").join(near.select("doc_id", "start", "stretch"), ["doc_id", "start"]).select("doc_id", "start", "item_id", "shift", "stretch", "item")
    return full.mapInArrow(run, "doc_id long, item_id long, start long, end long, item_start long, n_words long, n_equal long").distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns as they were; rows without doc_id stay."""
    flag = unused(docs, "leaked")
    leaked = contaminated(docs, benchmark, **how).select("doc_id").distinct().withColumn(flag, F.lit(True))
    return docs.join(leaked, "doc_id", "left").where(F.col(flag).isNull()).select(docs.columns)


def op8_benchmark_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
