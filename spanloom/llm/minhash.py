"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import documents, packed, slices, written
from spanloom.llm.graph import components
from spanloom.llm.words import U, mix, shingle_sets, words

#: Rows of a band and bands: at a similarity of 0.8 a pair misses all bands in 1 of a million cases.
ROWS, BANDS = 6, 46
CHUNK = 1 << 16
#: Documents that meet in one comparison of blocks, about.
BLOCK = 48


def second_permutation(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit values, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def circulant(values: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """(coordinates, texts) minima: the first permutation scatters the shingles over a circle of
    2^32 places, the second one, turned by k places, orders them for coordinate k.

    Texts without shingles keep the largest value.
    """
    out = np.full((coordinates, len(counts)), 0xFFFFFFFF, np.uint32)
    place = (mix(values ^ U(0xA0761D6478BD642F)) >> U(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    for a in range(0, len(place), CHUNK):
        part = place[a : a + CHUNK]
        docs = np.flatnonzero((counts > 0) & (ends > a) & (ends - counts < a + len(part)))
        starts = np.maximum(ends[docs] - counts[docs] - a, 0)
        turned, spare = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.subtract(part, np.uint32(k), out=turned)
            low = np.minimum.reduceat(second_permutation(turned, spare), starts)
            out[k, docs] = np.minimum(out[k, docs], low)
    return out


def signatures(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and its band keys (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            values, counts = shingle_sets(words(texts), len(texts), shingle)
            sig = circulant(values, counts, rows * bands).astype(np.uint64)
            keys = np.empty((len(texts), bands), np.uint64)
            for b in range(bands):
                key = np.full(len(texts), b + 1, np.uint64)
                for r in range(rows):
                    key = mix(key + sig[b * rows + r])
                keys[:, b] = key
            full = counts > 0
            at = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=at[1:])
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + U(salt)))]) for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts)] + [pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums]
                + [packed(keys[full].reshape(-1).view(np.int64), np.where(full, bands, 0), pa.int64())],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """The sorted shingles of the documents in ``ids``, as packed 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            values, counts = shingle_sets(words(texts), len(texts), shingle)
            at = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts * 8, out=at[1:])
            data = values.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "members"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    return chosen.mapInArrow(run, "doc_id long, members binary")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, counted on the full sets.

    The likely hub ``a`` is looked up first, while rows are narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, keep = batch.column(2), batch.column(3), []
            last, hub = None, None
            for i in range(batch.num_rows):
                x = first[i].as_buffer()
                if last is None or not x.equals(last):
                    last, hub = x, np.frombuffer(x, "<u8")
                other = np.frombuffer(second[i].as_buffer(), "<u8")
                small, large = (hub, other) if len(hub) < len(other) else (other, hub)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum()) if len(large) else 0
                keep.append(100 * common >= percent * (len(hub) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def star_members(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """center, doc_id, component, stray: who shares a bucket with its smallest document, where they are of several components.

    stray: not of the component that most of a center's members belong to.
    """
    near = buckets.where("doc_id <> center").select("center", "doc_id").distinct()
    placed = near.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("center", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = written(placed, "placed")
    counts = placed.groupBy("center", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("center").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    main = written(main.select("center", F.col("top.component").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks")), "main")
    return placed.join(main, "center").select("center", "doc_id", "component", (F.col("component") != F.col("main")).alias("stray"), F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"))


def links_between(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between strays of a center and all its members of other components.

    Strays and members meet in blocks of about ``BLOCK`` documents, each block of strays with each
    of members: so many comparisons take few rows, and a large group spreads over many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for strays, others in zip(batch.column(0), batch.column(1)):
                ids = np.array([o["doc_id"].as_py() for o in others])
                parts = np.array([o["component"].as_py() for o in others])
                values = [np.frombuffer(o["members"].as_buffer(), "<u8") for o in others]
                sizes = np.array([len(v) for v in values])
                of, flat = np.repeat(np.arange(len(ids)), sizes), np.concatenate(values)
                for s in strays:
                    own, me = np.frombuffer(s["members"].as_buffer(), "<u8"), s["doc_id"].as_py()
                    at = np.searchsorted(own, flat)
                    at[at == len(own)] = 0
                    common = np.bincount(of[own[at] == flat], minlength=len(ids))
                    fits = (100 * common >= percent * (len(own) + sizes - common)) & (parts != s["component"].as_py())
                    a += [me] * int(fits.sum())
                    b += ids[fits].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = written(members.join(sets, "doc_id"), "blocks")
    content = F.collect_list(F.struct("doc_id", "component", "members"))
    right = full.groupBy("center", "block").agg(content.alias("others"))
    left = full.where("stray").groupBy("center", "block").agg(content.alias("strays")).withColumnRenamed("block", "stray_block")
    blocks = members.select("center", "block").distinct()
    pairs = members.where("stray").select("center", F.col("block").alias("stray_block")).distinct().join(blocks, "center")
    return pairs.join(left, ["center", "stray_block"]).join(right, ["center", "block"]).select("strays", "others").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents link where their sets of ``shingle`` lower-cased words reach ``percent`` of
    their union; ``component_id`` is the smallest doc_id reachable.

    * Documents of equal sets are one class; only its smallest doc_id goes on.
    * Each member of a bucket is compared with the bucket's smallest, its center, which links most
      groups with as many comparisons as members.  Then, around each center whose members are of
      several components, those outside the largest are compared with all members of other components, in
      blocks.  So each two documents of a bucket are compared or of one component already: components
      are those of all pairs in all buckets, and no pairs are formed within one.

    Null or wordless texts have an empty set and link with nothing.  Rows without doc_id get a
    null component and are kept.  Repeated rows get equal answers.  Columns other than doc_id
    and text are not read.
    """
    signed = written(signatures(docs, shingle, rows, bands), "signatures")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    member = written(
        signed.join(classes, ["n_shingles", "set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")),
        "members",
    )
    reps = member.where("doc_id = rep AND n_shingles > 0").select("doc_id", "n_shingles", "bands").distinct()
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = written(keyed.join(written(shared, "shared"), "key"), "buckets")
    sizes = reps.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles")
    sets = written(full_sets(docs, buckets.select("doc_id").distinct(), shingle).dropDuplicates(["doc_id"]), "sets")
    sizes = written(sizes, "sizes")

    n_a, n_b = F.col("n_a"), F.col("n_b")
    alike = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    star = buckets.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = star.join(sizes.selectExpr("doc_id AS a", "n_shingles AS n_a"), "a").join(sizes.selectExpr("doc_id AS b", "n_shingles AS n_b"), "b").where(alike).select("a", "b")
    found = written(links(star, sets, percent), "links")
    labels = components(found)
    more = written(links_between(star_members(buckets, labels), sets, percent), "links")
    final = components(found.union(more))

    out = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, all columns as they were.

    Of rows that share a doc_id one stays; rows without doc_id stay.
    """
    kept = near_duplicates(docs, **how).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op5_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), shingle=2)


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
