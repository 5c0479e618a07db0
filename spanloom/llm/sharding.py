"""Shards of near-equal size: minimax contiguous partition of ordered, indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import documents, written

#: Blocks of groups that the driver knows the ends of, at most, after each look at the table.
BLOCKS = 8192


def running(df: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """``df`` with running sums ``to_<column>`` (long) over the whole table in the given order, as a written table.

    A range shuffle sorts; each task sums its own rows as they pass, and the tasks' totals, one row
    each, are added to what follows.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"to_{c}", T.LongType()) for c in sums), T.StructField("part_", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, part = np.zeros(len(sums), np.int64), TaskContext.get().partitionId()
        for batch in batches:
            out = [*batch.columns]
            for i, c in enumerate(sums):
                total = held[i] + np.cumsum(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64))
                out.append(pa.array(total))
                held[i] = total[-1] if len(total) else held[i]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(batch.num_rows, part), pa.int32())], schema.names)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), f"{name}-local")
    ends = local.groupBy("part_").agg(*(F.max(f"to_{c}").alias(c) for c in sums)).orderBy("part_").collect()
    before, total = [], [0] * len(sums)
    for r in ends:
        before.append((r["part_"], *total))
        total = [t + r[c] for t, c in zip(total, sums)]
    offsets = df.sparkSession.createDataFrame(before, "part_ int" + "".join(f", {c}_ long" for c in sums))
    whole = local.join(F.broadcast(offsets), "part_").select(*df.columns, *((F.col(f"to_{c}") + F.col(f"{c}_")).alias(f"to_{c}") for c in sums))
    return written(whole, name)


@dataclass
class Blocks:
    """Ends of blocks of groups in size order along the table; ``single``: whether a block is one group."""

    ends: list[int]
    single: list[bool]

    def cut(self, start: int, capacity: int, hope: bool) -> int:
        """How far a shard from ``start`` reaches: to the last known end that fits or, in ``hope``, into a block of several groups."""
        reach = start + capacity
        i = bisect_right(self.ends, reach)
        known = max(start, self.ends[i - 1] if i else 0)
        return reach if hope and i < len(self.ends) and not self.single[i] else known

    def cuts(self, capacity: int, shards: int, hope: bool) -> list[int] | None:
        """Greedy ends of all shards, or None where they don't hold everything."""
        out, at = [], 0
        for _ in range(shards):
            at = min(self.cut(at, capacity, hope), self.ends[-1])
            out.append(at)
        return out if at == self.ends[-1] else None

    def smallest(self, shards: int, hope: bool) -> int:
        """The smallest capacity whose greedy check succeeds, by binary search."""
        low, high = -(-self.ends[-1] // shards), self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, hope) is None:
                low = mid + 1
            else:
                high = mid
        return low


def _ends(groups: DataFrame, todo: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Finer blocks of those given by their first and last group end: last end -> (first end, groups).

    A block of several groups falls into two at least, as its first and last end part.
    """
    first, last = (np.array(x, np.int64) for x in zip(*todo))
    each = max(2, BLOCKS // len(todo))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = batch.column(0).to_numpy()
            i = np.minimum(np.searchsorted(last, end), len(last) - 1)
            inside = (end >= first[i]) & (end <= last[i])
            end, i = end[inside], i[inside]
            block = i * each + (end - first[i]) * each // (last[i] - first[i] + 1)
            ids, of = np.unique(block, return_inverse=True)
            low, high = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
            np.minimum.at(low, of, end)
            np.maximum.at(high, of, end)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, low, high, np.bincount(of, minlength=len(ids)))], ["block", "low", "high", "n"])

    parts = groups.select("to_size").where(F.col("to_size").between(int(first[0]), int(last[-1]))).mapInArrow(run, "block long, low long, high long, n long")
    rows = parts.groupBy("block").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    return {r["high"]: (r["low"], r["n"]) for r in rows}


def minimax(groups: DataFrame, shards: int) -> list[int]:
    """The running sizes at which to cut ``groups(to_size)`` into ``shards`` runs with the smallest possible largest size.

    The greedy check needs, 24 times over, the last group end below a bound.  The driver knows
    block ends only: cutting at known ends alone gives a capacity that surely works, cutting inside blocks
    at will one that surely must be reached.  While the two differ, the blocks in which a
    cut may fall are looked at again, more finely; each look is one filtered aggregation
    that returns ``BLOCKS`` rows at most.  The result is exact.

    Of the partitions with that largest size, one with cuts near the even ones is taken where
    known ends allow it.
    """
    total = groups.agg(F.max("to_size")).first()[0]
    if not total:
        return [0] * shards
    found = _ends(groups, [(0, total)])
    even = [total * i // shards for i in range(1, shards)]
    while True:
        ends = sorted(found)
        known = Blocks(ends, [found[e][1] == 1 for e in ends])
        least, most = known.smallest(shards, True), known.smallest(shards, False)
        if least == most:
            break
        near, at = {bisect_left(ends, e) for e in even}, 0
        for high in known.cuts(most, shards, True):
            at = min(known.cut(at, least, False), total)
            near |= set(range(bisect_left(ends, at), min(bisect_left(ends, high), len(ends) - 1) + 1))
        todo = [(found[ends[j]][0], ends[j]) for j in sorted(near) if found[ends[j]][1] > 1]
        for _, end in todo:
            del found[end]
        found |= _ends(groups, todo)
    return balanced(ends, known, most, shards)


def balanced(ends: list[int], known: Blocks, capacity: int, shards: int) -> list[int]:
    """Cuts at known ends, none of whose shards is over ``capacity``, each near its even place."""
    total = ends[-1]
    last = known.cuts(capacity, shards, False)
    first, at = [total], total
    for _ in range(shards - 1):
        i = bisect_left(ends, at - capacity)
        at = 0 if at <= capacity else min(ends[i], at)
        first.append(at)
    first = first[::-1]
    if any(a > b for a, b in zip(first, last)):
        return last
    out, at = [], 0
    for i in range(shards):
        goal = total * (i + 1) // shards
        k = bisect_right(ends, goal)
        choices = [e for e in (*ends[max(0, k - 1) : k + 1], last[i], max(first[i], at)) if max(first[i], at) <= e <= min(last[i], at + capacity)]
        if not choices:
            return last
        at = min(choices, key=lambda e: (abs(e - goal), e))
        out.append(at)
    return out


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    Law ``bytes``: groups of equal texts, in the order of their smallest doc_id, are cut into contiguous
    shards so that the largest shard is as small as whole groups allow.  size is the text's
    UTF-8 bytes plus 8; slots count a shard's rows in group order, then by doc_id.  More shards
    move rows, so grown_shard is null.

    Null texts are a group of their own, apart from empty ones (size 8, CRC 0 both).  Repeated rows are rows
    of one group, each with its slot; rows without doc_id come first.  A group bigger than an
    even share fills a shard alone.  Extra columns are not read.
    """
    text = F.col("text").cast("string")
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("text_id")),
        "rows",
    )
    low = F.min(F.coalesce("doc_id", F.lit(-(1 << 63))))
    groups = running(rows.groupBy("text_id").agg(low.alias("first"), F.sum("size").alias("size")), ["first", "text_id"], ["size"], "groups")
    cuts = minimax(groups, shards)
    shard = F.lit(shards - 1)
    for i in range(shards - 2, -1, -1):
        shard = F.when(F.col("to_size") <= cuts[i], i).otherwise(shard)
    placed = rows.join(groups.select("text_id", "first", shard.alias("shard")), "text_id").withColumn("one", F.lit(1))
    numbered = running(placed.select("shard", "first", "text_id", "doc_id", "size", "text_crc32", "one"), ["shard", "first", "text_id", "doc_id"], ["one"], "slots")
    count = {r["shard"]: r["n"] for r in numbered.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    base, at = [], 0
    for i in range(shards):
        base.append(F.lit(at).cast("long"))
        at += count.get(i, 0)
    slot = F.col("to_one") - 1 - F.array(*base)[F.col("shard")]
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir):
    return sharded(documents(spark, sf_dir))


QUERIES = {"op3_sharding": op3_sharding}
