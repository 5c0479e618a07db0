"""Gapless numbers in sort order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written


def numbered(df: DataFrame, order: list[Column], into: str = "n", part: str = "part") -> DataFrame:
    """Rows of ``df`` with column ``into``, 0, 1, 2, ... in ``order``, and ``part``, the range partition.

    One range shuffle sorts the rows, which are written with their place in their partition; the
    driver reads one row count per partition, whose running sums are broadcast (as many rows as
    partitions).  ``order`` should end in a column that tells rows apart, so that equal
    keys can be split between partitions.  An empty table stays empty.
    """
    spark = df.sparkSession
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(into, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(into, 33).cast("int"))
    before, offsets = 0, []
    for p, n in sorted(map(tuple, rows.groupBy(part).count().collect())):
        offsets.append((p, before))
        before += n
    at = spark.createDataFrame(offsets, f"{part} int, before long")
    place = F.col(into).bitwiseAND((1 << 33) - 1) + F.col("before")
    return rows.join(F.broadcast(at), part).withColumn(into, place).select(*df.columns, into, part)
