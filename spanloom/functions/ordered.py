"""Order-dependent computation over logs without putting a session in one task.

A log is ordered by a BIGINT that is unique inside its key (``seq`` of an
event, ``pos`` of a line).  Keys with more than ``width`` rows are cut, by their own
lowest and highest order, into as many chunks of equal extent as they have ``width``
rows; so orders may be sparse, and a session holding a third of all rows is spread over many
tasks.  All other keys are one chunk.  Every running value is computed in two steps: inside
the chunk with an ordinary window, and across chunks with a window over one summary
row per chunk.  Only keys that are cut have such summaries, at most one for ``width`` rows and one for
each key, so the carry is broadcast.

Whether any key is large is found first, from row counts of a fixed number of hash cells.  Without
one a scan is a plain window, one shuffle.  So a scan reads its input twice, or four times when keys are cut; operators
that need one scan on top of another cut the lineage of the narrow rows in between.  Where sessions were counted once (``whole_keys``),
scans of their parts are told so and neither count again nor need such cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from spanloom.session import cut_lineage, prepare

CHUNK_ROWS = 65_536
CHUNK = "__chunk"
#: Keys that are cut: the largest ones.  Any other holds less than one in so many rows, a task's share.
LARGEST = 4096
#: Hash cells in which rows are counted before keys are.
CELLS = 1 << 15


def telling(keys: Sequence[str]) -> list[str]:
    """The keys with the platform last: rows are sorted by leading bytes of the first key, which tell nothing if all are equal."""
    return sorted(keys, key=lambda k: k == "platform")


def _same(left: DataFrame, right: DataFrame, names: Iterable[str]) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & left[name].eqNullSafe(right[f"__c_{name}"])
    return cond


def large_keys(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame | None:
    """Keys with more than ``width`` rows, at most the ``LARGEST``, with the extent of a chunk; None if there are none.

    A key can only be large in a hash cell that is, so keys are counted in such cells alone.
    """
    keys = list(keys)
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS))
    counts = df.groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    cells = [r[0] for r in counts.where(F.col("__n") > width).select("__cell").collect()]
    if not cells:
        return None
    found = df if len(cells) > CELLS // 32 else df.where(cell.isin(cells))
    sizes = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    large = sizes.where(F.col("__n") > width).orderBy(F.desc("__n"), *keys).limit(LARGEST)
    pieces = f"(__n + {width - 1}) div {width}"
    large = cut_lineage(large.select(*[F.col(k).alias(f"__c_{k}") for k in keys], "__lo", F.expr(f"(__hi - __lo) div ({pieces}) + 1").alias("__extent")))
    return None if large.isEmpty() else large


def whole_keys(df: DataFrame, keys: Sequence[str], width: int = CHUNK_ROWS) -> bool:
    """Whether no key can have more than ``width`` rows; then no key made of it and other columns has, nor any part of the rows."""
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS))
    return df.groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > width).isEmpty()


def _cut(df: DataFrame, keys: Sequence[str], order: str, large: DataFrame) -> DataFrame:
    part = F.coalesce(F.expr(f"(`{order}` - __lo) div __extent") + 1, F.lit(0).cast("bigint"))
    return df.join(F.broadcast(large), _same(df, large, keys), "left").withColumn(CHUNK, part).select(*df.columns, CHUNK)


def chunked(df: DataFrame, keys: Sequence[str], order: str, width: int = CHUNK_ROWS) -> DataFrame:
    """Rows with their chunk, which rises with ``order`` in its key: 0 for a whole key, 1, 2, ... for the parts of a large one.

    At most ``LARGEST`` keys are cut, so what is broadcast is bounded; the sizes are sums, minima and
    maxima, so every reading of the rows finds the same chunks.
    """
    large = large_keys(df, keys, order, width)
    return df.withColumn(CHUNK, F.lit(0).cast("bigint")) if large is None else _cut(df, keys, order, large)


def _carry(
    staged: DataFrame, keys: list[str], order: str, sums: list[str], floors: list[str], recent: list[str], reverse: bool
) -> DataFrame:
    """What the earlier chunks of a cut key bring to each of its chunks."""
    parts = [*keys, CHUNK]
    running = [*sums, *floors]
    by = F.col(order).desc() if reverse else F.col(order).asc()
    chunk_by = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    pick = F.min_by if reverse else F.max_by
    upto = Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.sum(f"__s_{n}").alias(f"__t_{n}") for n in running]
    totals += [
        pick(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), F.col(order))).alias(f"__r_{n}")
        for n in recent
    ]
    if floors:
        low = staged.select(*parts, order, *[f"__s_{n}" for n in running], *[f"__l_{n}" for n in recent])
        low = low.withColumns({f"__b_{n}": F.sum(f"__s_{n}").over(upto) for n in floors})
        totals += [F.min(f"__b_{n}").alias(f"__m_{n}") for n in floors]
    else:
        low = staged
    per_chunk = low.where(F.col(CHUNK) > 0).groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"), *totals)

    earlier = Window.partitionBy(*keys).orderBy(chunk_by).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *parts,
        F.count(F.lit(1)).over(earlier).alias("__k"),
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__cs_{n}") for n in running],
        *[F.last(f"__r_{n}", ignorenulls=True).over(earlier).alias(f"__cl_{n}") for n in recent],
        *[f"__m_{n}" for n in floors],
    )
    if floors:
        carry = carry.withColumns(
            {
                f"__cm_{n}": F.min(F.coalesce(F.col(f"__cs_{n}"), F.lit(0)) + F.col(f"__m_{n}")).over(earlier)
                for n in floors
            }
        ).drop(*[f"__m_{n}" for n in floors])
    return carry.where("__k > 0").drop("__k").withColumnsRenamed({p: f"__c_{p}" for p in parts})


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    befores: Mapping[str, Column] | None = None,
    floors: Mapping[str, Column] | None = None,
    reverse: bool = False,
    width: int = CHUNK_ROWS,
    whole: bool = False,
) -> DataFrame:
    """Add running columns per key in ``order``.

    ``sums``: running total including the row.  ``lasts``: last non-null value up to
    and including the row.  ``befores``: last non-null value strictly before the row.
    ``floors``: smallest running total so far (0 before any row), as ``name``, its
    value just before the row as ``name_before``.  ``reverse`` walks the other way, so
    ``befores`` then gives the next non-null value after the row.  ``whole``: the caller knows
    by ``whole_keys`` that no key has more than ``width`` rows.
    """
    sums, lasts, befores, floors = (dict(m or {}) for m in (sums, lasts, befores, floors))
    prepare(df.sparkSession)
    keys = list(keys)
    large = None if whole else large_keys(df, keys, order, int(width))
    parts = keys if large is None else [*keys, CHUNK]
    by = F.col(order).desc() if reverse else F.col(order).asc()

    running = {**sums, **floors}
    recent = {**lasts, **befores}
    staged = (df if large is None else _cut(df, keys, order, large)).withColumns(
        {
            **{f"__s_{n}": F.coalesce(e.cast("bigint"), F.lit(0)) for n, e in running.items()},
            **{f"__l_{n}": e for n, e in recent.items()},
        }
    )
    upto = Window.partitionBy(*telling(parts)).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*telling(parts)).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    inner = {f"__s_{n}": F.sum(f"__s_{n}").over(upto) for n in running}
    out = staged.withColumns(inner | {f"__i_{n}": F.last(f"__l_{n}", ignorenulls=True).over(
        upto if n in lasts else prior) for n in recent})
    if floors:
        out = out.withColumns(
            {f"__f_{n}": F.min(f"__s_{n}").over(upto) for n in floors}
            | {f"__g_{n}": F.min(f"__s_{n}").over(prior) for n in floors}
        )
    if large is None:
        carried_columns = {f"__cs_{n}": F.lit(0).cast("bigint") for n in running} | {f"__cm_{n}": F.lit(0).cast("bigint") for n in floors}
        out = out.withColumns(carried_columns)
        final = {n: F.col(f"__i_{n}") for n in recent}
    else:
        carry = _carry(staged, keys, order, list(sums), list(floors), list(recent), reverse)
        out = out.join(F.broadcast(carry), _same(out, carry, parts), "left")
        final = {n: F.coalesce(F.col(f"__i_{n}"), F.col(f"__cl_{n}")) for n in recent}
    base = {n: F.coalesce(F.col(f"__cs_{n}"), F.lit(0)) for n in running}
    final |= {n: F.col(f"__s_{n}") + base[n] for n in sums}
    for n in floors:
        carried = F.coalesce(F.col(f"__cm_{n}"), F.lit(0))
        final[n] = F.least(carried, F.col(f"__f_{n}") + base[n], F.lit(0))
        final[f"{n}_before"] = F.least(carried, F.col(f"__g_{n}") + base[n], F.lit(0))
    kept = [c for c in df.columns if c not in final]
    return out.select(*kept, *[expr.alias(n) for n, expr in final.items()])


def number(df: DataFrame, keys: Sequence[str], order: str, name: str, *, width: int = CHUNK_ROWS, whole: bool = False) -> DataFrame:
    """Dense 0-based position of each row inside its key."""
    out = scan(df, keys, order, sums={name: F.lit(1)}, width=width, whole=whole)
    return out.withColumn(name, F.col(name) - 1)


def number_by(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Dense 0-based position for an order that is not one BIGINT.

    ``bucket`` must rise with ``order`` (a truncated time, for example); rows are ranked
    inside a bucket and shifted by the row count of the earlier buckets.
    """
    keys = list(keys)
    staged = df.withColumn(CHUNK, bucket)
    parts = [*keys, CHUNK]
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        staged.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*parts, F.sum("__n").over(earlier).alias("__shift"))
        .where("__shift is not null")
        .withColumnsRenamed({p: f"__c_{p}" for p in parts})
    )
    ranked = staged.withColumn(name, F.row_number().over(Window.partitionBy(*telling(parts)).orderBy(*order)))
    return ranked.join(shift, _same(ranked, shift, parts), "left").select(
        *[c for c in df.columns if c != name],
        (F.col(name) - 1 + F.coalesce(F.col("__shift"), F.lit(0))).cast("bigint").alias(name),
    )


def latest(df: DataFrame, keys: Sequence[str], order: str | Column, *, first: bool = False) -> DataFrame:
    """The row with the largest (or smallest) order per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), order).alias("__row"))
        .select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def queue_pairs(
    df: DataFrame, keys: Sequence[str], order: str, opens: Column, closes: Column, *, width: int = CHUNK_ROWS
) -> DataFrame:
    """Number opens and closes so that equal numbers are first-in-first-out partners.

    A close that meets an empty queue is dropped (``pair_no`` NULL): it is the row on
    which the running minimum of (+1 open, -1 close) falls to a new low.
    """
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    out = scan(
        df,
        keys,
        order,
        sums={
            "__opens": F.when(opens, 1).otherwise(0),
            "__closes": F.when(closes & ~F.coalesce(opens, F.lit(False)), 1).otherwise(0),
        },
        floors={"__low": step},
        width=width,
    )
    lost = F.col("__low") < F.col("__low_before")
    return out.withColumn(
        "pair_no",
        F.when(opens, F.col("__opens")).when(closes & ~lost, F.col("__closes") + F.col("__low")),
    ).drop("__opens", "__closes", "__low", "__low_before")


def stack_pairs(
    df: DataFrame, keys: Sequence[str], order: str, opens: Column, closes: Column, *, width: int = CHUNK_ROWS
) -> DataFrame:
    """Last-in-first-out partner of each close as ``partner`` (the order value of its open).

    Depth after underflow is the running sum minus its running minimum; an open and the
    close that undoes it sit on the same level, and are neighbours there.
    """
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    out = scan(df, keys, order, sums={"__sum": step}, floors={"__low": step}, width=width)
    lost = closes & (F.col("__low") < F.col("__low_before"))
    depth = F.col("__sum") - F.col("__low")
    out = cut_lineage(out.withColumn("__level", F.when(opens, depth).when(closes & ~lost, depth + 1)))
    out = scan(
        out, [*keys, "__level"], order, befores={"partner": F.when(opens, F.col(order))}, width=width
    )
    return out.withColumn(
        "partner", F.when(closes & F.col("__level").isNotNull(), F.col("partner"))
    ).drop("__sum", "__low", "__low_before", "__level")


def walk(df: DataFrame, keys: Sequence[str], order: str, schema: StructType, start: Callable[[], tuple]) -> DataFrame:
    """Rows of each key in order through a small Python state, batch by batch.

    For pairing rules that depend on everything still open.  Rows are partitioned by key
    and sorted; no group is ever held, only the state.  ``start()`` makes the state of a
    key and returns two functions: one takes a row, the other is called at the key's end;
    both return output tuples, which follow the key columns in ``schema``.
    """
    prepare(df.sparkSession)
    keys = list(keys)
    names = [f.name for f in schema]
    types = {f.name: "Int64" for f in schema if isinstance(f.dataType, LongType)}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(types)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, on_row, on_end = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if on_end is not None:
                        out += [current + t for t in on_end()]
                    current, (on_row, on_end) = key, start()
                out += [key + t for t in on_row(row)]
            yield frame(out)
        if on_end is not None:
            yield frame([current + t for t in on_end()])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
