"""Incremental forms of the batch jobs, with the same answers.

Nothing is dropped for lateness.  Sinks are folders with one sub-folder per micro-batch;
a retried batch overwrites its own sub-folder, so every batch counts once, and readers
keep the newest row or version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructType

from spanloom.functions.ordered import latest
from spanloom.operators.usage import CALL_KEY, usage_by_day
from spanloom.session import shared_folder

SESSION = ["platform", "session_id"]
ABANDONED_MS = 6 * 3600 * 1000  # fixed value: an open turn is given up after six hours


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a batch-partitioned folder, or an empty frame before the first batch; any other failure to read is one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], *, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def drain(query: StreamingQuery) -> None:
    query.awaitTermination()


# --- tail and ingest -------------------------------------------------------------------


def tail_stream(events: DataFrame, *, after_seq: int = -1) -> DataFrame:
    """Events past a cursor; source offsets in the checkpoint keep the place from then on."""
    return events.where(F.col("seq") > after_seq)


def ingest(records: DataFrame, bronze: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Archive records once per source id.

    Inside a batch the first position wins; ids archived before are repeats.  A record
    whose observed time cannot be read is kept apart as blocked, and a missing source time takes the observed one.
    A replaced source file is new input whose repeats fall out here.
    """
    schema = records.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen_before = F.try_to_timestamp(F.col("observed_at").cast("string"))
        good = batch.where(seen_before.isNotNull())
        first = latest(good, [*SESSION, "source_id"], "pos", first=True)
        known = stored(spark, f"{bronze}/records", StructType(list(schema.fields)).add("batch", IntegerType())).where(F.col("batch") != number)
        fresh = first.join(known.select(*SESSION, "source_id"), [*SESSION, "source_id"], "left_anti")
        fresh = fresh.withColumn("ts", F.coalesce(F.col("ts"), F.col("observed_at"))).select(*schema.fieldNames())
        _write(fresh, f"{bronze}/records", number)
        _write(batch.where(seen_before.isNull()), f"{bronze}/blocked", number)

    return start(records, checkpoint, each, once=once)


def ingest_counts(arrived: DataFrame, archived: DataFrame) -> DataFrame:
    """Archived and repeated records per session."""
    a = arrived.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("arrived"))
    b = archived.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("archived"))
    return a.join(b, SESSION, "left").withColumn("archived", F.coalesce("archived", F.lit(0))).withColumn(
        "duplicates", F.col("arrived") - F.col("archived")
    )


# --- usage -----------------------------------------------------------------------------


def usage_stream(usage: DataFrame, table: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Call table fed by usage rows; each batch is folded to its last row per call before it is stored."""

    def each(batch: DataFrame, number: int) -> None:
        _write(latest(batch, CALL_KEY, "pos"), table, number)

    return start(usage, checkpoint, each, once=once)


def read_calls(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """Calls of the table: per call the row with the highest position, whatever batch brought it."""
    return latest(stored(spark, table, schema).select(*schema.fieldNames()), CALL_KEY, "pos")


def daily_stream(usage: DataFrame, table: str, days: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Daily report kept current: days touched by a batch are computed anew from the call table.

    A corrected call may have moved to another day, so its former day counts as touched.
    """
    schema = usage.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = stored(spark, table, StructType(list(schema.fields)).add("batch", IntegerType())).where(F.col("batch") != number)
        changed = batch.select(*CALL_KEY).distinct()
        moved = before.join(changed, CALL_KEY, "left_semi").select(F.to_date("ts").alias("day"))
        touched = batch.select(F.to_date("ts").alias("day")).unionByName(moved).where("day is not null").distinct()
        _write(latest(batch, CALL_KEY, "pos"), table, number)
        calls = read_calls(spark, table, schema)
        fresh = calls.withColumn("day", F.to_date("ts")).join(touched, "day", "left_semi").drop("day")
        report = usage_by_day(fresh)
        _write(touched.join(report, "day", "left").na.fill(0), days, number)

    return start(usage, checkpoint, each, once=once)


def read_days(spark: SparkSession, days: str) -> DataFrame:
    """Newest version of every day, with the days between filled by zeros."""
    columns = ["sessions", "events", "input_tokens", "output_tokens", "total_tokens"]
    rows = spark.read.parquet(days)
    last = rows.groupBy("day").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("day", "r.*").where("events > 0")
    span = last.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    calendar = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(last, "day", "left").na.fill(0)


# --- recompute touched sessions --------------------------------------------------------


def recompute_touched(
    rows: DataFrame, bronze: str, out: str, checkpoint: str, job: Callable[[DataFrame], DataFrame], *, once: bool = True
) -> StreamingQuery:
    """Run a batch job again over whole sessions that a batch touched; versions are kept per batch.

    Late results and corrections therefore change what was said before, as a full run would.
    """
    schema = rows.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _write(batch, bronze, number)
        touched = batch.select(*SESSION).distinct()
        everything = stored(spark, bronze, schema)
        result = job(everything.join(touched, SESSION, "left_semi"))
        _write(result, out, number)
        _write(touched, f"{out}_touched", number)

    return start(rows, checkpoint, each, once=once)


def newest_version(spark: SparkSession, out: str) -> DataFrame:
    """Rows of each session's newest version; a session whose newest version is empty has none."""
    rows = spark.read.parquet(out)
    last = spark.read.parquet(f"{out}_touched").groupBy(*SESSION).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*SESSION, "batch"], "left_semi").drop("batch")


def emit_once(
    rows: DataFrame, bronze: str, out: str, checkpoint: str, job: Callable[[DataFrame], DataFrame], key: list[str], *, grew: str | None = None, once: bool = True
) -> StreamingQuery:
    """Append results of touched sessions that were not emitted before.

    With ``grew``, a result is emitted again when that number exceeds every emitted one.
    """
    schema = rows.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _write(batch, bronze, number)
        touched = batch.select(*SESSION).distinct()
        now = job(stored(spark, bronze, schema).join(touched, SESSION, "left_semi"))
        before = stored(spark, out, StructType(list(now.schema.fields)).add("batch", IntegerType())).where(F.col("batch") != number)
        if grew is None:
            fresh = now.join(before.select(*key), key, "left_anti")
        else:
            top = before.groupBy(*key).agg(F.max(grew).alias("__top"))
            fresh = now.join(top, key, "left").where(F.col("__top").isNull() | (F.col(grew) > F.col("__top"))).drop("__top")
        _write(fresh.select(*now.columns), out, number)

    return start(rows, checkpoint, each, once=once)


# --- keyed state -----------------------------------------------------------------------


def _sorted(frames: Iterator[pd.DataFrame], order: str) -> Iterator[tuple]:
    """Rows a session sent in this micro-batch, in order; the trigger bounds how many."""
    yield from pd.concat(list(frames)).sort_values(order).itertuples(index=False)


def assign_seq(rows: DataFrame) -> DataFrame:
    """Next dense number of each session for arriving rows, ordered by ``pos`` inside a micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for row in _sorted(frames, "pos"):
            out.append((*key, int(row.pos), n))
            n += 1
        state.update((n,))
        yield pd.DataFrame(out, columns=["platform", "session_id", "pos", "n"])

    return rows.select(*SESSION, "pos").groupBy(*SESSION).applyInPandasWithState(
        step, "platform string, session_id string, pos bigint, n bigint", "n bigint", "append", GroupStateTimeout.NoTimeout
    )


def incremental_calls(frames: DataFrame) -> DataFrame:
    """Model calls whose group has ended; the trailing group of a session stays in state.

    Rows need pos, role (``user`` / ``call`` / NULL), call_id, ts and the two token counts.
    """
    out_schema = "platform string, session_id string, pos bigint, call_id string, start_ts timestamp, end_ts timestamp, input_tokens bigint, output_tokens bigint, frames bigint"
    state_schema = "prev_ts timestamp, open boolean, pos bigint, call_id string, start_ts timestamp, last_ts timestamp, input_tokens bigint, output_tokens bigint, frames bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, False, None, None, None, None, 0, 0, 0]
        prev, group = held[0], held[1:]
        done = []

        def close() -> None:
            if group[0]:
                end = group[4] or group[3]
                begin = end if group[3] is None or (end is not None and group[3] > end) else group[3]
                done.append((*key, group[1], group[2], begin, end, group[5], group[6], group[7]))
            group[:] = [False, None, None, None, None, 0, 0, 0]

        for row in _sorted(batches, "pos"):
            ts = None if pd.isna(row.ts) else row.ts.to_pydatetime()
            if row.role == "user":
                close()
            elif row.role == "call":
                if group[0] and group[2] != row.call_id:
                    close()
                if not group[0]:
                    group[:] = [True, int(row.pos), row.call_id, prev or ts, ts, int(row.input_tokens), int(row.output_tokens), 1]
                else:
                    group[4] = ts or group[4]
                    group[7] += 1
            prev = ts or prev
        state.update((prev, *group))
        names = [c.strip().split()[0] for c in out_schema.split(",")]
        yield pd.DataFrame(done, columns=names)

    return frames.groupBy(*SESSION).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def open_turns(events: DataFrame, *, abandoned_ms: int = ABANDONED_MS) -> DataFrame:
    """How each prompt ended: answered, interrupted by the next prompt, or abandoned after a time of silence."""
    out_schema = "platform string, session_id string, prompt_seq bigint, end_seq bigint, status string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        done = []
        if state.hasTimedOut:
            if held is not None:
                done.append((*key, held, None, "abandoned"))
            state.remove()
        else:
            for row in _sorted(batches, "seq"):
                if row.t == "user_message":
                    if held is not None:
                        done.append((*key, held, int(row.seq), "interrupted"))
                    held = int(row.seq)
                elif row.t == "assistant_message" and held is not None:
                    done.append((*key, held, int(row.seq), "completed"))
                    held = None
            if held is None:
                if state.exists:
                    state.remove()
            else:
                state.update((held,))
                state.setTimeoutDuration(abandoned_ms)
        yield pd.DataFrame(done, columns=["platform", "session_id", "prompt_seq", "end_seq", "status"]).astype({"prompt_seq": "Int64", "end_seq": "Int64"})

    kept = events.where(F.col("t").isin("user_message", "assistant_message")).select(*SESSION, "seq", "t")
    return kept.groupBy(*SESSION).applyInPandasWithState(step, out_schema, "prompt_seq bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_folder(stream: DataFrame, out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet folder."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
