"""Transcripts of the claude platform: usage rows, model calls and message parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import CHUNK_ROWS, scan
from spanloom.functions.payload import child, content_parts
from spanloom.functions.times import collapse_backwards, parse_ts, valid_datetime
from spanloom.session import cut_lineage

SESSION = ["platform", "session_id"]
SYNTHETIC_MODEL = "<synthetic>"  # fixed value: marks injected messages


FRAME = (
    "struct<type:string, timestamp:string, requestId:string, uuid:string, message:struct<id:string, model:string, usage:struct<"
    "input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint>>>"
)


def call_fields(frames: DataFrame) -> DataFrame:
    """Frames with the fields that make a model call, read from the payload in one pass.

    The one-element explode keeps later filters from being pushed below the read, where
    each of their conditions would parse the payload again.
    """
    f = lambda name: F.col(f"__f.{name}")
    usage = lambda name: F.col(f"__f.message.usage.{name}")
    read, wrote = usage("cache_read_input_tokens"), usage("cache_creation_input_tokens")
    zero = F.lit(0)
    return (
        frames.withColumn("__f", F.explode(F.array(F.try_variant_get("frame", "$", FRAME))))
        .withColumns(
            {
                "type": f("type"),
                "ts_text": F.coalesce(f("timestamp"), F.lit("")),
                "has_message": f("message").isNotNull(),
                "call_id": F.coalesce(*[F.nullif(f(c), F.lit("")) for c in ("message.id", "requestId", "uuid")]),
                "response_model": F.nullif(f("message.model"), F.lit("")),
                "reported": usage("input_tokens").isNotNull() | usage("output_tokens").isNotNull(),
                "input_tokens": F.coalesce(usage("input_tokens"), zero) + F.coalesce(read, zero) + F.coalesce(wrote, zero),
                "output_tokens": F.coalesce(usage("output_tokens"), zero),
                "cache_read_input_tokens": read,
                "cache_creation_input_tokens": wrote,
            }
        )
        .drop("__f")
    )


def is_call() -> Column:
    return (
        (F.col("type") == "assistant")
        & F.col("has_message")
        & F.col("reported")
        & F.col("call_id").isNotNull()
        & F.col("response_model").isNotNull()
        & (F.col("response_model") != SYNTHETIC_MODEL)
    )


def usage_rows(frames: DataFrame) -> DataFrame:
    """One usage row per assistant frame that reports usage; stored input includes both caches."""
    return (
        call_fields(frames)
        .where(is_call())
        .select(
            *SESSION,
            "pos",
            "call_id",
            parse_ts(F.col("ts_text")).alias("ts"),
            F.lit("anthropic").alias("provider_name"),
            "response_model",
            F.lit("chat").alias("operation_name"),
            "input_tokens",
            "output_tokens",
            "cache_read_input_tokens",
            "cache_creation_input_tokens",
            F.lit(None).cast("bigint").alias("reasoning_output_tokens"),
        )
    )


def grouped_frames(frames: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Narrow frame rows with ``group_no``: consecutive call frames of one id form a group.

    A user frame or another id ends a group.  Frames that are neither still move the
    time from which the next group is taken to have started.  A user frame carries the
    number of the group before it, so it feeds group ``group_no + 1``.
    """
    marked = call_fields(frames).withColumn("ts", valid_datetime(F.col("ts_text")))
    user = (F.col("type") == "user") & F.col("has_message")
    usage = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
    role = F.when(user, "user").when(is_call(), "call").alias("role")
    marked = marked.select(*SESSION, "pos", role, "call_id", "response_model", "ts", *usage)
    marked = scan(
        marked,
        SESSION,
        "pos",
        befores={
            "prev_ts": F.col("ts"),
            "prev": F.when(F.col("role").isNotNull(), F.struct(F.col("role").alias("role"), F.col("call_id").alias("id"))),
        },
        width=width,
    )
    opens = (F.col("role") == "call") & (
        F.col("prev").isNull() | (F.col("prev.role") == "user") | (F.col("prev.id") != F.col("call_id"))
    )
    marked = cut_lineage(marked.where("role is not null").withColumn("opens", opens).drop("prev"))
    return scan(marked, SESSION, "pos", sums={"group_no": F.when(F.col("opens"), 1).otherwise(0)}, width=width)


def calls(grouped: DataFrame) -> DataFrame:
    """One row per model call: window, model and the usage its first frame reports."""
    first = [
        "call_id", "response_model", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens",
        "prev_ts", F.col("ts").alias("own_ts"),
    ]
    out = (
        grouped.where("role = 'call'")
        .groupBy(*SESSION, "group_no")
        .agg(
            F.min("pos").alias("pos"),
            F.min_by(F.struct(*first), "pos").alias("f"),
            F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("pos"))).alias("last_ts"),
            F.count(F.lit(1)).alias("frames"),
        )
        .select(*SESSION, "group_no", "pos", "frames", "f.*", "last_ts")
    )
    start, end = collapse_backwards(F.coalesce("prev_ts", "own_ts"), F.col("last_ts"))
    return out.withColumns({"start_ts": start, "end_ts": end}).drop("prev_ts", "own_ts", "last_ts")


def parts(frames: DataFrame, grouped: DataFrame) -> DataFrame:
    """Message parts: one row per part with the call it belongs to, as input or output."""
    placed = frames.select(*SESSION, "pos", "frame").join(grouped.select(*SESSION, "pos", "role", "call_id", "group_no"), [*SESSION, "pos"])
    exploded = placed.select(
        *SESSION,
        (F.col("group_no") + F.when(F.col("role") == "user", 1).otherwise(0)).alias("group_no"),
        F.when(F.col("role") == "user", "input").otherwise("output").alias("side"),
        "call_id",
        "pos",
        F.posexplode(content_parts(child(F.col("frame"), "message", "content"))).alias("part_no", "part"),
    )
    return exploded.select(*SESSION, "group_no", "side", "call_id", "pos", "part_no", "part.*")


def tool_mentions(parts_: DataFrame) -> DataFrame:
    """Tool ids named in a call's output."""
    return parts_.where("side = 'output' and type = 'tool_call' and id <> ''").select(
        *SESSION, "call_id", "pos", F.col("id").alias("tool_use_id")
    )


def input_roles(parts_: DataFrame) -> DataFrame:
    """``tool`` when the last user frame before the call returned tool results, else ``user``."""
    last = parts_.where("side = 'input'").groupBy(*SESSION, "group_no", "pos").agg(
        F.max(F.col("type") == "tool_call_response").alias("tool")
    )
    return last.groupBy(*SESSION, "group_no").agg(
        F.when(F.max_by("tool", "pos"), "tool").otherwise("user").alias("input_role")
    )


def fallback_output(parts_: DataFrame) -> DataFrame:
    """Last output text of a session's calls."""
    at = F.struct("pos", "part_no")
    return parts_.where("side = 'output' and type = 'text'").groupBy(*SESSION).agg(F.max_by("content", at).alias("output_message"))


def first_input(parts_: DataFrame) -> DataFrame:
    """First input text of the first call."""
    at = F.struct("pos", "part_no")
    return parts_.where("side = 'input' and group_no = 1 and type = 'text'").groupBy(*SESSION).agg(
        F.min_by("content", at).alias("input_message")
    )
