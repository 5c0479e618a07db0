"""Rollouts of the codex platform: events, usage rows, turns and model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import CHUNK_ROWS, scan
from spanloom.functions.payload import child, computed, get, is_object, text_at
from spanloom.functions.text import strip_synthetic_prefix
from spanloom.functions.times import from_unix_seconds, minus_parts, parse_ts
from spanloom.session import cut_lineage
from spanloom.sources.jsonl import complete_lines, field, json_frames

SESSION = ["platform", "session_id"]
TURN = [*SESSION, "turn_id"]

# Event type of each kind of frame.
FRAME_EVENTS = {
    ("session_meta", None): "session_start",
    ("turn_context", None): "notification",
    ("event_msg", "user_message"): "user_message",
    ("event_msg", "agent_message"): "assistant_message",
    ("event_msg", "task_started"): "notification",
    ("event_msg", "task_complete"): "notification",
    ("event_msg", "turn_aborted"): "error",
    ("event_msg", "exec_command_end"): "tool_result",
    ("event_msg", "patch_apply_end"): "tool_result",
    ("event_msg", "mcp_tool_call_end"): "tool_result",
    ("event_msg", "web_search_end"): "tool_result",
    ("response_item", "function_call"): "tool_call",
    ("response_item", "custom_tool_call"): "tool_call",
    ("response_item", "local_shell_call"): "tool_call",
    ("response_item", "web_search_call"): "tool_call",
    ("response_item", "image_generation_call"): "tool_call",
    ("response_item", "function_call_output"): "tool_result",
    ("response_item", "custom_tool_call_output"): "tool_result",
}
REQUEST_FRAMES = ("function_call", "custom_tool_call", "local_shell_call")
OUTPUT_FRAMES = ("function_call_output", "custom_tool_call_output")


def rollout_frames(lines: DataFrame) -> DataFrame:
    """Frames of newline-terminated object lines, with byte offset."""
    return json_frames(complete_lines(lines))


def kinds(frames: DataFrame) -> DataFrame:
    return computed(frames, {"type": field("type"), "kind": text_at(F.col("frame"), "payload", "type"), "ts_text": F.coalesce(field("timestamp"), F.lit(""))})


def event_type() -> Column:
    """Event type of a frame; token counts and unknown frames have none."""
    out = None
    for (outer, inner), t in FRAME_EVENTS.items():
        test = F.col("type") == outer
        if inner is not None:
            test = test & (F.col("kind") == inner)
        out = F.when(test, t) if out is None else out.when(test, t)
    return out


def events(frames: DataFrame) -> DataFrame:
    """Events of mapped frames; the payload less its type, plus the frame's place in the file."""
    mapped = kinds(frames).withColumn("t", event_type()).where("t is not null")
    entries = F.coalesce(F.try_variant_get("frame", "$.payload", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rest = F.map_filter(entries, lambda k, _v: k != "type")
    return mapped.select(
        *SESSION, "pos", parse_ts(F.col("ts_text")).alias("ts"), "t", rest.alias("data"),
        *(["byte_offset"] if "byte_offset" in frames.columns else []),
    )


def frame_model() -> Column:
    """Model a frame names itself, at the top or in its payload."""
    return F.coalesce(
        *[text_at(F.col("frame"), *where, key) for where in ((), ("payload",)) for key in ("model", "model_name")]
    )


def usage_rows(frames: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Usage of token reports: the per-call delta, identified by the cumulative total.

    A report without a model takes the last one named before it, else ``unknown``.
    """
    last = lambda name: field("payload", "info", "last_token_usage", name, kind="bigint")
    total = field("payload", "info", "total_token_usage", "total_tokens", kind="bigint")
    rows = scan(kinds(frames).withColumn("own_model", frame_model()), SESSION, "pos", lasts={"model": F.col("own_model")}, width=width)
    rows = rows.where("type = 'event_msg' and kind = 'token_count'").where(last("total_tokens").isNotNull() & total.isNotNull())
    return rows.select(
        *SESSION,
        "pos",
        F.concat(F.lit("cum:"), total.cast("string")).alias("call_id"),
        parse_ts(F.col("ts_text")).alias("ts"),
        F.lit("openai").alias("provider_name"),
        F.coalesce("model", F.lit("unknown")).alias("response_model"),
        F.lit("chat").alias("operation_name"),
        last("input_tokens").alias("input_tokens"),
        last("output_tokens").alias("output_tokens"),
        last("cached_input_tokens").alias("cache_read_input_tokens"),
        last("cache_write_input_tokens").alias("cache_creation_input_tokens"),
        last("reasoning_output_tokens").alias("reasoning_output_tokens"),
    )


def turn_frames(frames: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Frames with the turn they belong to: from its context or start marker to the next different one."""
    marker = (F.col("type") == "turn_context") | ((F.col("type") == "event_msg") & (F.col("kind") == "task_started"))
    rows = kinds(frames).where(is_object(child(F.col("frame"), "payload")))
    named = F.when(marker, text_at(F.col("frame"), "payload", "turn_id"))
    rows = scan(rows, SESSION, "pos", lasts={"turn_id": named}, width=width)
    return cut_lineage(rows.where("turn_id is not null"))


def block_texts(content: Column) -> Column:
    blocks = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(blocks, lambda b: F.coalesce(F.nullif(get(b, "text"), F.lit("")), F.nullif(get(b, "content"), F.lit(""))))
    return F.filter(texts, lambda t: t.isNotNull())


def normal_messages(rows: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Rows with completed-item messages read as response items and doubled messages dropped.

    First repeats of an item id go.  Then, of the copies with one (role, phase, text), as
    many as there are response items with the same key go; further copies stay.
    """
    item = lambda *k: field("payload", "item", *k)
    copy = (F.col("type") == "event_msg") & (F.col("kind") == "item_completed") & item("type").isin("AgentMessage", "UserMessage")
    message = (F.col("type") == "response_item") & (F.col("kind") == "message")
    body = F.when(copy, child(F.col("frame"), "payload", "item")).when(message, child(F.col("frame"), "payload"))
    rows = rows.withColumns({"is_copy": F.coalesce(copy, F.lit(False)), "is_message": F.coalesce(message, F.lit(False)), "body": body})
    rows = rows.withColumns(
        {
            "item_id": F.when(F.col("is_copy"), F.nullif(get(F.col("body"), "id"), F.lit(""))),
            "role": F.when(F.col("is_copy"), F.when(item("type") == "AgentMessage", "assistant").otherwise("user")).when(
                F.col("is_message"), get(F.col("body"), "role")
            ),
            "phase": get(F.col("body"), "phase"),
            "texts": block_texts(child(F.col("body"), "content")),
        }
    )
    rows = rows.withColumn("text", F.when(F.col("body").isNotNull(), F.array_join("texts", "\n")))
    first = rows.where("item_id is not null").groupBy(*TURN, "item_id").agg(F.min("pos").alias("pos"))
    copies = rows.where("is_copy")
    kept = copies.where("item_id is null").unionByName(copies.join(first, [*TURN, "item_id", "pos"], "left_semi").select(*copies.columns))
    kept = kept.select(*TURN, "pos", "role", "phase", "text").withColumn("mkey", F.sha2(F.to_json(F.array(F.col("role"), F.coalesce("phase", F.lit("\x00")), F.col("text"))), 256))
    own = rows.where("is_message").groupBy(
        *TURN, F.sha2(F.to_json(F.array(F.col("role"), F.coalesce("phase", F.lit("\x00")), F.col("text"))), 256).alias("mkey")
    ).agg(F.count(F.lit(1)).alias("responses"))
    kept = scan(kept, [*TURN, "mkey"], "pos", sums={"nth": F.lit(1)}, width=width)
    kept = kept.join(own, [*TURN, "mkey"], "left").where(F.col("nth") > F.coalesce("responses", F.lit(0)))
    kept = kept.select(*TURN, "pos")
    whole = rows.where("not is_copy").unionByName(rows.where("is_copy").join(kept, [*TURN, "pos"], "left_semi").select(*rows.columns))
    return cut_lineage(whole)


def _output() -> Column:
    """Whether a row adds output to the call being built."""
    item, msg = F.col("type") == "response_item", F.col("type") == "event_msg"
    said = F.size("texts") > 0
    reply = (F.col("is_message") | F.col("is_copy")) & (F.col("role") == "assistant") & said
    summary = F.coalesce(F.size(F.try_variant_get("frame", "$.payload.summary", "array<variant>")) > 0, F.lit(False))
    return F.coalesce(
        reply
        | (msg & (F.col("kind") == "agent_message") & (F.coalesce(field("payload", "message"), F.lit("")) != ""))
        | (item & (F.col("kind") == "reasoning") & summary)
        | (item & F.col("kind").isin(*REQUEST_FRAMES, "image_generation_call"))
        | (msg & F.col("kind").isin("mcp_tool_call_end", "web_search_end")),
        F.lit(False),
    )


def call_frames(messages: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Turn rows with ``call_no``; a call closes at the first report of a new total that follows output.

    Repeated totals never close a call, and neither does a new total with no output since
    the report before it.
    """
    watermark = F.when(
        (F.col("type") == "event_msg") & (F.col("kind") == "token_count") & is_object(child(F.col("frame"), "payload", "info", "last_token_usage")),
        field("payload", "info", "total_token_usage", "total_tokens", kind="bigint"),
    )
    rows = messages.select(*TURN, "pos", watermark.alias("watermark"), _output().alias("is_output"))
    fresh = rows.where("watermark is not null").groupBy(*TURN, "watermark").agg(F.min("pos").alias("pos"), F.lit(True).alias("is_new"))
    rows = rows.join(fresh.drop("watermark"), [*TURN, "pos"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    rows = cut_lineage(scan(rows, TURN, "pos", sums={"outputs": F.when(F.col("is_output"), 1).otherwise(0)}, width=width))
    rows = scan(rows, TURN, "pos", befores={"at_last": F.when(F.col("is_new"), F.col("outputs"))}, width=width)
    closes = F.col("is_new") & (F.col("outputs") > F.coalesce("at_last", F.lit(0)))
    rows = cut_lineage(rows.select(*TURN, "pos", "is_output", closes.alias("closes")))
    rows = scan(rows, TURN, "pos", sums={"closed": F.when(F.col("closes"), 1).otherwise(0)}, width=width)
    call_no = F.when(F.col("closes"), F.col("closed") - 1).otherwise(F.col("closed"))
    placed = rows.select(*TURN, "pos", "is_output", "closes", call_no.alias("call_no"))
    return messages.join(placed, [*TURN, "pos"])


def _tool_start() -> Column:
    ts = parse_ts(F.col("ts_text"))
    secs, nanos = field("payload", "duration", "secs", kind="double"), field("payload", "duration", "nanos", kind="double")
    return F.when((F.col("kind") == "mcp_tool_call_end") & secs.isNotNull(), minus_parts(ts, secs, nanos)).otherwise(ts)


def calls(rows: DataFrame) -> DataFrame:
    """One row per model call of a turn, with the usage of the report that closed it."""
    ts = parse_ts(F.col("ts_text"))
    last = lambda name: F.max(F.when(F.col("closes"), field("payload", "info", "last_token_usage", name, kind="bigint"))).alias(name)
    per = rows.groupBy(*TURN, "call_no").agg(
        F.count_if("is_output").alias("outputs"),
        F.max_by(F.when(F.col("kind") == "mcp_tool_call_end", _tool_start()).otherwise(ts), F.when(F.col("is_output") & ts.isNotNull(), F.col("pos"))).alias("last_output_ts"),
        F.max(F.when(F.col("closes"), ts)).alias("closed_at"),
        F.min_by(ts, F.when(_is_input() & ts.isNotNull(), F.col("pos"))).alias("input_at"),
        *[last(n) for n in ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")],
    )
    per = scan(per, TURN, "call_no", befores={"prev_closed": F.col("closed_at")}).where("outputs > 0")
    start = F.when(F.col("call_no") == 0, F.col("input_at")).otherwise(F.col("prev_closed"))
    return per.withColumns(
        {
            "call_id": F.concat_ws(":", F.col("turn_id"), F.col("call_no").cast("string")),
            "start_ts": F.coalesce(start, "closed_at", "last_output_ts"),
            "end_ts": F.coalesce("last_output_ts", "closed_at"),
        }
    ).drop("prev_closed", "closed_at", "input_at", "last_output_ts")


def _is_input() -> Column:
    typed = (F.col("is_message") | F.col("is_copy")) & (F.col("role") == "user") & (strip_synthetic_prefix(F.coalesce("text", F.lit(""))) != "")
    return F.coalesce(((F.col("type") == "event_msg") & (F.col("kind") == "user_message")) | typed, F.lit(False))


def tool_spans(rows: DataFrame) -> DataFrame:
    """Tools of each call: requests joined to their outputs, self-contained ends as they are."""
    ts = parse_ts(F.col("ts_text"))
    get_ = lambda *k: field("payload", *k)
    asked = rows.where(F.col("type").eqNullSafe("response_item") & F.col("kind").isin(*REQUEST_FRAMES)).select(
        *TURN, "call_no", "pos", F.coalesce(get_("call_id"), F.lit("")).alias("tool_use_id"),
        F.coalesce(F.nullif(get_("name"), F.lit("")), F.col("kind")).alias("name"), F.coalesce(get_("arguments"), get_("input"), F.lit("")).alias("arguments"), ts.alias("start_ts"),
    )
    answered = rows.where(F.col("type").eqNullSafe("response_item") & F.col("kind").isin(*OUTPUT_FRAMES)).groupBy(*TURN, get_("call_id").alias("tool_use_id")).agg(
        F.max_by(F.struct(F.coalesce(get_("output"), F.lit("")).alias("result"), ts.alias("end_ts")), "pos").alias("r")
    )
    paired = asked.join(answered, [*TURN, "tool_use_id"], "left").select(
        *TURN, "call_no", "pos", "tool_use_id", "name", "arguments", F.coalesce("r.result", F.lit("")).alias("result"), "start_ts", F.coalesce("r.end_ts", "start_ts").alias("end_ts")
    )
    whole = rows.where(
        (F.col("kind").isin("mcp_tool_call_end", "web_search_end") & (F.col("type") == "event_msg"))
        | ((F.col("kind") == "image_generation_call") & (F.col("type") == "response_item"))
    )
    server, tool = F.coalesce(get_("invocation", "server"), F.lit("mcp")), F.coalesce(get_("invocation", "tool"), F.lit("tool"))
    name = (
        F.when(F.col("kind") == "mcp_tool_call_end", F.concat_ws(".", server, tool))
        .when(F.col("kind") == "image_generation_call", "image_generation")
        .when(get_("action", "type") == "open_page", "open_page")
        .otherwise("web_search")
    )
    return paired.unionByName(
        whole.select(
            *TURN, "call_no", "pos", F.coalesce(get_("call_id"), get_("id"), F.lit("")).alias("tool_use_id"), name.alias("name"),
            F.coalesce(get_("invocation", "arguments"), get_("query"), get_("action", "url"), get_("prompt"), get_("input"), F.lit("")).alias("arguments"),
            F.coalesce(get_("result"), get_("results"), get_("status"), F.lit("")).alias("result"), _tool_start().alias("start_ts"), ts.alias("end_ts"),
        )
    )


def turns(rows: DataFrame) -> DataFrame:
    """One row per turn: window, prompt, final output, status and model."""
    ts = parse_ts(F.col("ts_text"))
    event, pos = F.col("type") == "event_msg", F.col("pos")
    last = lambda value, test: F.max_by(value, F.when(test & value.isNotNull() & (value != ""), pos))
    started = event & (F.col("kind") == "task_started")
    done = event & (F.col("kind") == "task_complete")
    aborted = event & (F.col("kind") == "turn_aborted")
    typed = F.when(event & (F.col("kind") == "user_message"), field("payload", "message")).when(
        (F.col("is_message") | F.col("is_copy")) & (F.col("role") == "user"), strip_synthetic_prefix(F.col("text"))
    )
    said = F.when(done, field("payload", "last_agent_message")).when(
        event & (F.col("kind") == "agent_message") & ~F.coalesce(field("payload", "phase") == "commentary", F.lit(False)), field("payload", "message")
    ).when((F.col("is_message") | F.col("is_copy")) & (F.col("role") == "assistant") & (F.col("phase") == "final_answer"), F.col("text"))
    begun = F.when(started, from_unix_seconds(field("payload", "started_at", kind="double"), ts))
    ended = (
        F.when(done, from_unix_seconds(field("payload", "completed_at", kind="double"), ts))
        .when(aborted | (event & F.col("kind").isin("agent_message", "token_count")), ts)
    )
    return rows.groupBy(*TURN).agg(
        F.coalesce(F.max_by(begun, F.when(begun.isNotNull(), pos)), F.min_by(ts, F.when(ts.isNotNull(), pos))).alias("start_ts"),
        F.max_by(ended, F.when(ended.isNotNull(), pos)).alias("end_ts"),
        F.coalesce(last(typed, F.lit(True)), F.lit("")).alias("user_prompt"),
        F.coalesce(last(said, F.lit(True)), F.lit("")).alias("assistant_output"),
        F.when(F.max(aborted), "interrupted").otherwise("completed").alias("status"),
        last(field("payload", "model"), F.col("type") == "turn_context").alias("model"),
    )
