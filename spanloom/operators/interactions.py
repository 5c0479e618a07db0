"""Ordered interactions of a session: reasoning deduplicated, messages projected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import CHUNK_ROWS, scan
from spanloom.functions.payload import (
    ARGUMENT_KEYS,
    CALL_ID_KEYS,
    GENERATION_KEYS,
    RESULT_KEYS,
    TOOL_NAME_KEYS,
    child,
    first_key,
    get,
)

SESSION = ["platform", "session_id"]
# Interaction kind of each event type, payload keys that do not tell copies apart, text spellings.
KINDS = {
    "user_message": "user_message",
    "assistant_message": "assistant_message",
    "assistant_thought": "reasoning",
    "tool_call": "tool_call",
    "tool_result": "tool_result",
    "subagent_start": "lifecycle",
    "subagent_message": "lifecycle",
    "turn_stop": "lifecycle",
}
IGNORED_KEYS = ("model", "model_id", "model_params", "speed", "fast")
USER_TEXT_KEYS = ("prompt", "input", "text")
ASSISTANT_TEXT_KEYS = ("text", "response", "output")


def interactions(events: DataFrame) -> DataFrame:
    """Events of known kinds with generation, correlation and a stable id."""
    data = F.col("data")
    kind = F.coalesce(*[F.when(F.col("t") == t, k) for t, k in KINDS.items()])
    correlation = F.coalesce(first_key(data, *CALL_ID_KEYS, "subagent_id", "subagentId"), F.lit(""))
    out = events.withColumns(
        {"kind": kind, "generation": first_key(data, *GENERATION_KEYS), "correlation": correlation}
    ).where("kind is not null and generation is not null")
    ident = F.concat_ws(
        ":", "generation", "kind", F.when(F.col("correlation") == "", "-").otherwise(F.col("correlation")), F.col("seq").cast("string")
    )
    return out.withColumn("interaction_id", ident)


def comparable_payload(data: Column) -> Column:
    """Digest of the payload without model and speed fields, entries in key order."""
    entries = F.coalesce(F.try_variant_get(data, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(entries, lambda k, _v: ~k.isin(*IGNORED_KEYS))
    cells = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("\x1f", e["key"], F.to_json(e["value"]))))
    return F.sha2(F.array_join(cells, "\x1e"), 256)


def dedup_reasoning(rows: DataFrame) -> DataFrame:
    """Reasoning copies folded onto their first seq, with the number of copies; other kinds untouched.

    Copies are grouped by digest, so nothing wider than a hash is shuffled for them.
    """
    key = [*SESSION, "generation", "correlation", "ts", "digest"]
    thought = F.col("kind") == "reasoning"
    copies = rows.where(thought).withColumn("digest", comparable_payload(F.col("data")))
    first = copies.groupBy(*key).agg(F.min("seq").alias("seq"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    kept = rows.where(thought).join(first.select(*SESSION, "seq", "duplicates"), [*SESSION, "seq"])
    return rows.where(~thought).withColumn("duplicates", F.lit(0).cast("bigint")).unionByName(kept)


def duplicate_seqs(rows: DataFrame) -> DataFrame:
    """(first seq, copy seq) of every reasoning copy."""
    key = [*SESSION, "generation", "correlation", "ts", "digest"]
    copies = rows.where("kind = 'reasoning'").withColumn("digest", comparable_payload(F.col("data"))).select(*key, "seq")
    first = copies.groupBy(*key).agg(F.min("seq").alias("first_seq"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return copies.alias("a").join(first.alias("b"), same).where("seq > first_seq").select(
        *[F.col(f"a.{c}") for c in SESSION], "first_seq", F.col("seq").alias("copy_seq")
    )


def _present(data: Column, keys: tuple[str, ...]) -> Column:
    """The sole present key's value as JSON, an object of several, NULL when none is there."""
    cells = F.array(*[F.when(child(data, k).isNotNull(), F.struct(F.lit(k).alias("k"), F.to_json(child(data, k)).alias("v"))) for k in keys])
    found = F.filter(cells, lambda x: x.isNotNull())
    several = F.concat(
        F.lit("{"), F.array_join(F.transform(found, lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), x["v"])), ","), F.lit("}")
    )
    return F.when(F.size(found) == 1, F.element_at(found, 1)["v"]).when(F.size(found) > 1, several)


def _first_text(data: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[get(data, k) for k in keys])


def messages(rows: DataFrame) -> DataFrame:
    """Role and part of each interaction that says something; lifecycle rows have none."""
    data, kind = F.col("data"), F.col("kind")
    tool = kind.isin("tool_call", "tool_result")
    role = F.when(kind == "user_message", "user").when(kind == "tool_result", "tool").otherwise("assistant")
    part = F.when(kind == "tool_call", "tool_call").when(kind == "tool_result", "tool_call_response").otherwise("text")
    text = F.when(kind == "user_message", _first_text(data, USER_TEXT_KEYS)).when(~tool, _first_text(data, ASSISTANT_TEXT_KEYS))
    name = F.when(kind == "tool_call", _first_text(data, TOOL_NAME_KEYS))
    body = F.when(kind == "tool_call", _present(data, ARGUMENT_KEYS)).when(kind == "tool_result", _present(data, RESULT_KEYS)).otherwise(text)
    said = (
        (kind.isin("user_message", "assistant_message", "reasoning") & text.isNotNull())
        | ((kind == "tool_call") & (F.col("correlation") != "") & name.isNotNull())
        | ((kind == "tool_result") & (F.col("correlation") != ""))
    )
    return rows.where(said).select(
        *SESSION, "generation", "seq", "interaction_id", role.alias("role"), part.alias("part"), "correlation", name.alias("name"), body.alias("content")
    )


def resolve_generation(events: DataFrame, *, width: int = CHUNK_ROWS) -> DataFrame:
    """Generation and prompt of every stop: its own when it has a prompt and is no session id, else the latest prompt's.

    ``events`` needs t (``user_message`` or ``turn_stop``), seq and generation.
    """
    bogus = F.col("generation") == F.col("session_id")
    prompt = (F.col("t") == "user_message") & F.col("generation").isNotNull()
    usable = F.when(prompt & ~bogus, F.struct(F.col("generation").alias("g"), F.col("seq").alias("s")))
    rows = events.where(F.col("t").isin("user_message", "turn_stop")).select(*SESSION, "seq", "t", "generation")
    latest = scan(rows, SESSION, "seq", befores={"latest": usable}, width=width).where("t = 'turn_stop'")
    keyed = rows.where("generation is not null")
    own = scan(keyed, [*SESSION, "generation"], "seq", befores={"own_seq": F.when(F.col("t") == "user_message", F.col("seq"))}, width=width)
    own = own.where("t = 'turn_stop'").select(*SESSION, "seq", "own_seq")
    out = latest.join(own, [*SESSION, "seq"], "left")
    has_own = F.col("own_seq").isNotNull() & ~F.coalesce(bogus, F.lit(False))
    return out.select(
        *SESSION,
        "seq",
        F.when(has_own, F.col("generation")).otherwise(F.coalesce(F.col("latest.g"), "generation")).alias("generation"),
        F.when(has_own, F.col("own_seq")).otherwise(F.col("latest.s")).alias("prompt_seq"),
    )


def nested_task_ids(events: DataFrame) -> DataFrame:
    """Dispatch call ids that parent a child run: of child starts and of resumed dispatches."""
    starts = F.col("t") == "subagent_start"
    resumed = (F.col("t") == "tool_call") & F.coalesce(F.col("resume"), F.lit(False))
    return events.where((starts | resumed) & (F.coalesce("call_ref", F.lit("")) != "")).select(*SESSION, "call_ref").distinct()


def own_tools(tools: DataFrame, events: DataFrame) -> DataFrame:
    """Tools of a child without the calls that dispatched grandchildren."""
    return tools.join(nested_task_ids(events), [*SESSION, "call_ref"], "left_anti")
