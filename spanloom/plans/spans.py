"""The flat span table: session, turn, model call, tool, permission, accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import agent_name, span_key
from spanloom.functions.payload import SPAN_ARGUMENT_KEYS, SPAN_RESULT_KEYS
from spanloom.session import cut_lineage

SESSION = ["platform", "session_id"]
SPAN_COLUMNS = [*SESSION, "trace_id", "span_id", "parent_span_id", "kind", "name", "start_ts", "end_ts", "attributes"]


def make_id(key: Column, size: int = 16) -> Column:
    """Span id from its key with a JVM hash; ``functions.ids.span_id`` gives the blake2b form."""
    return F.substring(F.sha2(key, 256), 1, size)


def attributes(**values: Column) -> Column:
    """Attribute map without NULL entries; names use dots for double underscores."""
    cells = [p for k, v in values.items() for p in (F.lit(k.replace("__", ".")), v.cast("string"))]
    return F.map_filter(F.create_map(*cells), lambda _k, v: v.isNotNull())


def flatten(data: Column, *keys: str) -> Column:
    """Payload entries as texts: primitives as they are, nested values as JSON, NULLs dropped."""
    entries = F.coalesce(F.try_variant_get(data, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    if keys:
        entries = F.map_filter(entries, lambda k, _v: k.isin(*keys))
    texts = F.transform_values(entries, lambda _k, v: F.coalesce(v.try_cast("string"), F.to_json(v)))
    return F.map_filter(texts, lambda _k, v: v.isNotNull() & (v != "null"))


def schema_hint(data: Column, *keys: str) -> Column:
    """Names of nested entries with ``object`` or ``array``, so readers can decode them."""
    entries = F.coalesce(F.try_variant_get(data, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    if keys:
        entries = F.map_filter(entries, lambda k, _v: k.isin(*keys))
    kinds = F.transform_values(entries, lambda _k, v: F.regexp_extract(F.schema_of_variant(v), "^(OBJECT|ARRAY)", 1))
    return F.map_filter(F.transform_values(kinds, lambda _k, v: F.lower(v)), lambda _k, v: v != "")


def move_semantic(attrs: Column) -> Column:
    """Tool attributes with the first argument and result spelling moved to their semantic keys."""

    def found(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit("")) != "", F.lit(k)) for k in keys])

    def moved(out: Column, target: str, keys: tuple[str, ...]) -> Column:
        source = F.when(F.try_element_at(attrs, F.lit(target)).isNull(), found(keys))
        value = F.map_from_arrays(F.array(F.lit(target)), F.array(F.try_element_at(attrs, source)))
        rest = F.map_filter(out, lambda k, _v: ~F.coalesce(k == source, F.lit(False)))
        return F.when(source.isNotNull(), F.map_concat(rest, value)).otherwise(out)

    return moved(moved(attrs, "gen_ai.tool.call.arguments", SPAN_ARGUMENT_KEYS), "gen_ai.tool.call.result", SPAN_RESULT_KEYS)


def _span(df: DataFrame, kind: str, key: Column, parent: Column, name: Column, attrs: Column) -> DataFrame:
    trace = make_id(F.concat_ws("/", *SESSION), 32)
    return df.select(
        *SESSION, trace.alias("trace_id"), make_id(key).alias("span_id"), make_id(parent).alias("parent_span_id"), F.lit(kind).alias("kind"), name.alias("name"),
        F.col("start_ts").cast("string").alias("start_ts"), F.col("end_ts").cast("string").alias("end_ts"), attrs.alias("attributes"),
    )


def key(kind: str, ident: str) -> Column:
    return span_key(F.col("platform"), F.col("session_id"), kind, F.col(ident))


def session_key() -> Column:
    return span_key(F.col("platform"), F.col("session_id"), "root")


def flatten_spans(
    turns: DataFrame,
    calls: DataFrame,
    tools: DataFrame | None = None,
    *,
    permissions: DataFrame | None = None,
    accounting: DataFrame | None = None,
    interactions: DataFrame | None = None,
) -> DataFrame:
    """Union of the selects of each span kind.

    ``turns``: turn_id, parent_turn_id, start_ts, end_ts, status, model.  ``calls``: call_id, turn_id, model, times and
    token columns.  ``tools``: tool_call_id, name, call_id or NULL, turn_id, times.  Accounting replaces the usage of the call
    it names; without a known call it becomes a row under its turn, or under the session.
    """
    whole = turns.groupBy(*SESSION).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    parts = [_span(whole, "session", session_key(), F.lit(None).cast("string"), F.lit("session"), attributes(session__id=F.col("session_id")))]
    above = F.when(F.col("parent_turn_id").isNull(), session_key()).otherwise(key("turn", "parent_turn_id"))
    turn_attrs = attributes(turn__id=F.col("turn_id"), status=F.col("status"), gen_ai__agent__name=agent_name(F.col("platform"), F.col("model")))
    parts.append(_span(turns, "turn", key("turn", "turn_id"), above, F.lit("invoke_agent"), turn_attrs))
    if accounting is not None:
        # Read three times below.
        accounting = cut_lineage(accounting)
        own = accounting.where("call_id is not null").join(calls.select(*SESSION, "call_id"), [*SESSION, "call_id"], "left_semi")
        named = own.select(*SESSION, "call_id", F.col("accounting_id"), F.col("input_tokens").alias("a_in"), F.col("output_tokens").alias("a_out"))
        calls = calls.join(named, [*SESSION, "call_id"], "left").withColumns(
            {
                "input_tokens": F.when(F.col("accounting_id").isNotNull(), F.col("a_in")).otherwise(F.col("input_tokens")),
                "output_tokens": F.when(F.col("accounting_id").isNotNull(), F.col("a_out")).otherwise(F.col("output_tokens")),
            }
        )
        free = accounting.join(own.select(*SESSION, "accounting_id"), [*SESSION, "accounting_id"], "left_anti")
        up = F.when(F.col("turn_id").isNull(), session_key()).otherwise(key("turn", "turn_id"))
        ident = F.concat_ws(":", F.lit("accounting"), F.coalesce("turn_id", F.lit("session")), "accounting_id")
        free = free.withColumn("__ident", ident)
        acc_attrs = attributes(accounting__id=F.col("accounting_id"), accounting__status=F.col("status"), gen_ai__usage__input_tokens=F.col("input_tokens"), gen_ai__usage__output_tokens=F.col("output_tokens"))
        free = free.withColumns({"start_ts": F.col("ts"), "end_ts": F.col("ts")})
        parts.append(_span(free, "accounting", key("call", "__ident"), up, F.lit("accounting"), acc_attrs))
    call_attrs = attributes(
        gen_ai__response__model=F.col("model"), gen_ai__usage__input_tokens=F.col("input_tokens"), gen_ai__usage__output_tokens=F.col("output_tokens")
    )
    parts.append(_span(calls, "chat", key("call", "call_id"), key("turn", "turn_id"), F.concat_ws(" ", F.lit("chat"), "model"), call_attrs))
    if tools is not None:
        over = F.when(F.col("call_id").isNull(), key("turn", "turn_id")).otherwise(key("call", "call_id"))
        tool_attrs = attributes(gen_ai__operation__name=F.lit("execute_tool"), gen_ai__tool__name=F.col("name"), gen_ai__tool__call__id=F.col("tool_call_id"))
        if "attributes" in tools.columns:
            tool_attrs = F.map_concat(tool_attrs, F.map_filter(move_semantic(F.col("attributes")), lambda k, _v: ~k.isin("gen_ai.operation.name", "gen_ai.tool.name", "gen_ai.tool.call.id")))
        parts.append(_span(tools, "tool", key("tool", "tool_call_id"), over, F.concat_ws(" ", F.lit("execute_tool"), "name"), tool_attrs))
    if permissions is not None:
        p = permissions.withColumns({"start_ts": F.col("ts"), "end_ts": F.col("ts")})
        parts.append(_span(p, "permission", key("permission", "seq"), key("turn", "turn_id"), F.lit("permission"), attributes(tool__name=F.col("tool_name"), decision=F.col("decision"))))
    if interactions is not None:
        i = interactions.withColumns({"start_ts": F.col("ts"), "end_ts": F.col("ts")})
        parts.append(_span(i, "interaction", key("interaction", "interaction_id"), key("turn", "turn_id"), F.col("role"), attributes(content=F.col("content"), duplicates=F.col("duplicates"))))
    return reduce(DataFrame.unionByName, parts)


def write_spans(spans: DataFrame, path: str) -> None:
    """Spans as Parquet partitioned by platform."""
    spans.write.mode("append").partitionBy("platform").parquet(path)


def placements(ledger: DataFrame, accounting: DataFrame) -> DataFrame:
    """First destination of each accounting id against what is asked for now.

    ``new``: not in the ledger.  ``same``: same digest, nothing to do.  ``moved``: changed before
    delivery.  ``conflict``: changed after delivery; the first destination stays.
    """
    first = ledger.groupBy(*SESSION, "accounting_id").agg(F.min_by(F.struct("destination", "digest", "delivered"), "at").alias("was"))
    now = accounting.join(first, [*SESSION, "accounting_id"], "left")
    same = (F.col("was.digest") == F.col("digest")) & (F.col("was.destination") == F.col("destination"))
    action = F.when(F.col("was").isNull(), "new").when(same, "same").when(F.col("was.delivered"), "conflict").otherwise("moved")
    kept = F.when(F.col("was.delivered"), F.col("was.destination")).otherwise(F.col("destination"))
    return now.select(*SESSION, "accounting_id", action.alias("action"), kept.alias("destination"), "digest")


def export_eligible(turns: DataFrame, boundary: DataFrame, *, include_history: bool = False) -> DataFrame:
    """Turns that may be exported: those the first activation did not find finished already."""
    return turns if include_history else turns.join(boundary.select(*SESSION, "turn_id"), [*SESSION, "turn_id"], "left_anti")


def history_boundary(turns: DataFrame) -> DataFrame:
    """Turns already terminal when export was first switched on."""
    return turns.where(F.col("status").isin("completed", "errored", "interrupted")).select(*SESSION, "turn_id")
