"""Accounting of usage revisions and its check against shutdown totals."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.payload import child, get, metric_number
from spanloom.functions.times import parse_ts
from spanloom.operators.usage import newest

SESSION = ["platform", "session_id"]
CALL = [*SESSION, "logical_call_id"]
# The six accounted metrics and their names in a shutdown payload.
METRICS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "total_nano_aiu")
SHUTDOWN_KEYS = {
    "input_tokens": ("usage", "inputTokens"),
    "output_tokens": ("usage", "outputTokens"),
    "cache_read_tokens": ("usage", "cacheReadTokens"),
    "cache_write_tokens": ("usage", "cacheWriteTokens"),
    "reasoning_tokens": ("usage", "reasoningTokens"),
    "total_nano_aiu": ("totalNanoAiu",),
}


TEXTS = ("agent_id", "parent_tool_call_id", "model", "finish_reason", "initiator", "created_at", "provider", "provider_name")


def row_metrics(snapshot: DataFrame) -> DataFrame:
    """Usage revisions with typed metrics, read from the row in one pass.

    A number field takes JSON numbers only, so texts and booleans come out NULL; a metric
    is whole and not negative.  ``row_ts`` is a timestamp, NULL where the text is unreadable.
    """
    schema = ", ".join([f"{m} double" for m in (*METRICS, "turn_index")] + [f"{t} string" for t in TEXTS])
    parsed = snapshot.withColumn("__row", F.from_json("row_json", schema))
    number = lambda name: F.col(f"__row.{name}")
    metric = lambda name: F.when((number(name) >= 0) & (F.floor(number(name)) == number(name)), number(name).cast("bigint"))
    text = lambda name: F.nullif(F.col(f"__row.{name}"), F.lit(""))
    return parsed.select(
        *[c for c in snapshot.columns if c != "row_json"],
        *[metric(m).alias(m) for m in (*METRICS, "turn_index")],
        *[text(t).alias(t) for t in TEXTS[:5]],
        parse_ts(text("created_at")).alias("row_ts"),
        F.coalesce(text("provider"), text("provider_name")).alias("provider"),
    )


def _incompatible() -> Column:
    i, r, w = F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")
    return F.coalesce((r > i) | (w > i) | (r + w > i), F.lit(False)) | F.coalesce(r > i, F.lit(False)) | F.coalesce(w > i, F.lit(False))


# Columns of a current revision that ``accounted_metrics`` and ``usage_rows`` read.
ACCOUNTED = ("agent_id", *METRICS)
COUNTED = ("pos", "row_ts", "provider", "model", *METRICS)


def current_revisions(revisions: DataFrame, columns: Collection[str] | None = None) -> DataFrame:
    """Newest revision of each logical call, with the number of revisions and the quarantine reason.

    A row id seen in more than one database generation quarantines all its calls; so do
    cache counts that exceed the input.  ``columns``: those the caller reads, if not all; long ids are then not shuffled.
    """
    if columns is not None:
        columns = {*columns, "primary_key", *METRICS[:4]}
    reused = (
        revisions.groupBy(*SESSION, "primary_key")
        .agg(F.min("generation").alias("lo"), F.max("generation").alias("hi"))
        .where("lo <> hi")
        .select(*SESSION, "primary_key", F.lit(True).alias("reused"))
    )
    out = newest(revisions, CALL, columns).join(reused, [*SESSION, "primary_key"], "left")
    reason = F.when(F.col("reused"), "usage_row_id_reuse").when(_incompatible(), "usage_revision_conflict")
    return out.withColumn("quarantine", reason).drop("reused")


def revision_sources(revisions: DataFrame) -> DataFrame:
    """(call, source id) of all revisions, one row each."""
    return revisions.select(*CALL, "source_id").distinct()


def accounted_metrics(current: DataFrame) -> DataFrame:
    """Sums of the six metrics per session (``agent`` NULL) and per (session, agent or ``main``)."""
    live = current.where("quarantine is null").withColumn("agent", F.coalesce("agent_id", F.lit("main")))
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in METRICS]
    return (
        live.groupingSets([[*map(F.col, SESSION)], [*map(F.col, SESSION), F.col("agent")]], *SESSION, "agent")
        .agg(F.grouping("agent").alias("whole"), *sums, F.count(F.lit(1)).alias("calls"))
        .withColumn("whole", F.col("whole") == 1)
    )


def usage_rows(current: DataFrame) -> DataFrame:
    """Complete, unquarantined revisions in the shape of the usage table."""
    ok = current.where("quarantine is null and row_ts is not null and model is not null and input_tokens is not null and output_tokens is not null")
    return ok.select(
        *SESSION,
        F.lit(0).cast("bigint").alias("seq"),
        F.col("logical_call_id").alias("call_id"),
        F.col("row_ts").alias("ts"),
        F.coalesce("provider", F.lit("unknown")).alias("provider_name"),
        F.col("model").alias("response_model"),
        F.lit("chat").alias("operation_name"),
        "input_tokens",
        "output_tokens",
        F.col("cache_read_tokens").alias("cache_read_input_tokens"),
        F.col("cache_write_tokens").alias("cache_creation_input_tokens"),
        F.col("reasoning_tokens").alias("reasoning_output_tokens"),
        "pos",
    )


def _model_sums(models: Column) -> Column:
    """Sums over the models of one block; one missing number makes the whole block unreadable, as does none at all."""
    numbers = F.transform(F.map_values(models), lambda m: F.struct(*[metric_number(m, *path).alias(k) for k, path in SHUTDOWN_KEYS.items()]))

    def whole(row: Column) -> Column:
        out = F.lit(True)
        for k in METRICS:
            out = out & row[k].isNotNull()
        return out

    def add(sums: Column, row: Column) -> Column:
        return F.struct(
            (sums["readable"] & whole(row)).alias("readable"),
            *[F.when(row[k].isNull(), sums[k]).otherwise(F.coalesce(sums[k], F.lit(0).cast("bigint")) + row[k]).alias(k) for k in METRICS],
        )

    none = F.struct(F.lit(True).alias("readable"), *[F.lit(None).cast("bigint").alias(k) for k in METRICS])
    empty = F.struct(F.lit(False).alias("readable"), *[F.lit(None).cast("bigint").alias(k) for k in METRICS])
    return F.when(F.cardinality(models) > 0, F.aggregate(numbers, none, add)).otherwise(empty)


def shutdown_totals(shutdowns: DataFrame) -> DataFrame:
    """Totals a shutdown record states, for the session (``agent`` NULL) and per agent.

    Rows with ``readable`` false mark blocks that are missing, empty or lack a number.  A record
    states all its totals itself, so nothing is shuffled.
    """
    keys = [*SESSION, "source_id"]
    data = child(F.col("payload"), "data")
    blank = F.create_map().cast("map<string,variant>")
    block = lambda of, name: F.coalesce(F.try_variant_get(of, f"$.{name}", "map<string,variant>"), blank)
    stated = shutdowns.select(*keys, data.alias("data")).select(
        *keys,
        _model_sums(block("data", "modelMetrics")).alias("session"),
        F.transform(F.map_entries(block("data", "agentMetrics")), lambda a: F.struct(a["key"].alias("agent"), _model_sums(block(a["value"], "modelMetrics")).alias("sums"))).alias("agents"),
    )
    readable = F.col("session.readable") & F.forall("agents", lambda a: a["sums"]["readable"])
    rows = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("agent"), F.col("session.readable").alias("readable"), F.col("session").alias("sums"))),
        F.transform("agents", lambda a: F.struct(a["agent"].alias("agent"), readable.alias("readable"), a["sums"].alias("sums"))),
    )
    return stated.select(*keys, F.explode(rows).alias("t")).select(*keys, "t.agent", "t.readable", *[f"t.sums.{m}" for m in METRICS])


def shutdown_mismatch(totals: DataFrame, accounted: DataFrame) -> DataFrame:
    """Stated totals that differ from the accounted ones, metric by metric.

    Agents the shutdown does not name are not reported; agents it names without accounted
    calls compare with zero.
    """
    stated = totals.where("readable").withColumn("k", F.coalesce("agent", F.lit("\x00")))
    ours = accounted.select(
        *SESSION, F.when(F.col("whole"), F.lit("\x00")).otherwise(F.col("agent")).alias("k"), *[F.col(m).alias(f"accounted_{m}") for m in METRICS]
    )
    met = stated.join(ours, [*SESSION, "k"], "left").withColumns({f"accounted_{m}": F.coalesce(f"accounted_{m}", F.lit(0)) for m in METRICS})
    differs = F.lit(False)
    for m in METRICS:
        differs = differs | (F.col(m) != F.col(f"accounted_{m}"))
    return met.where(differs).select(
        *SESSION, "source_id", "agent", *[F.col(m).alias(f"expected_{m}") for m in METRICS], *[f"accounted_{m}" for m in METRICS]
    )


def accounting_diagnostics(current: DataFrame, totals: DataFrame, mismatches: DataFrame, records: DataFrame) -> DataFrame:
    """Diagnostic rows (code, severity, source id) of the accounting side."""

    def rows(df: DataFrame, code: Column, severity: str) -> DataFrame:
        return df.select(*SESSION, code.alias("code"), F.lit(severity).alias("severity"), "source_id")

    live = current.where("quarantine is null")
    missing = live.where("row_ts is null or model is null or input_tokens is null or output_tokens is null")
    complete = live.where("row_ts is not null and model is not null and input_tokens is not null and output_tokens is not null")
    checkpoint = records.where(get(F.col("payload"), "type") == "session.usage_checkpoint")
    out = rows(current.where("quarantine is not null"), F.col("quarantine"), "error")
    out = out.unionByName(rows(missing, F.lit("missing_usage_fields"), "warning"))
    out = out.unionByName(rows(complete.where("provider is null"), F.lit("unknown_provider"), "info"))
    out = out.unionByName(rows(checkpoint, F.lit("checkpoint_not_additive"), "info"))
    out = out.unionByName(rows(totals.where("not readable"), F.lit("capability_gap"), "warning"))
    return out.unionByName(rows(mismatches, F.lit("shutdown_total_mismatch"), "warning"))


def projection_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per session of each named table, side by side."""
    tall = None
    for name, df in parts.items():
        one = df.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        tall = one if tall is None else tall.unionByName(one)
    return tall.groupBy(*SESSION).agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("n"))), F.lit(0)).alias(n) for n in parts]
    )

