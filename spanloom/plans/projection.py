"""Turns, accounting and attribution of copilot sessions as one set of tables.

``projection`` runs the whole chain: source records to normal events to turns and calls; usage
rows to revisions and accounted calls; both to attributions, pending items and diagnostics.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.payload import get
from spanloom.operators import accounting, attribution
from spanloom.plans import copilot_turns, spans
from spanloom.session import cut_lineage
from spanloom.sources import copilot

SESSION = ["platform", "session_id"]
# Severity and message of each diagnostic code, as the rules below give them out.
CODES = {
    "usage_row_id_reuse": ("error", "database row ID was reused by a different database generation; quarantined as conflict"),
    "usage_revision_conflict": ("error", "incompatible metrics for one logical call; quarantined"),
    "missing_usage_fields": ("warning", "database usage row is incomplete"),
    "unknown_provider": ("info", "database usage rows do not name a provider; UsageRow uses the unknown sentinel"),
    "checkpoint_not_additive": ("info", "checkpoint snapshot validates totals and is not a seventh call"),
    "shutdown_total_mismatch": ("warning", "per-call totals do not equal session.shutdown usage"),
    "inferred_join": ("info", "usage joined by uniquely consistent evidence"),
    "auxiliary_excluded_from_main": ("info", "title-generation model.* record classified auxiliary"),
    "open_interaction": ("info", None),
    "capability_gap": ("warning", None),
}
COUNTS = ["events", "usage", "turns", "pending", "ambiguous", "conflicting", "errors"]


def _diagnostic(df: DataFrame, code: str, subject: Column, message: Column | None = None) -> DataFrame:
    severity, text = CODES[code]
    return df.select(
        *SESSION, F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.alias("subject"), (F.lit(text) if message is None else message).alias("message"), F.col("source_id")
    )


def _named(source: str) -> Column:
    """The source id of a usage revision, from its session and parts."""
    part = F.col(source)
    return copilot.revision_id(part["source_key"], part["primary_key"], F.concat(F.lit("sha256:"), F.lower(F.hex(part["digest"]))))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def foreign_records(records: DataFrame) -> DataFrame:
    """Transcript records of another schema version, with what they name as theirs."""
    transcript = records.where((F.col("source_kind") == "transcript") & copilot.foreign_version(F.col("payload")))
    return transcript.select(*SESSION, "pos", "source_id", get(F.col("payload"), "schema_version").alias("version"))


def semantic_diagnostics(events: DataFrame, foreign: DataFrame, pending: DataFrame, pending_sources: DataFrame) -> DataFrame:
    """Diagnostics of the transcript side, one row per source record."""
    of = pending.join(pending_sources, [*SESSION, "id"])
    still_open = of.where("kind = 'open_interaction'")
    lost = of.where("reason = 'completed child interaction has no resolved parent tool call'")
    auxiliary = events.where("kind = 'auxiliary_model_call'")
    return _union([
        _diagnostic(foreign, "capability_gap", F.col("source_id"), F.lit("unknown transcript schema_version; raw payload retained")),
        _diagnostic(lost, "capability_gap", F.col("id"), F.col("reason")),
        _diagnostic(still_open, "open_interaction", F.col("id"), F.col("reason")),
        _diagnostic(auxiliary, "auxiliary_excluded_from_main", F.col("source_id")),
    ])


def accounting_diagnostics(revisions: DataFrame, current: DataFrame, records: DataFrame, totals: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Diagnostics of the accounting side, one row per source record.

    A reused row id is one subject with all its revisions as sources; so is a call whose newest
    metrics cannot be.  Rows of an unnamed provider are subjects of their own, however many a session has.
    """
    # Revisions of no such call go before equal ones are folded.
    reused = current.where("quarantine = 'usage_row_id_reuse'").select(*SESSION, "primary_key")
    reused = revisions.select(*SESSION, "primary_key", "source_id").join(reused, [*SESSION, "primary_key"], "left_semi").distinct()
    conflict = current.where("quarantine = 'usage_revision_conflict'").select(*accounting.CALL)
    conflict = accounting.revision_sources(revisions.select(*accounting.CALL, "source_id").join(conflict, accounting.CALL, "left_semi"))
    live = current.where("quarantine is null").withColumn("lacks", F.expr("row_ts is null or model is null or input_tokens is null or output_tokens is null"))
    checkpoints = records.where(get(F.col("payload"), "type") == "session.usage_checkpoint")
    # One unreadable block makes a shutdown useless as far as it goes: the session's, else its agents'.
    gaps = totals.where("not readable").groupBy(*SESSION, "source_id").agg(F.max(F.col("agent").isNull()).alias("whole"))
    gap = F.when(F.col("whole"), "session.shutdown usage cannot be used to validate accounting").otherwise("session.shutdown agentMetrics cannot be used to validate per-agent accounting")
    named = F.concat_ws(":", "source_id", "agent")
    told = F.when(F.col("agent").isNull(), CODES["shutdown_total_mismatch"][1]).otherwise("per-agent totals do not equal session.shutdown agentMetrics")
    return _union([
        _diagnostic(reused, "usage_row_id_reuse", F.col("primary_key")),
        _diagnostic(conflict, "usage_revision_conflict", F.col("logical_call_id")),
        _diagnostic(live.where("lacks"), "missing_usage_fields", F.col("logical_call_id")),
        _diagnostic(live.where("not lacks and provider is null"), "unknown_provider", F.col("logical_call_id")),
        _diagnostic(checkpoints, "checkpoint_not_additive", F.col("source_id")),
        _diagnostic(gaps, "capability_gap", F.col("source_id"), gap),
        _diagnostic(mismatches, "shutdown_total_mismatch", named, told),
    ])


class Projection(Mapping):
    """Tables by name, each made when it is first read, so a query runs the steps that its tables need and no others.

    What several tables build on is stored once, whichever asks for it first.
    """

    NAMES = (
        "events", "turns", "calls", "call_tools", "tools", "permissions", "usage", "attributions", "candidate_sets", "accounting", "pending", "pending_sources", "diagnostics",
        "diagnostic_sources", "counts",
    )

    def __init__(self, records: DataFrame, usage: DataFrame, source_key: Column, database_key: Column, generation: Column):
        self._given = records, usage
        self._keys = source_key, database_key, generation

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, name)

    def __contains__(self, name: object) -> bool:
        return name in self.NAMES

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    # --- transcript side ---
    @cached_property
    def _records(self) -> DataFrame:
        return cut_lineage(self._given[0])

    @cached_property
    def events(self) -> DataFrame:
        return copilot.normalize(self._records)

    @cached_property
    def _built(self) -> dict[str, DataFrame]:
        return copilot_turns.build(self.events, self._keys[0])

    @cached_property
    def turns(self) -> DataFrame:
        return self._built["turns"].where("complete and not lost")

    @cached_property
    def calls(self) -> DataFrame:
        return cut_lineage(self._built["calls"])

    @property
    def call_tools(self) -> DataFrame:
        return self._built["call_tools"]

    @property
    def tools(self) -> DataFrame:
        return self._built["tools"]

    @property
    def permissions(self) -> DataFrame:
        return self._built["permissions"]

    # --- accounting side ---
    @cached_property
    def _revisions(self) -> DataFrame:
        """Revisions with their digest as bytes in ``source``, from which ``_named`` makes the text of their source id where it is read."""
        snapshot = copilot.usage_snapshot(self._given[1].withColumn("source_key", self._keys[1]), F.col("source_key"), self._keys[2], "source_key").drop("source_id")
        source = F.struct("source_key", "primary_key", F.unhex(F.substring_index("content_revision", ":", -1)).alias("digest"))
        return cut_lineage(accounting.row_metrics(snapshot.withColumn("source", source).drop("content_revision", "source_key")))

    @cached_property
    def _current(self) -> DataFrame:
        return cut_lineage(accounting.current_revisions(self._revisions))

    @cached_property
    def usage(self) -> DataFrame:
        return accounting.usage_rows(self._current)

    # --- both ---
    @cached_property
    def _attributed(self) -> tuple[DataFrame, DataFrame]:
        candidates = self._current.select(
            *SESSION, "logical_call_id", "primary_key", F.col("source").alias("usage_source_id"), "turn_index", "agent_id", "parent_tool_call_id", "model", "finish_reason", "initiator"
        )
        return attribution.attributions(self.calls, self.call_tools, candidates)

    @cached_property
    def attributions(self) -> DataFrame:
        return self._attributed[0].withColumn("usage_source_id", _named("usage_source_id"))

    @property
    def candidate_sets(self) -> DataFrame:
        return self._attributed[1]

    @cached_property
    def accounting(self) -> DataFrame:
        placed = attribution.place_accounting(self.attributions, self.calls, self.turns.select(*SESSION, "turn_id"))
        counted = self.usage.select(*SESSION, F.col("call_id").alias("logical_call_id"), "ts", "response_model", "input_tokens", "output_tokens")
        return counted.join(placed, [*SESSION, "logical_call_id"])

    @cached_property
    def _foreign(self) -> DataFrame:
        return foreign_records(self._records)

    @cached_property
    def _unknown(self) -> DataFrame:
        return self._foreign.select(
            *SESSION, F.lit("missing_source_capability").alias("kind"), F.concat(F.lit("pending:unknown-version:"), "source_id").alias("id"), F.lit("unknown transcript schema_version").alias("reason"),
            F.array(F.concat(F.lit("schema_version:"), F.coalesce("version", F.lit("None")))).alias("evidence"), "source_id",
        )

    @cached_property
    def _unmatched(self) -> DataFrame:
        return self.attributions.where("status <> 'matched'").select(
            *SESSION, F.lit("unmatched_usage").alias("kind"), F.concat(F.lit("pending:usage:"), "logical_call_id").alias("id"), F.concat(F.lit("usage attribution is "), "status").alias("reason"),
            "evidence", F.col("usage_source_id").alias("source_id"),
        )

    @cached_property
    def pending(self) -> DataFrame:
        return _union([p.select(*copilot_turns.PENDING) for p in (self._built["pending"], self._unknown, self._unmatched)])

    @cached_property
    def pending_sources(self) -> DataFrame:
        return _union([p.select(*SESSION, "id", "source_id") for p in (self._built["pending_sources"], self._unknown, self._unmatched)])

    @cached_property
    def _accounting_diagnostics(self) -> DataFrame:
        totals = accounting.shutdown_totals(self._records.where(get(F.col("payload"), "type") == "session.shutdown"))
        mismatches = accounting.shutdown_mismatch(totals, accounting.accounted_metrics(self._current))
        revisions, current = (df.withColumn("source_id", _named("source")) for df in (self._revisions, self._current))
        return accounting_diagnostics(revisions, current, self._records, totals, mismatches)

    @cached_property
    def diagnostic_sources(self) -> DataFrame:
        inferred = self.attributions.where("join_kind = 'inferred'").withColumn("source_id", F.col("usage_source_id"))
        return _union([
            semantic_diagnostics(self.events, self._foreign, self.pending, self.pending_sources),
            self._accounting_diagnostics,
            _diagnostic(inferred, "inferred_join", F.col("logical_call_id")),
        ])

    @cached_property
    def diagnostics(self) -> DataFrame:
        return _subjects(self.diagnostic_sources)

    @cached_property
    def counts(self) -> DataFrame:
        status = self.attributions.select(*SESSION, "status")
        return accounting.projection_counts({
            "events": self.events, "usage": self.usage, "turns": self.turns.where("agent = ''"), "pending": self.pending, "ambiguous": status.where("status = 'ambiguous'"),
            "conflicting": status.where("status = 'conflicting'"), "errors": self.diagnostics.where("severity = 'error'"),
        })


def _subjects(sources: DataFrame) -> DataFrame:
    return sources.groupBy(*SESSION, "code", "severity", "subject").agg(F.min("message").alias("message"), F.count("*").alias("sources"))


def projection(records: DataFrame, usage: DataFrame, source_key: Column, database_key: Column, generation: Column) -> Projection:
    """All tables of the sessions in ``records`` (as for ``copilot.normalize``) and ``usage`` (as for ``copilot.usage_snapshot``).

    ``events``, ``turns`` (completed and not lost), ``calls``, ``call_tools``, ``tools``, ``permissions``, ``usage``, ``attributions``,
    ``candidate_sets`` (calls of ambiguous rows), ``accounting`` (usage rows with the turn that owns them; NULL: the
    session), ``pending``, ``pending_sources``, ``diagnostics`` (one row per code and subject), ``diagnostic_sources`` and ``counts``.
    Every table is keyed by (platform, session_id); lists that can be long are tables of their own.
    """
    return Projection(records, usage, source_key, database_key, generation)


def tool_details(tools: DataFrame, events: DataFrame) -> DataFrame:
    """Tools with an ``attributes`` map: what start and result say, nested values as JSON with a hint of their kind."""
    said = events.where("kind in ('tool_execution_start', 'tool_execution_complete', 'tool_execution_failure')").select(*SESSION, "source_id", "data")
    out = tools
    for part, keys in (("start", ("arguments",)), ("result", ("result", "success"))):
        cells = said.select(
            *SESSION, F.col("source_id").alias(f"{part}_source_id"), spans.flatten(F.col("data"), *keys).alias(f"__{part}"),
            spans.schema_hint(F.col("data"), *keys).alias(f"__{part}_kinds"),
        )
        out = out.join(cells, [*SESSION, f"{part}_source_id"], "left")
    none = F.create_map().cast("map<string,string>")
    entries = F.map_concat(*[F.coalesce(f"__{p}", none) for p in ("start", "result")])
    kinds = F.map_concat(*[F.coalesce(f"__{p}_kinds", none) for p in ("start", "result")])
    hint = F.when(F.size(kinds) > 0, F.map_from_arrays(F.array(F.lit("schema_hint")), F.array(F.to_json(kinds)))).otherwise(none)
    return out.withColumn("attributes", F.map_concat(entries, hint)).drop("__start", "__result", "__start_kinds", "__result_kinds")


def projection_spans(made: Mapping[str, DataFrame]) -> DataFrame:
    """Spans of a projection: told turns under their parents, their calls and tools, accounting in its place.

    Accounting of a matched call becomes that call's usage; other accounting is a row under its turn or its session.
    """
    turns = made["turns"].select(
        *SESSION, "turn_id", F.when(F.col("agent") != "", F.col("parent_turn_id")).alias("parent_turn_id"), "start_ts", "end_ts", "status", F.lit(None).cast("string").alias("model")
    )
    known = turns.select(*SESSION, "turn_id")
    calls = made["calls"].withColumnRenamed("stored_turn_id", "turn_id").join(known, [*SESSION, "turn_id"], "left_semi").select(
        *SESSION, "call_id", "turn_id", "model", "start_ts", "end_ts", F.lit(None).cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens")
    )
    # A tool that several messages asked for belongs to the last of them.
    asked = made["tools"].withColumn("call_id", F.concat(F.lit("copilot:call:"), "request_source_id")).join(calls.select(*SESSION, "call_id", "turn_id"), [*SESSION, "call_id"])
    accounting = made["accounting"].select(
        *SESSION, F.col("logical_call_id").alias("accounting_id"), "call_id", F.col("owner_turn_id").alias("turn_id"), "status", "input_tokens", "output_tokens", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")
    )
    return spans.flatten_spans(turns, calls, tool_details(asked, made["events"]), accounting=accounting)


def historical_accounting(made: Mapping[str, DataFrame], closed: DataFrame) -> DataFrame:
    """Accounting ids that are finished history when export is first switched on.

    An id counts when a told turn owns it.  Else a matched or pending one stays undecided; an ambiguous or
    conflicting one counts if its turn is told, or if its session, one of ``closed``, has ended.
    """
    known = made["turns"].select(*SESSION, F.col("turn_id").alias("stored_turn_id"), F.lit(True).alias("told"))
    owned = made["accounting"].where("owner_turn_id is not null").select(*SESSION, "logical_call_id", F.lit(True).alias("owned"))
    ended = closed.select(*SESSION).distinct().withColumn("ended", F.lit(True))
    rows = made["attributions"].join(owned, [*SESSION, "logical_call_id"], "left").join(known, [*SESSION, "stored_turn_id"], "left").join(ended, SESSION, "left")
    return rows.where("owned or (status in ('ambiguous', 'conflicting') and (told or ended))").select(*SESSION, F.col("logical_call_id").alias("accounting_id"))
