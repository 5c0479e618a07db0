"""Attributing usage rows to model calls.

Nothing here forms all pairs of a group: candidates are counted per identity and
feature class first, and usage rows meet those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import CHUNK_ROWS, number, number_by, scan, whole_keys
from spanloom.operators.lineage import resolve_roots
from spanloom.session import cut_lineage

SESSION = ["platform", "session_id"]
IDENTITY = ["agent_id", "parent_tool_call_id", "model"]
NONE = "\x00"


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Identity columns with NULL as a value of its own, so that joins treat it as equal."""
    return df.withColumns({f"k_{c}": F.coalesce(F.col(c), F.lit(NONE)) for c in columns})


KEY = [*SESSION[::-1], *[f"k_{c}" for c in IDENTITY]]


def tool_owners(call_tools: DataFrame) -> DataFrame:
    """The call that requested each tool, when exactly one did."""
    return (
        call_tools.where("tool_call_id <> ''")
        .groupBy(*SESSION, "tool_call_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("owner"))
        .where("n = 1")
        .drop("n")
    )


def root_calls(calls: DataFrame, call_tools: DataFrame) -> DataFrame:
    """Calls with the main call their parent tools lead to (``root_call``)."""
    owners = tool_owners(call_tools).withColumnsRenamed({"tool_call_id": "parent_tool_call_id", "owner": "__parent"})
    linked = calls.join(owners, [*SESSION, "parent_tool_call_id"], "left").select(*calls.columns, "__parent")
    return resolve_roots(linked, SESSION, "call_id", "__parent", F.col("agent_id").isNull(), "root_call").drop("__parent")


def interaction_order(rooted: DataFrame, whole: bool = False) -> DataFrame:
    """Main interactions by first appearance of a rooted call, with that call's stored turn."""
    mains = rooted.select(*SESSION, F.col("call_id").alias("root_call"), F.col("interaction_id").alias("interaction"), "stored_turn_id")
    seen = (
        rooted.where("root_call is not null")
        .select(*SESSION, "root_call", "pos")
        .join(mains, [*SESSION, "root_call"])
        .where("interaction is not null")
        .groupBy(*SESSION, "interaction")
        .agg(F.min("pos").alias("first_pos"), F.min_by("stored_turn_id", "pos").alias("stored_turn_id"))
    )
    return number(seen, SESSION, "first_pos", "turn_index", whole=whole)


def cycle_order(calls: DataFrame) -> DataFrame:
    """Position of each call in its (interaction, agent, parent) group by start."""
    grouped = _plain(calls, ["interaction_id", "agent_id", "parent_tool_call_id"])
    keys = [*SESSION, "k_interaction_id", "k_agent_id", "k_parent_tool_call_id"]
    start = F.coalesce(F.col("start_ts"), F.lit(""))
    return number_by(grouped, keys, F.substring(start, 1, 13), [start, F.col("call_id")], "cycle").drop(*keys[2:])


def finish_matches(has_tools: Column, has_finish: Column, reason: Column | None = None) -> Column:
    reason = F.col("finish_reason") if reason is None else reason
    return (
        F.when(reason.isNull(), True)
        .when(reason == "tool_calls", has_tools)
        .when(reason.isin("stop", "length", "content_filter"), ~has_tools & has_finish)
        .otherwise(False)
    )


def initiator_matches(cycle_first: Column, is_child: Column) -> Column:
    who = F.col("initiator")
    return (
        F.when(who.isNull(), True)
        .when(who == "user", cycle_first)
        .when(who == "sub-agent", is_child)
        .when(who == "agent", ~cycle_first & ~is_child)
        .otherwise(False)
    )


def with_tools(calls: DataFrame, call_tools: DataFrame) -> DataFrame:
    has = call_tools.select(*SESSION, "call_id").distinct().withColumn("has_tools", F.lit(True))
    return calls.join(has, [*SESSION, "call_id"], "left").withColumn("has_tools", F.coalesce("has_tools", F.lit(False)))


def direct_matches(usage_ids: DataFrame, call_ids: DataFrame) -> DataFrame:
    """Usage rows sharing a native id with calls: the call when there is one, else a conflict.

    Calls are counted per id before the join, so an id shared by many rows costs one row; of
    conflicting calls the first and the last are named.
    """
    per_id = call_ids.select(*SESSION, "native_id", "call_id").groupBy(*SESSION, "native_id").agg(
        F.min("call_id").alias("lo"), F.max("call_id").alias("hi")
    )
    met = usage_ids.join(per_id, [*SESSION, "native_id"]).groupBy(*SESSION, "logical_call_id").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    one = F.col("lo") == F.col("hi")
    return met.select(
        *SESSION, "logical_call_id", F.when(one, F.col("lo")).alias("direct_call"), F.when(one, "matched").otherwise("conflicting").alias("direct_status"),
        F.array("lo", "hi").alias("direct_calls"),
    )


def _numbered_usage(usage: DataFrame, width: int) -> DataFrame:
    """Usage rows of one identity in the order of their keys as ``k``.

    A whole-number column ``pk`` is the order itself.  Without one, ``primary_key`` is text: whole numbers come first, by
    value, then all other texts.  Buckets rise with that order: the sign-free number's length and leading digits, or a text's first characters.
    """
    if "pk" in usage.columns:
        return number(usage, KEY, "pk", "k", width=width)
    digits = F.col("primary_key").rlike("^(0|[1-9][0-9]{0,17})$")
    spread = F.when(digits, F.lpad("primary_key", 18, "0"))
    bucket = F.coalesce(F.concat(F.lit("0"), F.substring(spread, 1, 14)), F.concat(F.lit("1"), F.substring("primary_key", 1, 8)))
    return number_by(usage, KEY, bucket, [spread.asc_nulls_last(), F.col("primary_key"), F.col("logical_call_id")], "k")


def ordered_matches(calls: DataFrame, usage: DataFrame, *, width: int = CHUNK_ROWS, whole: bool = False) -> DataFrame:
    """i-th usage row with the i-th call of one (agent, parent tool, model), up to the first disagreement.

    ``whole``: no session has more than ``width`` calls, so nor has any identity pairs.
    """
    begin = calls.where("interaction_id is not null").groupBy(*SESSION, "interaction_id").agg(
        F.min(F.coalesce("start_ts", F.lit(""))).alias("begun")
    )
    own = F.coalesce("start_ts", F.lit(""))
    placed = calls.join(begin, [*SESSION, "interaction_id"], "left").withColumns(
        {
            "begun": F.coalesce("begun", own),
            "cycle_key": F.coalesce(F.lpad(F.col("native_turn_id").try_cast("bigint").cast("string"), 20, "0"), own),
        }
    )
    left = _numbered_usage(_plain(usage, IDENTITY), width)
    right = number_by(
        _plain(placed, IDENTITY), KEY, F.substring("begun", 1, 13), [F.col("begun"), F.col("cycle_key"), F.col("call_id")], "k"
    ).select(*KEY, "k", "call_id", "has_tools", "has_finish")
    agrees = finish_matches(F.col("has_tools"), F.col("has_finish"))
    pairs = left.join(right, [*KEY, "k"]).select(*KEY, "k", "logical_call_id", "call_id", agrees.alias("ok"))
    pairs = pairs if whole else cut_lineage(pairs)
    pairs = scan(pairs, KEY, "k", sums={"broken": F.when(F.col("ok"), 0).otherwise(1)}, width=width, whole=whole)
    return pairs.where("broken = 0").select(*SESSION, "logical_call_id", F.col("call_id").alias("ordered_call"))


def _agreeing(rooted: DataFrame, usage: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls by interaction and identity, and usage rows with the interaction their turn index names."""
    mains = rooted.select(*SESSION, F.col("call_id").alias("root_call"), F.col("interaction_id").alias("root_interaction"))
    calls = cycle_order(rooted).join(mains, [*SESSION, "root_call"], "left")
    calls = _plain(calls, IDENTITY).withColumns(
        {
            "interaction": F.coalesce("root_interaction", "interaction_id"),
            "first": F.col("cycle") == 0,
            "is_child": F.col("agent_id").isNotNull(),
        }
    )
    return calls, _plain(usage, IDENTITY).join(order.select(*SESSION, "turn_index", "interaction"), [*SESSION, "turn_index"])


FEATURES = ["has_tools", "has_finish", "first", "is_child"]


def _agree() -> Column:
    return finish_matches(F.col("has_tools"), F.col("has_finish")) & initiator_matches(F.col("first"), F.col("is_child"))


def inferred_candidates(rooted: DataFrame, usage: DataFrame, order: DataFrame, agreeing: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Number of calls in the usage row's interaction that agree with it, and the call when there is one."""
    calls, placed = _agreeing(rooted, usage, order) if agreeing is None else agreeing
    classes = calls.groupBy(*KEY, "interaction", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("call_id"))
    met = placed.join(classes, [*KEY, "interaction"]).where(_agree())
    return met.groupBy(*SESSION, "logical_call_id").agg(
        F.sum("n").alias("possible"), F.min("call_id").alias("possible_call")
    )


#: What a usage row's candidates depend on, beside its session.
SET = ["interaction", *[f"k_{c}" for c in IDENTITY], "finish_reason", "initiator"]


def _set_id() -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in SET])), 256)


def candidate_sets(
    rooted: DataFrame, usage: DataFrame, order: DataFrame, agreeing: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(usage row, candidate_set) and (candidate_set, call) for rows that several calls agree with.

    Rows of one interaction, identity, finish reason and initiator have the same candidates, so
    these are stored once per set: a call is in as many sets as there are finish reasons and
    initiators, however many usage rows there are.
    """
    calls, placed = _agreeing(rooted, usage, order) if agreeing is None else agreeing
    placed = placed.withColumn("candidate_set", _set_id())
    sets = placed.select(*SESSION, "candidate_set", *SET).distinct()
    members = sets.join(calls.select(*KEY, "interaction", *FEATURES, "call_id"), [*KEY, "interaction"]).where(_agree())
    return placed.select(*SESSION, "logical_call_id", "candidate_set"), members.select(*SESSION, "candidate_set", "call_id")


def _said(name: str, value: str | None = None) -> Column:
    """``name:value``, a missing value being the word None (a fixed format of the evidence)."""
    return F.concat(F.lit(f"{name}:"), F.coalesce(F.col(value or name).cast("string"), F.lit("None")))


def attribute_usage(
    calls: DataFrame, call_tools: DataFrame, usage: DataFrame, *, usage_ids: DataFrame | None = None, call_ids: DataFrame | None = None
) -> DataFrame:
    """Status, call, turn and evidence of every usage row.

    A shared native id decides first, then the ordered stream, then a unique agreeing call
    of the same interaction.  A call claimed twice makes all its claimants conflicting.  Each stage
    brings its own evidence; ``attributions`` also says which calls an ambiguous row had.
    """
    return _attribute(calls, call_tools, cut_lineage(usage), usage_ids, call_ids)[0]


def attributions(
    calls: DataFrame, call_tools: DataFrame, usage: DataFrame, *, usage_ids: DataFrame | None = None, call_ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``attribute_usage`` with ``candidate_set`` for ambiguous rows, and the calls of those sets.

    ``usage`` is read four times: cut its lineage if it isn't columns of a stored table.  The result is stored,
    as the sets are cut to those of its rows.
    """
    done, members = _attribute(calls, call_tools, usage, usage_ids, call_ids)
    done = cut_lineage(done)
    ambiguous = done.where("candidate_set is not null").select(*SESSION, "candidate_set")
    return done, members.join(ambiguous, [*SESSION, "candidate_set"], "left_semi")


def _attribute(calls: DataFrame, call_tools: DataFrame, usage: DataFrame, usage_ids: DataFrame | None, call_ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Attributions, and the candidates of every set whether its rows are ambiguous or not."""
    # Rows are sorted by the first column's leading bytes; the platform has few values, so it comes last.
    session = SESSION[::-1]
    key = [*session, "logical_call_id"]
    rooted = cut_lineage(root_calls(with_tools(calls, call_tools), call_tools))
    whole = whole_keys(rooted, SESSION)
    order = cut_lineage(interaction_order(rooted, whole))
    in_order, placed = _agreeing(rooted, usage, order)
    agreeing = cut_lineage(in_order), placed
    found = ordered_matches(rooted, usage, whole=whole).join(inferred_candidates(rooted, usage, order, agreeing), key, "full_outer")
    if usage_ids is not None and call_ids is not None:
        found = found.join(direct_matches(usage_ids, call_ids).join(usage.select(*key), key, "left_semi"), key, "full_outer")
    else:
        found = found.withColumns({"direct_call": F.lit(None).cast("string"), "direct_status": F.lit(None).cast("string"), "direct_calls": F.lit(None).cast("array<string>")})
    # Only a row whose turn index names an interaction has possible calls.
    guessed = F.when(F.col("direct_status").isNull() & F.col("ordered_call").isNull() & (F.col("possible") == 1), F.col("possible_call"))
    chosen = F.when(F.col("direct_status").isNotNull(), F.col("direct_call")).otherwise(F.coalesce("ordered_call", guessed))
    settled = F.coalesce("direct_status", F.when(F.col("ordered_call").isNotNull() | guessed.isNotNull(), "matched"))
    # Stored, as claims are counted over all rows before these are put together: what a row chose meets its calls before it meets the row, which is wide.
    found = cut_lineage(found.withColumns({"call_id": chosen, "settled": settled}).drop("possible_call", "direct_call"))
    claims = found.where("settled = 'matched'").groupBy(*SESSION, "call_id").agg(F.count(F.lit(1)).alias("claims"))
    roots = agreeing[0].select(*SESSION, "call_id", F.col("agent_id").alias("call_agent"), "cycle", F.coalesce("root_call", "call_id").alias("__r"))
    turns = rooted.select(*SESSION, F.col("call_id").alias("__r"), F.col("stored_turn_id").alias("root_turn"), F.col("interaction_id").alias("root_interaction"))
    told = roots.join(turns, [*session, "__r"], "left").drop("__r")
    found = found.join(claims, [*session, "call_id"], "left").join(told, [*session, "call_id"], "left")
    out = usage.join(found, key, "left")
    out = out.join(order.select(*SESSION, "turn_index", "interaction", F.col("stored_turn_id").alias("index_turn")), [*session, "turn_index"], "left")
    status = F.coalesce("settled", F.when(F.col("interaction").isNotNull() & (F.col("possible") > 1), "ambiguous"), F.lit("pending"))
    out = out.withColumns({"status": status, "via_turn": F.col("direct_status").isNull() & F.col("ordered_call").isNull()})
    # A row's set follows from its own columns, so the sets are not joined.
    out = _plain(out, IDENTITY).withColumn("candidate_set", _set_id())
    members = candidate_sets(rooted, usage, order, agreeing)[1]
    twice = F.coalesce(F.col("claims") > 1, F.lit(False))
    matched = F.col("status") == "matched"
    direct = F.col("direct_status").isNotNull()
    ambiguous = F.col("status") == "ambiguous"
    logical = _said("logical_call_id")
    by_index = F.when(F.col("via_turn"), F.col("interaction")).otherwise(F.col("root_interaction"))
    evidence = (
        F.when(direct & ~matched, F.concat(F.array(logical), F.transform("direct_calls", lambda c: F.concat(F.lit("call_id:"), c))))
        .when(twice, F.array(logical, _said("call_id")))
        .when(direct, F.array(F.lit("join_kind:direct"), _said("call_id")))
        .when(
            matched,
            F.array(
                F.lit("join_kind:inferred"), F.concat(F.lit("interaction_id:"), F.coalesce(by_index, F.lit("None"))), _said("turn_index"), _said("agent_id"),
                _said("parent_tool_call_id"), _said("model"), _said("finish", "finish_reason"), _said("initiator"), _said("order", "cycle"), _said("call_id"),
            ),
        )
        .when(ambiguous, F.array(_said("interaction_id", "interaction"), _said("model"), _said("turn_index")))
        .when(F.col("interaction").isNotNull(), F.array(logical, _said("interaction_id", "interaction"), _said("turn_index")))
        .otherwise(F.array(logical, _said("turn_index")))
    )
    done = out.select(
        *SESSION,
        "logical_call_id",
        "usage_source_id",
        F.when(matched & ~F.col("via_turn"), F.col("root_turn")).otherwise(F.col("index_turn")).alias("stored_turn_id"),
        F.when(matched & ~F.col("via_turn"), F.col("call_agent")).otherwise(F.col("agent_id")).alias("agent_id"),
        F.when(matched & ~twice, F.col("call_id")).alias("call_id"),
        F.when(twice, "conflicting").otherwise(F.col("status")).alias("status"),
        F.when(matched & ~twice, F.when(direct, "direct").otherwise("inferred")).alias("join_kind"),
        evidence.alias("evidence"),
        F.when(ambiguous, F.col("candidate_set")).alias("candidate_set"),
    )
    return done, members


def place_accounting(attributions: DataFrame, calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn that owns each usage row: by its call when matched, else its stored turn; NULL stays with the session."""
    of_call = calls.select(*SESSION, "call_id", F.col("stored_turn_id").alias("call_turn"))
    known = turns.select(*SESSION, "turn_id").distinct()
    placed = attributions.join(of_call, [*SESSION, "call_id"], "left").withColumn(
        "turn_id", F.when(F.col("status") == "matched", F.col("call_turn")).otherwise(F.col("stored_turn_id"))
    )
    return placed.join(known.withColumn("__known", F.lit(True)), [*SESSION, "turn_id"], "left").select(
        *attributions.columns, F.when(F.col("__known"), F.col("turn_id")).alias("owner_turn_id")
    )


def turn_evidence(turn_sources: DataFrame, turns: DataFrame, events: DataFrame) -> DataFrame:
    """Source ids of a turn: its own references and the events of its interaction or stored turn."""
    by_interaction = turns.where("interaction_id is not null").select(*SESSION, "turn_id", "interaction_id").join(
        events.select(*SESSION, "interaction_id", "source_id"), [*SESSION, "interaction_id"]
    )
    by_turn = turns.select(*SESSION, "turn_id").join(
        events.where("stored_turn_id is not null").select(*SESSION, F.col("stored_turn_id").alias("turn_id"), "source_id"), [*SESSION, "turn_id"]
    )
    cols = [*SESSION, "turn_id", "source_id"]
    return turn_sources.select(*cols).unionByName(by_interaction.select(*cols)).unionByName(by_turn.select(*cols)).distinct()


def evidence_bounds(evidence: DataFrame, archived: DataFrame) -> DataFrame:
    """First and last archived event of each turn's evidence."""
    return evidence.join(archived, [*SESSION, "source_id"]).groupBy(*SESSION, "turn_id").agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min_by("ts", "seq").alias("start_ts"), F.max_by("ts", "seq").alias("end_ts"),
        F.count(F.lit(1)).alias("events"),
    )


def root_turn_owner(turns: DataFrame) -> DataFrame:
    """Main turn of every turn, however deep it is nested."""
    return resolve_roots(turns, SESSION, "turn_id", "parent_turn_id", F.col("parent_turn_id").isNull(), "main_turn_id")
