"""Cohort review: tool mix, waste signatures, errors and recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ordered import scan
from spanloom.operators.turns import runs

SESSION = ["platform", "session_id"]

# Shell command classes and task shapes, each in the order it is tried.
SHELL_CLASSES = (
    ("filesystem_explore", r"\bfind\b|\bls\b|\btree\b"),
    ("grep_via_bash", r"\brg\b|\bgrep\b"),
    ("test_run", r"\bpytest\b|\bnpm (test|run test)\b|\bvitest\b"),
    ("git", r"\bgit\b"),
)
TASK_SHAPES = (
    ("wb", r"task description|dispatch|workbench"),
    ("bug", r"fix|bug|error|fails|broken|regression"),
    ("refactor", r"refactor|rename|extract|move"),
    ("question", r"\?$|how (do|does|can)"),
    ("feature", r"add|implement|build|create"),
)


def _first_match(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    label = None
    for name, pattern in table:
        test = text.rlike(pattern)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label.otherwise("other")


def tool_calls(events: DataFrame) -> DataFrame:
    return events.where(F.col("t") == "tool_call")


def unbounded_read() -> Column:
    limit, offset = F.col("read_limit"), F.col("read_offset")
    return (F.coalesce(limit, F.lit(0)) == 0) & (F.coalesce(offset, F.lit(0)) == 0)


def _with_offset(events: DataFrame) -> DataFrame:
    return events if "read_offset" in events.columns else events.withColumn("read_offset", F.lit(None).cast("bigint"))


def tool_mix(events: DataFrame) -> DataFrame:
    """Calls per (session, tool, shell class); shell class only for shell calls."""
    calls = tool_calls(_with_offset(events))
    bucket = F.when(F.col("tool_name") == "Bash", _first_match(F.coalesce("command", F.lit("")), SHELL_CLASSES))
    return calls.groupBy(*SESSION, "tool_name", bucket.alias("shell_class")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if((F.col("tool_name") == "Read") & unbounded_read()).alias("unbounded_reads"),
    )


def re_reads(events: DataFrame) -> DataFrame:
    """Files read more than once in a session."""
    reads = tool_calls(events).where(F.col("tool_name") == "Read")
    return reads.groupBy(*SESSION, "file_path").agg(F.count(F.lit(1)).alias("reads")).where("reads > 1")


def cohort_matrix(events: DataFrame) -> DataFrame:
    """Counts per session; here the grep test comes before the file-system test."""
    cmd = F.coalesce("command", F.lit(""))
    shell = F.col("tool_name") == "Bash"
    grep, fs = cmd.rlike(SHELL_CLASSES[1][1]), cmd.rlike(SHELL_CLASSES[0][1])
    named = {n: F.count_if(F.col("tool_name") == n) for n in ("Read", "Skill", "Edit", "TodoWrite")}
    return tool_calls(events).groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("total"),
        named["Read"].alias("reads"),
        F.count_if(shell & grep).alias("bash_grep"),
        F.count_if(shell & ~grep & fs).alias("bash_fs"),
        named["Skill"].alias("skills"),
        named["Edit"].alias("edits"),
        named["TodoWrite"].alias("todos"),
    )


MATRIX = ("total", "reads", "bash_grep", "bash_fs", "skills", "edits", "todos")


def cohort_medians(matrix: DataFrame) -> DataFrame:
    return matrix.agg(*[F.median(c).alias(f"median_{c}") for c in MATRIX])


def error_events(events: DataFrame) -> DataFrame:
    return events.where((F.col("t") == "tool_result") & F.coalesce(F.col("is_error"), F.lit(False)))


def tool_errors(events: DataFrame, message: Column) -> DataFrame:
    """Errors per (tool, first 120 characters of the message), most frequent first."""
    return (
        error_events(events)
        .groupBy("tool_name", F.substring(message, 1, 120).alias("message"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "tool_name", "message")
    )


def error_runs(events: DataFrame) -> DataFrame:
    """Longest stretch of consecutive failed results per session."""
    results = events.where(F.col("t") == "tool_result").withColumn(
        "failed", F.coalesce(F.col("is_error"), F.lit(False))
    )
    return (
        runs(results, "failed")
        .groupBy(*SESSION)
        .agg(F.coalesce(F.max(F.when(F.col("failed"), F.col("length"))), F.lit(0)).alias("error_run"))
    )


def tool_runs(events: DataFrame) -> DataFrame:
    return runs(tool_calls(events), "tool_name")


def recovery_shape(events: DataFrame) -> DataFrame:
    """For each failed result, how the next three calls relate to the call that failed.

    ``retried``: same tool and arguments; ``narrowed``: same tool, other arguments; else ``different``.
    """
    rows = events.where(
        (F.col("t") == "tool_call") | ((F.col("t") == "tool_result") & F.coalesce(F.col("is_error"), F.lit(False)))
    )
    is_call = F.col("t") == "tool_call"
    call = F.when(is_call, F.struct(F.col("tool_name").alias("tool"), F.col("args").alias("args")))
    rows = scan(rows, SESSION, "seq", sums={"k": F.when(is_call, 1).otherwise(0)}, befores={"failed": call})
    calls = rows.where(is_call).select(*SESSION, "k", F.col("tool_name").alias("tool"), "args")
    fails = rows.where(~is_call).select(*SESSION, "seq", "failed", "k", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ahead"))
    met = fails.withColumn("k", F.col("k") + F.col("ahead")).join(calls, [*SESSION, "k"], "left")
    same_tool = F.col("tool") == F.col("failed.tool")
    shape = (
        F.when(F.col("tool").isNull(), "none")
        .when(same_tool & F.col("args").eqNullSafe(F.col("failed.args")), "retried")
        .when(same_tool, "narrowed")
        .otherwise("different")
    )
    return met.groupBy(*SESSION, "seq").agg(
        *[F.max(F.when(F.col("ahead") == i, shape)).alias(f"next_{i}") for i in (1, 2, 3)]
    )


def large_results(events: DataFrame, content: Column, over: int = 20_000) -> DataFrame:
    size = F.length(content)
    return events.where((F.col("t") == "tool_result") & (size > over)).withColumn("size", size)


def skill_comparison(events: DataFrame, sessions: DataFrame, at_least: int = 30) -> DataFrame:
    """Average session size with and without skill calls, for sessions of some length."""
    per = events.groupBy(*SESSION).agg(
        F.count_if((F.col("t") == "tool_call") & (F.col("tool_name") == "Skill")).alias("skills"),
        F.count_if(F.col("t") == "tool_call").alias("tools"),
    )
    sized = sessions.where(F.col("event_count") >= at_least).join(per, SESSION)
    return sized.groupBy((F.col("skills") > 0).alias("has_skill")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg("event_count").alias("avg_events"),
        F.avg("tools").alias("avg_tools"),
    )


def task_shape(events: DataFrame, text: Column) -> DataFrame:
    """Label of each session's first user text."""
    first = (
        events.where(F.col("t") == "user_message")
        .groupBy(*SESSION)
        .agg(F.min_by(text, "seq").alias("first_text"))
    )
    lowered = F.lower(F.substring(F.coalesce("first_text", F.lit("")), 1, 200))
    return first.select(*SESSION, _first_match(lowered, TASK_SHAPES).alias("shape"))


def session_profile(events: DataFrame) -> DataFrame:
    """One row per session with everything the waste rules need."""
    events = _with_offset(events)
    base = events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("t") == "tool_call").alias("tool_calls"),
        F.count_if((F.col("t") == "tool_call") & (F.col("tool_name") == "Read")).alias("reads"),
        F.count_if((F.col("t") == "tool_call") & (F.col("tool_name") == "Read") & unbounded_read()).alias("unbounded"),
    )
    matrix = cohort_matrix(events).select(*SESSION, "bash_grep", "bash_fs", "skills", "todos")
    per_file = (
        tool_calls(events)
        .where(F.col("tool_name").isin("Read", "Edit"))
        .groupBy(*SESSION, "tool_name", "file_path", F.when(F.col("tool_name") == "Edit", F.col("args")).alias("a"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*SESSION)
        .agg(
            F.max(F.when(F.col("tool_name") == "Read", F.col("n"))).alias("max_reads"),
            F.sum(F.when(F.col("tool_name") == "Read", F.col("n") - 1)).alias("repeat_reads"),
            F.max(F.when(F.col("tool_name") == "Edit", F.col("n"))).alias("max_edits"),
        )
    )
    zero = ("bash_grep", "bash_fs", "skills", "todos", "max_reads", "repeat_reads", "max_edits", "error_run")
    out = base.join(matrix, SESSION, "left").join(per_file, SESSION, "left").join(error_runs(events), SESSION, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def waste_signatures(profile: DataFrame) -> DataFrame:
    """Flags of wasteful behaviour; thresholds are the default cohort's."""
    flags = {
        "grep_via_bash": F.col("bash_grep") > 8,
        "filesystem_explore": F.col("bash_fs") > 6,
        "re_read": F.col("max_reads") >= 3,
        "unbounded_reads": F.col("unbounded") > F.col("reads") * 0.3,
        "chatty": F.col("tool_calls") > F.col("events") * 0.75,
        "identical_edits": F.col("max_edits") >= 2,
        "error_streak": F.col("error_run") >= 3,
    }
    return profile.withColumns(flags)
