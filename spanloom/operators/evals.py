"""Evaluation results: listing, histograms, comparison, rule-based rubrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.times import bound

SESSION = ["platform", "session_id"]
# The words a result may use.
VERDICTS = ("pass", "warn", "fail", "unknown")
SEVERITIES = ("info", "warn", "error")


def normal_verdict(verdict: Column) -> Column:
    return F.when(verdict.isin(*VERDICTS), verdict).otherwise(F.lit("unknown"))


def normal_findings(findings: Column) -> Column:
    """Findings with an unknown severity read as ``info`` and absent texts as empty."""
    return F.transform(
        F.coalesce(findings, F.array().cast("array<struct<seq:bigint,severity:string,category:string,note:string>>")),
        lambda x: F.struct(
            x["seq"].cast("bigint").alias("seq"),
            F.when(x["severity"].isin(*SEVERITIES), x["severity"]).otherwise(F.lit("info")).alias("severity"),
            F.coalesce(x["category"], F.lit("")).alias("category"),
            F.coalesce(x["note"], F.lit("")).alias("note"),
        ),
    )


def list_evals(
    evals: DataFrame,
    *,
    definition: str | None = None,
    agent: str | None = None,
    verdict: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    for name, value in (("definition", definition), ("agent", agent), ("verdict", verdict)):
        if value is not None:
            evals = evals.where(F.col(name) == value)
    if since is not None:
        evals = evals.where(F.col("started_at") >= bound(evals, "started_at", since))
    if until is not None:
        evals = evals.where(F.col("started_at") <= bound(evals, "started_at", until))
    return evals.orderBy(F.col("started_at").desc(), "id")


def evals_of_definition(sessions: DataFrame, evals: DataFrame, definition: str) -> DataFrame:
    """(session, result) pairs of one rubric, newest first."""
    picked = evals.where(F.col("definition") == definition)
    return sessions.join(picked.withColumnRenamed("started_at", "eval_started_at"), SESSION).orderBy(
        F.col("eval_started_at").desc(), "id"
    )


def find_eval(evals: DataFrame, eval_id: str) -> DataFrame:
    return evals.where(F.col("id") == eval_id)


def latest_evals(evals: DataFrame, keys: tuple[str, ...] = (*SESSION, "definition")) -> DataFrame:
    """Last recorded result of each definition in each session."""
    rest = [c for c in evals.columns if c not in keys]
    return (
        evals.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "pos").alias("r"))
        .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def explode_findings(evals: DataFrame, definition: str | None = None) -> DataFrame:
    """One row per finding; seq NULL marks a finding about the whole session."""
    if definition is not None:
        evals = evals.where(F.col("definition") == definition)
    return evals.select("id", *SESSION, "definition", F.explode("findings").alias("f")).select(
        "id", *SESSION, "definition", "f.seq", "f.severity", "f.category", "f.note"
    )


def events_with_findings(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Every event with the findings anchored to it, if any."""
    anchored = findings.where("seq is not null").withColumnRenamed("id", "eval_id")
    return events.join(anchored, [*SESSION, "seq"], "left")


def session_findings(findings: DataFrame) -> DataFrame:
    return findings.where("seq is null")


def verdict_histogram(evals: DataFrame) -> DataFrame:
    return evals.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def avg_score(evals: DataFrame, score: str = "overall") -> DataFrame:
    """Mean of one score per definition."""
    value = F.try_element_at(F.col("scores"), F.lit(score))
    return evals.groupBy("definition").agg(F.avg(value).alias("avg_score"), F.count(value).alias("n"))


def rubric_disagreement(evals: DataFrame) -> DataFrame:
    """Sessions with more than one distinct verdict, and the last verdict per definition."""
    per = evals.groupBy(*SESSION, "definition").agg(
        F.max_by("verdict", "pos").alias("verdict"), F.min("verdict").alias("lo"), F.max("verdict").alias("hi")
    )
    return (
        per.groupBy(*SESSION)
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("definition", "verdict")))).alias("verdicts"),
        )
        .where("lo <> hi")
        .drop("lo", "hi")
    )


def findings_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def score_keys(evals: DataFrame) -> DataFrame:
    """Sorted distinct score names per session."""
    names = evals.select(*SESSION, F.explode(F.map_keys("scores")).alias("key")).distinct()
    return names.groupBy(*SESSION).agg(F.sort_array(F.collect_set("key")).alias("score_keys"))


def rule_eval(
    rows: DataFrame, definition: str, *, fail: Column, warn: Column | None = None, scores: dict[str, Column] | None = None
) -> DataFrame:
    """Results of a deterministic rubric: plain conditions over one aggregate row per session."""
    verdict = F.when(fail, "fail")
    if warn is not None:
        verdict = verdict.when(warn, "warn")
    entries = [part for k, v in (scores or {}).items() for part in (F.lit(k), v.cast("double"))]
    empty = F.create_map().cast("map<string,double>")
    return rows.select(
        F.concat_ws(":", F.lit(definition), *SESSION).alias("id"),
        *SESSION,
        F.lit(definition).alias("definition"),
        F.lit("rule").alias("agent"),
        verdict.otherwise("pass").alias("verdict"),
        (F.create_map(*entries) if entries else empty).alias("scores"),
    )


def todo_rubric(rows: DataFrame) -> DataFrame:
    """Fail when the prompt asks for three steps or more and no to-do list was written."""
    prompt = F.col("prompt")
    thens = F.size(F.split(F.lower(prompt), " then ")) - 1
    steps = F.size(
        F.filter(F.split(prompt, r"\R"), lambda x: F.substring(F.trim(x), 1, 2).isin("1.", "2.", "3."))
    )
    return rule_eval(
        rows, "todo-when-multi-step", fail=(F.greatest(thens, steps) >= 3) & (F.col("todo_writes") == 0)
    )


def redundancy_rubric(rows: DataFrame, limit: float = 0.25) -> DataFrame:
    """Fail when repeated reads exceed a quarter of all tool calls, warn on any."""
    return rule_eval(
        rows,
        "redundancy",
        fail=F.col("repeat_reads") > F.col("total") * limit,
        warn=F.col("repeat_reads") > 0,
        scores={"overall": F.lit(1.0) - F.col("repeat_reads") / F.greatest(F.col("total"), F.lit(1))},
    )


def repeat_rubric(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Fail when one call is repeated with identical input often enough, warn on any repeat."""
    return rule_eval(
        rows, "identical-repeats", fail=F.col("identical_run") >= limit, warn=F.col("identical_run") > 1
    )
