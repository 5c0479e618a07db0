"""The given star-schema tables read as agent-trace tables.

Each view is a narrow, row-wise projection of one parquet table, so filters and
column pruning still reach the scan.  ``SQL`` holds the same projections for a SQL
engine that checks the results.  Timestamps in these files are zone-less UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


STREAM = "stream:"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a folder name that starts with ``stream:`` gives it as a stream."""
    if not sf_dir.startswith(STREAM):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    folder = sf_dir.removeprefix(STREAM)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many tasks as there are cores, if files give fewer: for views that make much of a small row.

    A row group is never read by more than one task, and what that task makes of it stays with it, also in tables that end a lineage.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores)


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: an order is a session, a line number a call, repeats are revisions."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "element_at(array('claude','codex','copilot','cursor'), cast(l_orderkey % 4 + 1 as int)) as platform",
        "cast(l_orderkey as string) as session_id",
        "l_partkey * 100000 + cast(floor(l_extendedprice * 100) as bigint) % 100000 as pos",
        "cast(l_linenumber as string) as call_id",
        "l_shipdate as ts",
        "case l_returnflag when 'A' then 'anthropic' when 'N' then 'openai' else 'unknown' end as provider_name",
        "concat(l_returnflag, '-', l_linestatus) as response_model",
        "'chat' as operation_name",
        "cast(floor(l_quantity) as bigint) * 100 as input_tokens",
        "cast(floor(l_extendedprice) as bigint) as output_tokens",
        "case when l_discount = 0 then null else cast(floor(floor(l_quantity) * 100 * l_discount) as bigint) end"
        " as cache_read_input_tokens",
        "case when l_tax = 0 then null else cast(floor(floor(l_quantity) * 100 * l_tax) as bigint) end"
        " as cache_creation_input_tokens",
        "cast(null as bigint) as reasoning_output_tokens",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a session, the event id its (sparse) seq."""
    base = table(spark, sf_dir, "events").selectExpr(
        "element_at(array('claude','codex','copilot','cursor'), cast(user_id % 4 + 1 as int)) as platform",
        "cast(user_id as string) as session_id",
        "event_id as seq",
        "ts",
        "case event_type when 'view' then 'user_message' when 'purchase' then 'assistant_message'"
        " when 'click' then 'tool_call' when 'error' then 'tool_result' else 'permission_request' end as t",
        "cast(get_json_object(props, '$.k') as bigint) as k",
        "cast(floor(value) as bigint) as v",
    )
    tool = "element_at(array('Bash','Read','Grep','Edit','Skill','TodoWrite'), cast(k % 6 + 1 as int))"
    command = "element_at(array('rg foo','find .','git status','pytest -q','python run.py'), cast(v % 5 + 1 as int))"
    return base.selectExpr(
        "platform",
        "session_id",
        "seq",
        "ts",
        "t",
        "k",
        "v",
        "cast(k as string) as tool_use_id",
        f"{tool} as tool_name",
        f"{command} as command",
        "concat('/src/f', cast(v % 7 as string)) as file_path",
        "case when k % 3 = 0 then v end as read_limit",
        "t = 'tool_result' and v % 4 = 0 as is_error",
        "to_variant_object(named_struct('tool_use_id', cast(k as string), 'tool_name', " + tool + ","
        " 'value', v)) as data",
        "concat('{\"t\":\"', t, '\",\"seq\":', cast(seq as string), ',\"data\":{\"tool_name\":\"', " + tool + ","
        " '\",\"value\":', cast(v as string), '}}') as event_text",
    )


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: a conversation is a session, its turn number the seq."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "element_at(array('claude','codex','copilot','cursor'), cast(conv_id % 4 + 1 as int)) as platform",
        "concat('c', cast(conv_id as string)) as session_id",
        "turn as seq",
        "case role when 'user' then 'user_message' when 'assistant' then 'assistant_message'"
        " else 'notification' end as t",
        "text",
        "text as event_text",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "source as platform", "cast(doc_id as string) as session_id", "doc_id as seq", "'user_message' as t",
        "text as event_text",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of the ``events`` view, one row per user."""
    return (
        events(spark, sf_dir)
        .groupBy("platform", "session_id")
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("event_count"),
            F.max("seq").alias("last_seq"),
        )
        .selectExpr(
            "platform",
            "session_id",
            "concat('/p/.workbench/x/task-', cast(cast(session_id as bigint) % 7 as string)) as cwd",
            "started_at",
            "case when cast(session_id as bigint) % 3 = 0 then last_seen end as ended_at",
            "case cast(session_id as bigint) % 3 when 0 then 'closed' when 1 then 'open' else 'stale' end as status",
            "event_count",
            "last_seq",
            "case when cast(session_id as bigint) % 5 = 0 then null else last_seen end as last_ts",
        )
    )


def tag_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an add / remove log over 20 anchors and 5 tags per session."""
    return table(spark, sf_dir, "events").selectExpr(
        "element_at(array('claude','codex','copilot','cursor'), cast(user_id % 4 + 1 as int)) as platform",
        "cast(user_id as string) as session_id",
        "event_id as pos",
        "event_id % 20 as seq",
        "concat('tag-', cast(cast(floor(value) as bigint) % 5 as string)) as tag",
        "case event_type when 'click' then 'add' when 'view' then 'add' when 'error' then 'remove' else 'noop' end as op",
        "event_type as source",
        "ts as at",
    )


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a customer is a session, an order a result, its priority the rubric."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "element_at(array('claude','codex','copilot','cursor'), cast(o_custkey % 4 + 1 as int)) as platform",
        "cast(o_custkey as string) as session_id",
        "o_orderpriority as definition",
        "concat('judge-', cast(o_orderkey % 3 as string)) as agent",
        "o_orderdate as started_at",
        "o_orderkey as pos",
        "case o_orderstatus when 'F' then 'fail' when 'O' then 'pass' else 'warn' end as verdict",
        "map('overall', cast(o_orderkey % 100 as double), concat('s', cast(o_orderkey % 3 as string)),"
        " cast(o_orderkey % 10 as double)) as scores",
        "array(named_struct('seq', case when o_orderkey % 4 = 0 then null else o_orderkey % 8 end,"
        " 'severity', element_at(array('info','warn','error'), cast(o_orderkey % 3 + 1 as int)),"
        " 'category', concat('cat-', cast(o_orderkey % 5 as string)), 'note', cast(o_orderkey as string)),"
        " named_struct('seq', o_orderkey % 5, 'severity', 'info',"
        " 'category', concat('cat-', cast(o_orderkey % 7 as string)), 'note', 'second')) as findings",
    )


SQL = {
    "usage_raw": """SELECT CASE l_orderkey % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'copilot' ELSE 'cursor' END AS platform,
        CAST(l_orderkey AS VARCHAR) AS session_id, l_partkey * 100000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000 AS pos,
        CAST(l_linenumber AS VARCHAR) AS call_id, l_shipdate AS ts,
        CASE l_returnflag WHEN 'A' THEN 'anthropic' WHEN 'N' THEN 'openai' ELSE 'unknown' END AS provider_name,
        l_returnflag || '-' || l_linestatus AS response_model,
        CAST(floor(l_quantity) AS BIGINT) * 100 AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens,
        CASE WHEN l_discount = 0 THEN NULL ELSE CAST(floor(floor(l_quantity) * 100 * l_discount) AS BIGINT) END AS cache_read_input_tokens,
        CASE WHEN l_tax = 0 THEN NULL ELSE CAST(floor(floor(l_quantity) * 100 * l_tax) AS BIGINT) END AS cache_creation_input_tokens
        FROM lineitem""",
    "usage_calls": """SELECT * FROM usage_raw QUALIFY row_number() OVER (PARTITION BY platform, session_id, call_id ORDER BY pos DESC) = 1""",
    "ev": """SELECT platform, session_id, seq, ts, t, k, v, CAST(k AS VARCHAR) AS tool_use_id,
        CASE k % 6 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'Grep' WHEN 3 THEN 'Edit' WHEN 4 THEN 'Skill' ELSE 'TodoWrite' END AS tool_name,
        CASE v % 5 WHEN 0 THEN 'rg foo' WHEN 1 THEN 'find .' WHEN 2 THEN 'git status' WHEN 3 THEN 'pytest -q' ELSE 'python run.py' END AS command,
        '/src/f' || CAST(v % 7 AS VARCHAR) AS file_path, CASE WHEN k % 3 = 0 THEN v END AS read_limit,
        (t = 'tool_result' AND v % 4 = 0) AS is_error,
        '{"t":"' || t || '","seq":' || CAST(seq AS VARCHAR) || ',"data":{"tool_name":"' ||
        CASE k % 6 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'Grep' WHEN 3 THEN 'Edit' WHEN 4 THEN 'Skill' ELSE 'TodoWrite' END
        || '","value":' || CAST(v AS VARCHAR) || '}}' AS event_text
        FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'copilot' ELSE 'cursor' END AS platform,
            CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, ts,
            CASE event_type WHEN 'view' THEN 'user_message' WHEN 'purchase' THEN 'assistant_message' WHEN 'click' THEN 'tool_call'
            WHEN 'error' THEN 'tool_result' ELSE 'permission_request' END AS t,
            CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events)""",
    "chat": """SELECT CASE conv_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'copilot' ELSE 'cursor' END AS platform,
        'c' || CAST(conv_id AS VARCHAR) AS session_id, turn AS seq,
        CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'notification' END AS t,
        text, text AS event_text FROM conversations""",
    "sessions": """SELECT platform, session_id, '/p/.workbench/x/task-' || CAST(CAST(session_id AS BIGINT) % 7 AS VARCHAR) AS cwd, min(ts) AS started_at,
        CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN max(ts) END AS ended_at,
        CASE CAST(session_id AS BIGINT) % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'stale' END AS status,
        count(*) AS event_count, max(seq) AS last_seq,
        CASE WHEN CAST(session_id AS BIGINT) % 5 = 0 THEN NULL ELSE max(ts) END AS last_ts
        FROM ev GROUP BY platform, session_id""",
    "tag_ops": """SELECT CASE user_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'copilot' ELSE 'cursor' END AS platform,
        CAST(user_id AS VARCHAR) AS session_id, event_id AS pos, event_id % 20 AS seq,
        'tag-' || CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS tag,
        CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'noop' END AS op FROM events""",
    "live_tags": """SELECT platform, session_id, seq, tag FROM (SELECT *, row_number() OVER (PARTITION BY platform, session_id, seq, tag
        ORDER BY pos DESC) AS rn FROM tag_ops WHERE op IN ('add', 'remove')) WHERE rn = 1 AND op = 'add'""",
    "evals": """SELECT CAST(o_orderkey AS VARCHAR) AS id,
        CASE o_custkey % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'copilot' ELSE 'cursor' END AS platform,
        CAST(o_custkey AS VARCHAR) AS session_id, o_orderpriority AS definition, 'judge-' || CAST(o_orderkey % 3 AS VARCHAR) AS agent,
        o_orderdate AS started_at, o_orderkey AS pos,
        CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'warn' END AS verdict FROM orders""",
    "findings": """SELECT id, platform, session_id, definition, CASE WHEN pos % 4 = 0 THEN NULL ELSE pos % 8 END AS seq,
        CASE pos % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' ELSE 'error' END AS severity, 'cat-' || CAST(pos % 5 AS VARCHAR) AS category FROM evals
        UNION ALL SELECT id, platform, session_id, definition, pos % 5, 'info', 'cat-' || CAST(pos % 7 AS VARCHAR) FROM evals""",
}

_NEEDS = {"usage_calls": ["usage_raw"], "sessions": ["ev"], "live_tags": ["tag_ops"], "findings": ["evals"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named views (and what they need) as CTEs."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered)
    head = "WITH RECURSIVE " if body.lstrip().startswith("RECURSIVE ") else "WITH "
    body = body.lstrip().removeprefix("RECURSIVE ")
    joiner = ", " if body.lstrip().startswith("+") else "\n"
    return head + ctes + joiner + body.lstrip().removeprefix("+")
