"""Queries over the time, tag, environment and status expressions, on values made from whole tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from spanloom.functions import payload, text, times
from spanloom.functions.payload import ERROR_WORDS, INTERRUPTED_WORDS
from spanloom.sources import star_views as V

QUERIES: dict = {}
ORACLE: dict = {}
MILLIS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_MILLIS = "%Y-%m-%d %H:%M:%S.%f"
NOW = datetime(1998, 8, 2, 6, 30, tzinfo=UTC)


def _add(name, fn, sql):
    QUERIES[name] = fn
    ORACLE[name] = sql


def _orders(s, d):
    return V.table(s, d, "orders")


def _since(s, d):
    when = {"90d": "90d", "36h": "36h", "yesterday": "yesterday", "date": "1998-01-15", "offset": "1998-03-01T02:00:00+05:00"}
    ts = F.col("o_orderdate").cast("timestamp")
    cells = [F.sum((ts >= F.lit(times.parse_when(w, now=NOW).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")).cast("bigint")).alias(f"since_{k}") for k, w in when.items()]
    return _orders(s, d).groupBy("o_custkey").agg(*cells)


_add("orders_since", _since, """SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-05-04 06:30:00') AS BIGINT) AS since_90d, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-07-31 18:30:00') AS since_36h,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-08-01') AS since_yesterday, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-15') AS since_date,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-02-28 21:00:00') AS since_offset FROM orders GROUP BY o_custkey""")


def _written_times(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    tail = F.element_at(F.array(*(F.lit(x) for x in ("T23:30:00-05:00", "T08:15:30.250Z", "T10:00:00", " no time", "T25:61:00Z"))), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return _orders(s, d).select("o_orderkey", F.date_format(times.parse_ts(F.concat(day, tail)), MILLIS).alias("ts"), F.to_date(times.parse_ts(F.concat(day, tail))).cast("string").alias("day"))


_add("parsed_times", _written_times, f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 270 MINUTE
    WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '8 hours 15 minutes 30.25 seconds' WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 HOUR END AS ts FROM orders)
    SELECT o_orderkey, strftime(ts, '{DUCK_MILLIS}') AS ts, strftime(ts, '%Y-%m-%d') AS day FROM t""")


def _windows(s, d):
    base = F.col("o_orderdate").cast("timestamp")
    key = F.col("o_orderkey")
    later = F.when(key % 3 != 0, F.timestamp_seconds(F.unix_seconds(base) + key % 1000 - 500))
    start, end = times.ordered_window(F.when(key % 4 != 0, base), later)
    ms = F.when(key % 7 == 0, F.lit("-5")).when(key % 7 == 1, F.lit("x")).otherwise((key % 5000).cast("string"))
    ends = {
        "start": start,
        "end": end,
        "began": times.start_from_duration(base, ms),
        "before_parts": times.minus_parts(base, F.when(key % 2 == 0, key % 60), (key % 1000) * 1_000_000),
        "from_seconds": times.from_unix_seconds(F.when(key % 5 != 0, key.cast("double") + 0.5), base),
    }
    return _orders(s, d).select("o_orderkey", *(F.date_format(e, MILLIS).alias(n) for n, e in ends.items()))


_add("derived_windows", _windows, f"""WITH b AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS base FROM orders),
    s AS (SELECT *, CASE WHEN k % 4 <> 0 THEN base END AS a, CASE WHEN k % 3 <> 0 THEN base + to_seconds(k % 1000 - 500) END AS z FROM b)
    SELECT k AS o_orderkey, strftime(least(coalesce(a, z), coalesce(z, a)), '{DUCK_MILLIS}') AS start, strftime(greatest(coalesce(a, z), coalesce(z, a)), '{DUCK_MILLIS}') AS "end",
    strftime(CASE WHEN k % 7 > 1 THEN base - to_milliseconds(k % 5000) ELSE base END, '{DUCK_MILLIS}') AS began,
    strftime(base - to_seconds(CASE WHEN k % 2 = 0 THEN k % 60 ELSE 0 END) - to_milliseconds(k % 1000), '{DUCK_MILLIS}') AS before_parts,
    strftime(CASE WHEN k % 5 <> 0 THEN make_timestamp(k * 1000000 + 500000) ELSE base END, '{DUCK_MILLIS}') AS from_seconds FROM s""")


def _env(s, d):
    names = F.element_at(F.array(*(F.lit(x) for x in ("WB_TEAM", "wb_run", "PLAIN", "wb_"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    value = F.concat("p_brand", F.element_at(F.array(*(F.lit(x) for x in ("", " x  y ", "=1", "/z"))), (F.pmod(F.expr("p_partkey div 4"), F.lit(4)) + 1).cast("int")))
    return V.table(s, d, "part").select("p_partkey", text.env_to_tag(names, value).alias("tag"))


_add("environment_tags", _env, r"""WITH e AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'WB_TEAM' WHEN 1 THEN 'wb_run' WHEN 2 THEN 'PLAIN' ELSE 'wb_' END AS name,
    p_brand || CASE p_partkey // 4 % 4 WHEN 0 THEN '' WHEN 1 THEN ' x  y ' WHEN 2 THEN '=1' ELSE '/z' END AS value FROM part),
    k AS (SELECT *, regexp_replace(lower(name), '^wb_', '') AS key, regexp_replace(regexp_replace(regexp_replace(lower(value), '[^a-z0-9_\-.#]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS body FROM e)
    SELECT p_partkey, CASE WHEN key <> '' AND body <> '' AND NOT regexp_matches(value, '[=,]') AND regexp_full_match(key || '-' || body, '""" + text.TAG_PATTERN.strip("^$") + r"""') THEN key || '-' || body END AS tag FROM k""")


def _chosen(s, d):
    env = F.create_map(F.lit("APP_NAME"), F.col("p_brand"), F.lit("APP_TYPE"), F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_brand")), F.lit("HOME"), F.col("p_type"), F.lit("APPLE"), F.lit("v"))
    picked = text.select_env(env, ["APP_*", " HOME ", "*", ""])
    names = F.array_join(F.array_sort(F.map_keys(text.env_attributes(picked))), ",")
    return V.table(s, d, "part").select("p_partkey", names.alias("names"), F.array_join(text.env_values(picked), "|").alias("vals"))


_add("environment_values", _chosen, """SELECT p_partkey, 'app.name,app.type,home' AS names, array_to_string(list_sort(list_distinct([x FOR x IN [p_brand, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, p_type] IF x <> ''])), '|') AS vals FROM part""")


def _status(s, d):
    words = ["OK", "Error", "cancelled", "", *(w.upper() for w in sorted(ERROR_WORDS)), *sorted(INTERRUPTED_WORDS)]
    word = F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod("o_orderkey", F.lit(len(words))) + 1).cast("int"))
    return _orders(s, d).select("o_orderkey", payload.status_word(word).alias("status"), payload.status_word(word, interruptions=False).alias("plain"))


def _status_sql():
    words = ["OK", "Error", "cancelled", "", *(w.upper() for w in sorted(ERROR_WORDS)), *sorted(INTERRUPTED_WORDS)]
    pick = "lower([" + ", ".join(f"'{w}'" for w in words) + f"][1 + o_orderkey % {len(words)}])"
    bad, stop = (", ".join(f"'{w}'" for w in sorted(x)) for x in (ERROR_WORDS, INTERRUPTED_WORDS))
    return f"""SELECT o_orderkey, CASE WHEN {pick} IN ({bad}) THEN 'errored' WHEN {pick} IN ({stop}) THEN 'interrupted' ELSE 'completed' END AS status,
    CASE WHEN {pick} IN ({bad}) THEN 'errored' ELSE 'completed' END AS plain FROM orders"""


_add("status_words", _status, _status_sql())
