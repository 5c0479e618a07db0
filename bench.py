"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from spanloom.registry import all_queries
from spanloom.session import local_session

HEADLINE = [
    "dedup_calls", "usage_by_day", "usage_totals", "usage_rollup", "top_sessions", "usage_summary", "token_spikes", "price_calls", "list_sessions", "sessions_with_tags",
    "effective_tags", "tag_inventory", "search_events", "search_documents", "turns", "filter_turns", "sessions_by_turn", "events_with_findings", "rubric_disagreement", "tool_mix", "runs",
    "waste_signatures", "recovery_shape", "pair_tools_by_id", "pair_tools_with_fallback", "subagent_windows", "owning_agent", "claude_usage_rows", "claude_calls", "codex_calls",
    "ordered_usage_match", "current_revisions", "usage_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "spanloom-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
