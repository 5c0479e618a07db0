"""Registered queries against their SQL on the smallest tables.

A sample runs by default; ``SPANLOOM_ALL=1`` runs every query (as ``tools/verify.py`` does).
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from verify import compare, connect  # noqa: E402

from spanloom.registry import all_oracles, all_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "usage_by_day", "usage_by_day_bounded", "usage_totals", "top_sessions", "usage_summary", "list_sessions", "vocabulary", "effective_tags", "search_documents", "turns", "filter_turns",
    "copilot_projection", "platform_usage_by_day", "open_interactions", "live_call_spans", "live_interactions", "source_replaced", "elide_middle", "rubric_disagreement", "waste_signatures", "claude_usage_rows", "codex_usage_rows", "cursor_usage_rows", "dedup_messages", "shutdown_mismatch", "export_eligible",
    "tag_log_effective", "transcript_records", "rollout_frames", "cursor_session_tree",
]
NAMES = list(all_queries()) if os.environ.get("SPANLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    note, ok, _ = compare(spark, con, name, all_queries()[name], all_oracles().get(name), SF)
    assert ok or note == "0 rows", note


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
