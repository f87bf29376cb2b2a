"""Some registered queries against their DuckDB SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from lodestat.plans import registry

SF = Path("/root/testdata/sf0.001")
NAMES = ("s01_scan_steps", "s02_scan_sessions", "p02_anchored_messages", "p03_session_scope", "p07_window", "f05_step_rates", "f09_local_times", "f13_redacted_paths", "f33_csv_fields", "f38_wall_durations", "s04_unnest_tool_parts", "a03_daily_trend_by_model", "a04_model_leaderboard", "a06_agent_stats", "a09_tool_tokens", "a15_directory_stats", "a18_step_distribution", "a25_token_ledger", "a27_content_composition", "a28_file_activity", "a34_calendar_levels", "j09_pinned_events", "t01_session_list", "w03_token_curve", "w05_model_changes", "x01_search_messages", "x01_search_inputs", "x02_session_find", "s07_session_summary_by_id", "p04_directory_filter", "p15_visible_messages", "f34_download_names", "j08_system_prompt", "k03_session_report", "g02_lineage_forest", "r01_stream_daily_usage")


def normal(value):
    return repr(float(f"{value:.12g}")) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for table in SF.glob("*.parquet"):
        con.sql(f"create view {table.stem} as select * from read_parquet('{table}')")
    mine = registry.queries()[name](spark, str(SF))
    columns = sorted(mine.columns)
    found = con.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted([normal(row[i]) for i in at] for row in found.fetchall())
    assert sorted([normal(v) for v in row] for row in mine.select(*columns).collect()) == want


def test_every_oracle_names_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
