"""All registered session-analytics queries and their DuckDB oracles.

A query's name begins with the number that the operator has in the survey's inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import precision
from lodestat.functions import scalars as S
from lodestat.operators import content, export, graph, packs, replay, search, sessions, tools, usage, views
from lodestat.plans import oracles
from lodestat.plans.adapters import Tables
from lodestat.streaming import usage as streams


def _ratios(df: DataFrame) -> DataFrame:
    """Doubles rounded to nine digits, so that engines agree on their text."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _forest(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = graph.normalized(t.sessions)
    return nodes, graph.forest(nodes)


def _steps_of(t: Tables) -> DataFrame:
    return t.steps.drop("content")


OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    "s01_scan_steps": _steps_of,
    "s02_scan_sessions": lambda t: sessions.scan_sessions(t.sessions),
    "s03_unnest_parts": lambda t: t.parts.select("message_id", "session_id", F.col("pos").cast("long").alias("pos"), "kind"),
    "s04_unnest_tool_parts": lambda t: t.tool_parts.select("message_id", F.col("pos").cast("long").alias("pos"), "tool", "status"),
    "s05_session_messages": lambda t: views.session_messages(t.messages, t.sessions, "7").select("id", "session_id", "type", "seq", "time_created"),
    "s06_session_todos": lambda t: sessions.session_todos(t.todos, t.sessions, "7").select("session_id", "content", "status", "position"),
    "s07_session_summary_by_id": lambda t: sessions.session_summary(t.sessions, "1499"),
    "s08_session_exists": lambda t: views.session_exists(t.sessions, t.messages.select(F.col("session_id").alias("id")).distinct()),
    "k01_sessions_csv": lambda t: export.sessions_csv_rows(t.sessions, t.as_of),
    "k02_session_markdown": lambda t: export.session_markdown(t.sessions, t.messages, sessions.system_prompt(t.instruction_state, t.instruction_blob)),
    "k03_session_report": lambda t: content.session_report(t.messages, t.sessions, sessions.system_prompt(t.instruction_state, t.instruction_blob)),
    "p02_anchored_messages": lambda t: views.anchored(t.messages, t.sessions).select("id", "session_id", "type"),
    "p03_session_scope": lambda t: views.in_sessions(t.steps, "7").select("message_id", "session_id", "seq"),
    "p04_directory_filter": lambda t: sessions.filtered(t.sessions, t.as_of, directory="/n/NATION_2/BUILDING").select("id", "directory"),
    "p05_range_filter": lambda t: sessions.filtered(t.sessions, 788_918_400_000 + 1400 * 3_600_000, range_="30d").select("id", "time_updated"),
    "p06_day_filter": lambda t: sessions.filtered(t.sessions, t.as_of, day="1995-01-11").select("id", "time_updated"),
    "p07_window": lambda t: views.since_day(t.steps, t.as_of, 30).select("message_id", "time_created"),
    "p08_previous_window": lambda t: views.window_before(t.steps, t.as_of, 30).select("message_id", "time_created"),
    "p14_model_drill_down": lambda t: sessions.of_model(sessions.session_enrichment(t.sessions, t.messages, t.steps), "2-HIGH").select("session_id", "model_ids"),
    "p15_visible_messages": lambda t: replay.visible(t.messages).groupBy("type").agg(F.count("*").alias("n")),
    "f05_step_rates": lambda t: t.steps.select("message_id", S.hit_rate(F.col("cache_read"), F.col("input")).alias("hit_rate"), S.strict_hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_write")).alias("strict_hit_rate"), S.usage_tokens(F.col("input"), F.col("output"), F.col("cache_read")).alias("usage_tokens"), S.context_tokens(F.col("input"), F.col("cache_read"), F.col("cache_write")).alias("context_tokens")),
    "f09_local_times": lambda t: t.steps.select("message_id", S.local_date_key(F.col("time_created")).alias("day_key"), S.local_weekday(F.col("time_created")).alias("weekday"), S.local_hour(F.col("time_created")).alias("hour")),
    "f11_last_segment": lambda t: t.sessions.select("id", S.last_segment(F.col("directory")).alias("segment")),
    "f13_redacted_paths": lambda t: t.sessions.select("id", S.redacted_home(S.normal_path(F.col("directory")), "/n/NATION_2").alias("path")),
    "f18_estimate_tokens": lambda t: content.estimated_tokens(t.raw("documents"), "source"),
    "f32_redact_documents": lambda t: content.redact_messages(t.raw("documents"), "doc_id").select("doc_id", "hits", F.sha2("redacted", 256).alias("redacted_sha256")),
    "f33_csv_fields": lambda t: t.raw("documents").select("doc_id", F.sha2(S.csv_field(F.col("text")), 256).alias("field_sha256")),
    "f34_download_names": lambda t: t.sessions.select("id", S.download_name(F.col("time_created"), F.concat(F.lit(" a/b:\t"), "title", F.lit("  <"), F.coalesce("agent", F.lit("")), F.lit("> and some more words, so that it is cut. .")), "md").alias("name")),
    "f29_markdown_texts": lambda t: t.raw("documents").select("doc_id", *(F.sha2(f(F.col("text")), 256).alias(n) for n, f in (("escaped", S.md_escape), ("quoted", S.md_quote), ("line", S.one_line))), F.sha2(S.md_fence(F.regexp_replace("text", "[aeiou]", "`"), "json"), 256).alias("fenced"), S.local_minute(F.col("n_chars") * 86_399_000, "-").alias("minute"), S.thousands(F.col("n_chars") * 1000 - 2_000_000).alias("thousands"), S.plain_number(F.col("n_chars") / 8).alias("number")),
    "f30_cut_texts": lambda t: t.raw("documents").select("doc_id", F.sha2(S.cut_notice(F.col("text")), 256).alias("notice"), F.sha2(S.cut_tool_output(F.col("text"), 1000), 256).alias("output")),
    "f36_figures": lambda t: precision.figures(precision.tagged(usage.deltas(usage.model_leaderboard_comparison(t.steps, t.as_of, 30)).select("model_id", "tokens", "previous_tokens", "relative_delta", (F.col("tokens") * 2).alias("guess")))),
    "f35_relative_delta": lambda t: usage.deltas(usage.model_leaderboard_comparison(t.steps, t.as_of, 30)).select("model_id", "provider_id", "variant", "tokens", "previous_tokens", "relative_delta"),
    "f38_wall_durations": lambda t: t.sessions.select("id", S.wall_duration_ms(F.col("time_created"), F.col("time_updated")).alias("duration_ms")),
    "a01_overview": lambda t: usage.overview(t.steps, t.sessions, t.as_of),
    "a02_daily_trend": lambda t: usage.daily_trend(t.steps, t.as_of, 30),
    "a03_daily_trend_by_model": lambda t: usage.daily_trend_by_model(t.steps, t.as_of, 30),
    "a04_model_leaderboard": lambda t: usage.model_leaderboard(t.steps),
    "a05_model_comparison": lambda t: usage.model_leaderboard_comparison(t.steps, t.as_of, 30).select("model_id", "provider_id", "variant", "tokens", "previous_tokens"),
    "a06_agent_stats": lambda t: usage.agent_stats(t.steps, t.tool_parts, t.sessions),
    "a07_tool_health": lambda t: tools.tool_health(t.tool_parts),
    "a08_tool_error_trend": lambda t: tools.tool_error_trend(t.tool_parts, t.as_of, 30),
    "a09_tool_tokens": lambda t: tools.tool_tokens(t.steps, t.tool_parts),
    "a10_hour_heatmap": lambda t: sessions.hour_heatmap(t.steps, t.as_of, 90),
    "a11_session_survival": lambda t: sessions.session_survival(t.sessions),
    "a11_idle_outcomes": lambda t: sessions.idle_outcomes(t.sessions),
    "a12_compaction_by_reason": lambda t: sessions.compaction_by_reason(sessions.compactions(t.messages, t.sessions)),
    "a13_compaction_daily": lambda t: sessions.compaction_daily(sessions.compactions(t.messages, t.sessions), t.as_of),
    "a14_compaction_top_sessions": lambda t: sessions.compaction_top_sessions(sessions.compactions(t.messages, t.sessions)),
    "a15_directory_stats": lambda t: sessions.directory_stats(t.sessions, t.messages, 50),
    "a17_token_distribution": lambda t: sessions.token_distribution(t.sessions),
    "a18_step_distribution": lambda t: sessions.step_distribution(t.messages, t.sessions),
    "a19_duration_distribution": lambda t: sessions.duration_distribution(t.sessions),
    "a20_child_share": lambda t: sessions.child_share(t.sessions),
    "a21_top_child_trees": lambda t: sessions.top_child_trees(t.sessions),
    "a22_session_outcomes": lambda t: sessions.session_outcomes(t.sessions, t.messages, t.steps),
    "a23_outcome_error_types": lambda t: sessions.outcome_error_types(t.steps),
    "a24_recent_interrupted": lambda t: sessions.recent_interrupted(t.sessions, t.steps),
    "a25_token_ledger": lambda t: sessions.token_ledger(t.sessions, t.steps),
    "a26_token_ledger_totals": lambda t: sessions.token_ledger_totals(sessions.token_ledger(t.sessions, t.steps)),
    "a27_content_composition": lambda t: content.content_composition(t.messages, t.sessions, t.parts),
    "a28_file_activity": lambda t: tools.file_activity(t.parts, 100, "/home/u"),
    "a29_todo_stats": lambda t: sessions.todo_stats(t.todos),
    "a30_top_tools": lambda t: tools.top_tools(t.tool_parts),
    "a31_stacked_models": lambda t: usage.stacked_models(t.steps, t.as_of, 30, 3),
    "a32_token_funnel": lambda t: usage.token_funnel(t.steps, t.as_of),
    "a33_overview_extension": lambda t: usage.overview_extension(t.steps, t.as_of),
    "a34_calendar_levels": lambda t: usage.calendar_levels(t.steps, t.as_of),
    "a35_replay_summary": lambda t: replay.replay_summary(t.steps),
    "a36_percentile_tier": lambda t: sessions.percentile_tier(t.sessions),
    "a37_session_enrichment": lambda t: sessions.session_enrichment(t.sessions, t.messages, t.steps),
    "a38_strict_hit_rate": lambda t: sessions.session_strict_hit_rate(t.sessions),
    "a39_cache_support": lambda t: usage.model_cache_support(usage.model_leaderboard(t.steps)),
    "a40_trend_pivot": lambda t: usage.trend_pivot(usage.daily_trend_by_model(t.steps, t.as_of, 30)),
    "j08_system_prompt": lambda t: sessions.system_prompt(t.instruction_state, t.instruction_blob),
    "j09_pinned_events": lambda t: replay.pinned_events(replay.session_events(t.messages, t.sessions), t.steps),
    "w01_last_steps": lambda t: sessions.last_steps(t.steps),
    "w03_token_curve": lambda t: replay.token_curve(t.steps),
    "w04_peak_context": lambda t: replay.peak_context(t.steps),
    "w05_model_changes": lambda t: replay.model_changes(t.steps),
    "w06_turn_costs": lambda t: replay.turn_costs(t.steps),
    "w08_pack_messages": lambda t: packs.pack_messages(t.messages),
    "w08_small_packs": lambda t: packs.pack_messages(t.messages, rows=5, chars=700, width=16),
    "w09_session_events": lambda t: replay.session_events(t.messages, t.sessions),
    "t01_session_list": lambda t: sessions.session_list(t.sessions, t.as_of, "tokens", "desc", 100, 5),
    "t03_top_token_tools": lambda t: tools.top_token_tools(tools.tool_tokens(t.steps, t.tool_parts)),
    "t05_todo_view": lambda t: sessions.todo_view(t.todos),
    "t06_preferred_tools": lambda t: usage.preferred_tools(t.tool_parts).withColumn("place", F.col("place").cast("long")),
    "x01_search_messages": lambda t: search.search_messages(t.messages, t.sessions, "urgent"),
    "x01_search_inputs": lambda t: search.search_messages(t.messages, t.sessions, r'\{\s+"PATH": "/srv/1\d"', "regex"),
    "x01_indexed_search": lambda t: search.search_indexed(t.messages, t.sessions, "urgent"),
    "x02_session_find": lambda t: search.session_find(t.messages, t.sessions, "note 1").withColumn("place", F.col("place").cast("long")),
    "g01_lineage_normalized": lambda t: graph.normalized(t.sessions),
    "g02_lineage_forest": lambda t: _forest(t)[1],
    "g03_lineage": lambda t: graph.lineage(_forest(t)[1]),
    "g03_lineage_summary": lambda t: (lambda n, f: graph.lineage_summary(n, f, graph.lineage(f)))(*_forest(t)),
    "g04_lineage_focus": lambda t: (lambda f: graph.focus(f, graph.lineage(f), "7"))(_forest(t)[1]),
    "g05_lineage_graph": lambda t: graph.lineage_graph(graph.lineage(_forest(t)[1]), 100),
    "g05_lineage_edges": lambda t: graph.lineage_edges(graph.lineage_graph(graph.lineage(_forest(t)[1]), 100)),
}


STREAMS: dict[str, Callable[[Tables], DataFrame]] = {
    "r01_stream_daily_usage": lambda t: streams.latest(streams.daily_usage(t.event_stream), ["day", "model_id"]),
    "r02_stream_hourly_steps": lambda t: streams.latest(streams.hourly_steps(t.event_stream), ["hour_start"]),
    "r03_stream_tool_errors": lambda t: streams.latest(streams.tool_errors(t.event_stream), ["day"]),
    "r04_stream_session_status": lambda t: streams.session_status(streams.latest(streams.session_stretches(t.event_stream), ["session_id", "begin"])),
    "r05_stream_active_sessions": lambda t: streams.closed(t.event_stream, streams.active_sessions, ["session_id", "begin"], 5 * 60_000),
}


def over(tables: Tables, name: str) -> DataFrame:
    """A registered batch query over session tables that are there."""
    return _ratios(OPERATORS[name](tables))


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _ratios(build(Tables(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, build in (OPERATORS | STREAMS).items()}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
