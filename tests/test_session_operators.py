"""Session operators on small tables with dirty rows, by hand."""

from __future__ import annotations

import json
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestat.operators import content, export, graph, replay, search, sessions, tools, usage, views
from lodestat.operators import packs as packing
from lodestat.plans import registry
from lodestat.sources.conform import conform, schema

DAY = 86_400_000
NOW = 1_700_000_000_000  # 2023-11-14 22:13:20 UTC


def step(content_=(), tokens=None, model="m1", **more):
    data = {"agent": "build", "model": {"id": model, "providerID": "p"}, "content": list(content_) if isinstance(content_, (list, tuple)) else content_} | more
    return data | ({"tokens": tokens} if tokens is not None else {})


def tool(name="read", status="completed", output="", path=None, **more):
    return {"type": "tool", "name": name, "state": {"status": status, "input": {"path": path} if path is not None else {}, "metadata": {"output": output}}} | more


def tokens(i=0, o=0, r=0, read=0, write=0):
    return {"input": i, "output": o, "reasoning": r, "cache": {"read": read, "write": write}}


@pytest.fixture(scope="module")
def tables(spark):
    s = [("s1", None, "One", "build", "/a", NOW - DAY, NOW, 100, 25, 0), ("s2", "s1", "=Two", "", None, NOW, NOW, None, None, None), ("s3", "gone", "Three", None, "", NOW, NOW - 5, 1000, 200, 50)]
    sess = spark.createDataFrame([(a, b, c, json.dumps({"id": "m1"}), d, e, f, g, 1.0, h, i, j) for a, b, c, d, e, f, g, h, i, j in s], "id string, parent_id string, title string, model string, agent string, directory string, time_created long, time_updated long, cost double, tokens_input long, tokens_output long, tokens_cache_read long")
    rows = [
        ("m1", "s1", "assistant", 1, NOW - 1000, json.dumps(step([tool(output="abcd"), tool("edit", "error", output="x" * 12), {"type": "text", "text": "Hello needle"}], tokens(100, 5, 2, 50, 7)))),
        ("m2", "s1", "assistant", 2, NOW - 900, json.dumps(step([tool() for _ in range(7)] + [tool("late", 5), {"type": "tool", "tool": "old", "name": ""}, {"type": "tool", "state": {}}], {"input": "12abc", "output": True, "cache": None}, model="m2"))),
        ("m3", "s1", "assistant", 3, NOW - 800, json.dumps(step("not a list", tokens("7"), error=None))),
        ("m4", "s1", "assistant", 4, NOW - 700, "[]"), ("m5", "s1", "assistant", 5, NOW - 600, "junk"), ("m6", "s1", "assistant", 6, NOW - 500, None), ("m7", "s1", "assistant", 7, NOW - 400, '"text"'),
        ("m8", "nowhere", "assistant", 1, NOW, json.dumps(step())), ("m9", "s3", "assistant", 1, NOW - 30 * DAY, json.dumps(step((), tokens(1), model=None, error={"type": "aborted"}))),
        ("u1", "s1", "user", 0, NOW - 2000, json.dumps({"text": "find the Needle"})), ("c1", "s1", "compaction", 8, NOW, json.dumps({"reason": "", "summary": "s"})), ("i1", "s1", "idle", 9, NOW, None),
        ("x1", "s1", "model-switched", 2, NOW - 950, json.dumps({"model": {"id": "m2"}, "previous": {}})),
    ]
    msg = spark.createDataFrame(rows, "id string, session_id string, type string, seq long, time_created long, data string")
    sess, msg = conform(sess, "sessions"), conform(msg, "messages")
    st = views.steps(msg, sess).cache()
    return sess, msg, st, views.parts(st).cache()


def test_conform_adds_casts_and_drops(spark, tables):
    assert tables[0].schema.names == schema("sessions").names
    got = conform(spark.createDataFrame([("1", "x", "y")], "id string, cost string, extra string"), "sessions").first()
    assert got.id == "1" and got.cost is None and "extra" not in got


def test_steps_and_their_coercions(tables):
    got = {r.message_id: r for r in tables[2].collect()}
    assert set(got) == {"m1", "m2", "m3", "m9"}
    assert (got["m2"].input, got["m2"].output, got["m2"].cache_read, got["m3"].input) == (0, 0, 0, 7)
    assert got["m9"].model_id == "unknown" and got["m9"].raw_model_id is None and got["m9"].has_error and not got["m3"].has_error


def test_tool_parts_at_any_place(tables):
    got = [(r.message_id, r.pos, r.tool, r.status) for r in views.tool_parts(tables[3]).collect()]
    assert ("m2", 7, "late", "unknown") in got and ("m2", 8, "old", "unknown") in got
    assert len(got) == 11 and not any(m == "m3" for m, *_ in got)


def test_windows(tables):
    st = tables[2]
    assert {r.message_id for r in views.since_day(st, NOW, 7).collect()} == {"m1", "m2", "m3"}
    assert {r.message_id for r in views.window_before(st, NOW, 30).collect()} == {"m9"}
    assert [views.clamp_days(d) for d in (None, 0, -1, float("nan"), 1000, 5)] == [0, 0, 0, 0, 366, 5]
    trend = usage.daily_trend(st, NOW, 3).collect()
    assert [r.day for r in trend] == [date(2023, 11, 12), date(2023, 11, 13), date(2023, 11, 14)] and [r.steps for r in trend] == [0, 0, 3]
    assert usage.daily_trend(st, NOW, 0).count() == 0 and sessions.hour_heatmap(st.limit(0), NOW).count() == 168


def test_leaderboard_and_comparison(tables):
    board = usage.model_leaderboard(tables[2]).collect()
    assert [r.model_id for r in board] == ["m1", "unknown", "m2"] and board[0].tokens == 162 and board[0].context_median == 7
    week = usage.model_leaderboard_comparison(tables[2], NOW, 30).collect()
    assert {r.model_id: r.previous_tokens for r in week} == {"m1": 0, "m2": 0}


def test_tool_tokens_keep_every_token(tables):
    tp = views.tool_parts(tables[3])
    got = {r.tool: r.tokens for r in tools.tool_tokens(tables[2], tp).collect()}
    assert sum(got.values()) == 163 and got["edit"] > got["read"] and got[""] == 8
    health = {r.tool: (r.total, r.error) for r in tools.tool_health(tp).collect()}
    assert health["read"] == (8, 0) and health["edit"] == (1, 1)
    trend = tools.tool_error_trend(tp, NOW, 2).collect()
    assert sum(r.tool_calls for r in trend) == sum(t for t, _ in health.values())


def test_a_session_is_found_by_id_beyond_the_first_page(spark, tables):
    sess = tables[0].where("id = 's1'")
    late = spark.range(600).select(F.concat(F.lit("x"), F.col("id")).alias("n")).crossJoin(sess).withColumn("id", F.col("n")).drop("n")
    both = late.unionByName(sess.withColumn("id", F.lit("1499")).withColumn("time_updated", F.lit(1).cast("long")))
    got = registry.OPERATORS["s07_session_summary_by_id"](SimpleNamespace(sessions=both, as_of=NOW)).collect()
    assert [(r.id, r.title, r.tokens) for r in got] == [("1499", "One", 125)]


def test_sessions(tables):
    sess, msg, st, _ = tables
    out = sessions.session_outcomes(sess, msg, st).first()
    assert (out.total_sessions, out.sessions_with_steps, out.interrupted) == (3, 2, 1)
    spread = sessions.token_distribution(sess).collect()
    assert sum(r["count"] for r in spread) == 2 and spread[0].low == 0 and spread[-1].high is None and len(spread) == 10
    ledger = {r.session_id: r for r in sessions.token_ledger(sess, st).collect()}
    assert len(ledger) == 3 and ledger["s2"].cache_hit_rate is None and ledger["s1"].prompt_total == 164
    assert sessions.token_ledger_totals(sessions.token_ledger(sess, st)).first().balanced
    assert [r.id for r in sessions.session_list(sess, NOW, "tokens").collect()] == ["s3", "s1", "s2"]
    with pytest.raises(ValueError):
        sessions.filtered(sess, NOW, range_="1y")
    assert sessions.filtered(sess, NOW, day="nonsense").count() == 3 and sessions.filtered(sess, NOW, directory="/none").count() == 0
    rich = {r.session_id: r for r in sessions.session_enrichment(sess, msg, st).collect()}
    assert rich["s1"].model_ids == "m1,m2" and rich["s1"].step_count == 7 and rich["s1"].child_count == 1
    assert sessions.directory_stats(sess, msg).collect()[0].steps == 3
    dist = sessions.distribution(sess.limit(0).withColumn("x", sess.cost), "x")
    assert dist.count() == 0


def test_paging_cost_counts_what_is_shown(spark):
    deep = {"a": [1, {"b": "x: {,"}, [], {}], "c": {}, "d": "\U0001f600\n\""}
    cases = [
        ("user", {"text": "h\U0001f600"}, 3), ("user", {"content": [{"type": "text", "text": "ab"}, {"type": "text", "text": "c"}, {"type": "text", "text": 5}]}, 5), ("user", {"text": 7}, 0),
        ("assistant", {"content": [{"type": "text", "text": "abc"}, {"type": "reasoning", "text": "r" * 150_000}, {"type": "other", "text": "zz"}, "no part", {"type": "text", "text": 12}]}, 3 + 100_200),
        ("assistant", {"content": [{"type": "tool", "state": {"input": deep, "metadata": {"output": "o" * 10}}}]}, len(json.dumps(deep, indent=2, ensure_ascii=False).encode("utf-16-le")) // 2 + 10 + 200),
        ("assistant", {"content": [{"type": "tool", "state": {"input": "q", "content": [{"type": "text", "text": "o" * 250_000}]}}, {"type": "tool", "state": {"input": None}}, {"type": "tool"}]}, 3 + 200_000 + 600),
        ("assistant", {"content": "none"}, 0), ("compaction", {"summary": "s" * 999}, 200), ("compaction", [], 0), ("assistant", None, 0),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(d)) for i, (t, d, _) in enumerate(cases)] + [(99, "user", "junk")], "i int, type string, data string")
    got = {r.i: r.n for r in df.select("i", replay.message_chars(F.col("data"), F.col("type")).alias("n")).collect()}
    assert got == {i: n for i, (_, _, n) in enumerate(cases)} | {99: 0}


def test_packs_of_a_large_session_break_at_the_shown_size(spark):
    reasoning = json.dumps({"content": [{"type": "reasoning", "text": "r" * 149_900}]})
    rows = [("a", f"{i:04}", "assistant", i, NOW, reasoning) for i in range(5)] + [("b", f"{i:04}", "user", i, NOW, json.dumps({"text": "t"})) for i in range(1000)]
    msg = spark.createDataFrame(rows, "session_id string, id string, type string, seq long, time_created long, data string").repartition(3)
    packs = {(r.session_id, r.id): r.pack for r in packing.pack_messages(msg).collect()}
    assert len(packs) == 1005 and [packs["a", f"{i:04}"] for i in range(5)] == [0, 0, 1, 1, 2]
    assert all(packs["b", f"{i:04}"] == i // 200 for i in range(1000))


def test_replay(tables):
    _, msg, st, _ = tables
    changed = {r.message_id: r.model_changed for r in replay.model_changes(st).collect()}
    assert changed == {"m1": False, "m2": True, "m3": True, "m9": False}
    events = replay.session_events(msg, tables[0])
    assert {(r.event_id, r.detail) for r in events.collect()} == {("c1", "unknown"), ("x1", "unknown → m2")}
    pinned = replay.pinned_events(events, st).collect()
    assert [(r.event_id, r.step_id, r.context_before) for r in pinned] == [("x1", "m2", 157)]
    packs = {r.id: r.pack for r in packing.pack_messages(msg, rows=2).where("session_id = 's1'").collect()}
    assert "i1" not in packs and packs["u1"] == packs["m1"] == 0 and packs["m2"] == packs["x1"] == 1
    one_each = [r.pack for r in packing.pack_messages(msg, chars=0).where("session_id = 's1'").collect()]
    assert sorted(one_each)[0] == 0 and max(one_each) >= 5


def test_sessions_in_many_pieces_are_as_in_one(spark, monkeypatch):
    """A session with gaps, unnumbered steps, steps without a model and events beyond the last step, held against plain loops."""
    rows = []
    for i in range(60):
        seq = None if i % 11 == 3 else i * 3 - 20
        rows.append(("s" if i % 5 else "t", f"m{i:03}", seq, NOW + i * 1000 * (i % 4), (None, "a", "", "b")[i * i % 4], i % 7, i % 3, i * 13 % 29, i % 2, 0))
    st = spark.createDataFrame(rows, "session_id string, message_id string, seq long, time_created long, raw_model_id string, output long, reasoning long, input long, cache_read long, cache_write long")
    marks = [("s", f"e{i}", None if i % 4 == 1 else i * 7 - 30, NOW + i * 9000, "compaction" if i % 5 else "system") for i in range(32)]
    events = spark.createDataFrame(marks, "session_id string, event_id string, seq long, time_created long, kind string")

    curve, changes, before, places = {}, {}, {}, {}
    for s in ("s", "t"):
        total, peak, last, context = 0, 0, None, None
        in_order = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[1]))
        places |= {r[1]: i for i, r in enumerate(in_order)}
        for _, m, _, _, model, out, think, given, read, write in in_order:
            before[m], context = context, given + read + write
            total, peak = total + out + think, max(peak, context)
            curve[m] = (total, peak)
            changes[m] = bool(model and last and model != last)
            last = model or last
    pinned = set()
    for s, e, seq, time, kind in marks:
        at = 2 if seq is not None else 3
        after = sorted(((r[at], r[2] if r[2] is not None else -(10**9), r[3], r[1]), r) for r in rows if r[0] == s and r[at] is not None and r[at] >= (seq if at == 2 else time))
        if kind != "system" and after:
            pinned.add((e, after[0][1][1], after[0][1][2], before[after[0][1][1]]))

    for piece, piece_ms in ((4096, 3_600_000), (7, 5000), (1, 1)):
        monkeypatch.setattr(replay, "PIECE", piece)
        monkeypatch.setattr(replay, "PIECE_MS", piece_ms)
        assert {r.message_id: (r.running, r.peak_so_far) for r in replay.token_curve(st).collect()} == curve
        assert {r.message_id: r.model_changed for r in replay.model_changes(st).collect()} == changes
        assert {r.message_id: r.place for r in replay.placed(st).collect()} == places
        assert {(r.event_id, r.step_id, r.step_seq, r.context_before) for r in replay.pinned_events(events, st).collect()} == pinned
    assert replay.token_curve(st.limit(0)).count() == replay.pinned_events(events, st.limit(0)).count() == 0


def test_content_search_and_export(tables):
    sess, msg, st, parts = tables
    comp = {r.category: r.chars for r in content.content_composition(msg, sess, parts).collect()}
    assert set(comp) == set(content.CATEGORIES) and comp["userText"] == 15 and comp["assistantText"] == 12 and comp["toolOutput"] == 16
    hits = search.search_messages(msg, sess, "needle").collect()
    assert [(r.id, r.matches, r.total) for r in hits] == [("m1", 1, 2), ("u1", 1, 2)] and "<mark>Needle</mark>" in hits[1].snippet
    assert search.search_messages(msg, sess, "").count() == 0
    bad = search.search_messages(msg, sess, "(", "regex").collect()
    assert len(bad) == 1 and bad[0].total == 0 and bad[0].error and bad[0].id is None
    assert [r.id for r in search.search_messages(msg, sess, "N[E]+dle", "regex").collect()] == ["m1", "u1"]
    assert [(r.id, r.place) for r in search.session_find(msg, sess, "needle").collect()] == [("u1", 0), ("m1", 1)]
    rows = export.sessions_csv_rows(sess, NOW).collect()
    assert rows[0].title in ("One", "'=Two") and rows[0].__fields__ == list(export.CSV_COLUMNS)
    text = {r.id: r.markdown for r in export.session_markdown(sess, msg).collect()}
    assert text["s1"].index(export.WORDS["user"]) < text["s1"].index("Hello needle") < text["s1"].index("上下文压缩（未知原因）") and text["s2"].endswith("*（本会话无消息记录）*\n")
    report = {r.session_id: r for r in content.session_report(msg, sess).collect()}
    assert (report["s1"].assistant, report["s1"].user, report["s1"].other, report["s2"].assistant) == (7, 1, 0, 0)


def test_parts_parse_a_message_once(tables):
    _, _, st, parts = tables
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "Generate variant_explode" in plan
    joined = usage.agent_tools(views.tool_parts(parts))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in joined


def test_todos_and_prompts(spark):
    t = spark.createDataFrame([("a", "x", "pending", 1), ("a", "y", "in_progress", 5), ("a", "z", "odd", 0), ("b", "q", "completed", 0)], "session_id string, content string, status string, position int")
    assert [(r.content, r.place) for r in sessions.todo_view(t).collect()] == [("y", 1), ("x", 2)]
    s = sessions.todo_stats(t).first()
    assert (s.total, s.completed, s.other, s.completion_rate) == (4, 1, 1, 0.25)
    states = spark.createDataFrame([("a", 1, '{"k":"h0"}'), ("a", 2, '{"k":"h1","l":"h2","m":"h9"}')], "session_id string, epoch_start long, current_values string")
    blobs = spark.createDataFrame([("h0", '"old"'), ("h1", '"line\\nnew"'), ("h2", '""')], "hash string, value string")
    assert [(r.key, r.text) for r in sessions.system_prompt(states, blobs).collect()] == [("k", "line\nnew")]


def test_lineage(spark):
    pairs = [("a", None), ("b", "a"), ("c", "b"), ("self", "self"), ("orphan", "zz"), ("x", "y"), ("y", "x"), ("w", "x"), ("l1", "l3"), ("l2", "l1"), ("l3", "l2")]
    nodes = graph.normalized(spark.createDataFrame(pairs, "id string, parent_id string"))
    trees = graph.forest(nodes)
    cut = {r.id for r in trees.where("cut").collect()}
    # the walk from w enters its cycle at x, whose closing edge is y's; the walk from l1 begins there
    assert cut == {"y", "l2"}
    shape = {r.id: r for r in graph.lineage(trees).collect()}
    assert (shape["c"].depth, shape["a"].subtree_size, shape["y"].subtree_size, shape["w"].depth) == (2, 3, 3, 2)
    summary = graph.lineage_summary(nodes, trees, graph.lineage(trees)).first()
    assert (summary.self_parents, summary.orphans, summary.cycles_cut, summary.max_depth) == (1, 1, 2, 2)
    assert {r.id for r in graph.focus(trees, graph.lineage(trees), "b").collect()} == {"a", "b", "c"}
    picked = graph.lineage_graph(graph.lineage(trees), 4).collect()
    assert [r.id for r in picked] == ["a", "l2", "y", "orphan"] and picked[0].omitted == 7
