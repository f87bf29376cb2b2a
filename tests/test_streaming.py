"""Streams in several micro-batches and runs: results as of a batch, state that goes, snapshots that stay small."""

from __future__ import annotations

import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestat.sources.shared import names_in
from lodestat.streaming import usage as streams
from lodestat.streaming.snapshot import Snapshot

SCHEMA = "session_id string, step_id long, ts timestamp, model_id string, tokens long, tool string, status string, has_error boolean"
START = datetime(2026, 3, 1, tzinfo=UTC)


def step(session, number, minutes, error=False):
    return (session, number, START + timedelta(minutes=minutes), f"m{number % 2}", number, "t", "error" if error else "completed", error)


def put(spark, folder, rows):
    """One file, a micro-batch of its own."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.02)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def days(spark, tmp_path):
    """Twelve days in files of a day each: three sessions a day, one more that goes on for days, one that returns."""
    folder, rows = tmp_path / "steps", []
    for day in range(12):
        some = [step(f"s{day}-{n}", day * 100 + n * 10 + k, day * 1440 + n * 60 + k, k == 2 and n == 1) for n in range(3) for k in range(3)]
        some += [step("long", day * 100 + 90, day * 1440 + 700, day == 11)] if day in (0, 1, 2) else []
        some += [step("back", day * 100 + 95, day * 1440 + 30)] if day in (0, 9) else []
        some += [(None, 1, START, "m", 1, "t", "x", False), ("s0-0", 2, None, "m", 1, "t", "x", False)] if day == 0 else []
        put(spark, folder, some)
        rows += some
    return folder, rows


def by_hand(rows):
    out = {}
    for session, number, ts, *_, error in rows:
        if session is not None and ts is not None:
            n, last = out.get(session, (0, None))
            out[session] = (n + 1, max(last, (ts, number, error)) if last else (ts, number, error))
    return {k: (n, last[1], last[2]) for k, (n, last) in out.items()}


def test_session_status_of_many_batches(spark, days, tmp_path, monkeypatch):
    folder, rows = days
    held, run = [], streams._run

    def watched(*args):
        query = run(*args)
        held.extend(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
        return query

    monkeypatch.setattr(streams, "_run", watched)
    stretches = streams.latest(streams.session_stretches(stream(spark, folder)), ["session_id", "begin"], str(tmp_path / "out"))
    got = {r.session_id: (r.steps, r.last_step, r.last_has_error) for r in streams.session_status(stretches).collect()}
    assert got == by_hand(rows)
    assert stretches.where("session_id = 'back'").count() == 2  # closed, then begun again
    # 38 sessions in all; a session's state goes a day and LATE after its last step (value and timer are rows)
    assert max(held) <= 2 * 17 and len(got) == 38


def test_a_second_run_goes_on(spark, days, tmp_path):
    folder, rows = days
    out = str(tmp_path / "out")
    for _ in range(2):
        status = streams.session_status(streams.latest(streams.session_stretches(stream(spark, folder)), ["session_id", "begin"], out))
        assert {r.session_id: (r.steps, r.last_step, r.last_has_error) for r in status.collect()} == by_hand(rows)
        more = [step("long", 2000, 12 * 1440), step("s11-0", 2001, 12 * 1440 + 1, True)]
        if not any(r[1] == 2000 for r in rows):
            put(spark, folder, more)
            rows = [*rows, *more]
    late = [step("s0-0", 3000, 5)]  # days behind the watermark
    put(spark, folder, late)
    status = streams.session_status(streams.latest(streams.session_stretches(stream(spark, folder)), ["session_id", "begin"], out))
    assert {r.session_id: r.steps for r in status.collect()} == {k: v[0] for k, v in by_hand(rows).items()}


def test_active_sessions_are_told_once_they_are_over(spark, days, tmp_path):
    folder, rows = days
    open_ = streams.latest(streams.active_sessions(stream(spark, folder)), ["session_id", "begin"], str(tmp_path / "open"), "append")
    newest = max(r[2] for r in rows if r[2])
    got = {(r.session_id, r.begin) for r in open_.collect()}
    assert got and all(b.replace(tzinfo=UTC) < newest - timedelta(days=2) for _, b in got)  # the rest is in the state
    every = streams.closed(stream(spark, folder), streams.active_sessions, ["session_id", "begin"], 5 * 60_000, str(tmp_path / "all")).collect()
    assert {(r.session_id, r.begin) for r in every} >= got and sum(r.steps for r in every) == sum(1 for r in rows if r[2])
    assert len(every) == 12 * 3 + 3 + 2 + 1


def test_snapshots_of_the_series(spark, days, tmp_path):
    folder, rows = days
    out = str(tmp_path / "daily")
    got = {(str(r.day), r.model_id): (r.steps, r.tokens) for r in streams.latest(streams.daily_usage(stream(spark, folder)), ["day", "model_id"], out).where("day is not null").collect()}
    want = {}
    for session, number, ts, model, tokens, *_ in rows:
        if ts is not None:
            n, total = want.get((f"{ts:%Y-%m-%d}", model), (0, 0))
            want[f"{ts:%Y-%m-%d}", model] = (n + 1, total + tokens)
    assert got == want
    kept = Snapshot(spark, f"{out}/rows", ["day", "model_id"], streams.daily_usage(stream(spark, folder)).schema)
    assert len(kept.parts()) <= 9 and len(names_in(spark, f"{out}/rows/base")) == 1


def test_merging_a_batch_again_changes_nothing(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string, n long")
    kept = Snapshot(spark, str(tmp_path / "kept"), ["k"], rows((1, "a", 1)).schema, most_deltas=3)
    assert kept.read().collect() == []
    most = 0
    for number in range(20):
        for _ in range(2):  # as after a lost driver
            kept.merge(rows((number % 4, f"b{number}", number), (100 + number, "own", number)), number)
            most = max(most, len(kept.parts()))
    want = {i: 16 + i for i in range(4)} | {100 + n: n for n in range(20)}
    assert {r.k: r.n for r in kept.read().collect()} == want and most <= 3
    kept.merge(rows((0, "old", -1)), 2)  # the base has batch 2
    assert {r.k: r.n for r in kept.read().collect()} == want
    kept.compact()
    kept.compact()
    assert len(kept.parts()) == 1 and {r.k: r.n for r in kept.read().collect()} == want


def test_a_base_that_was_not_finished_is_no_base(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1)], "k long, n long")
    kept = Snapshot(spark, str(tmp_path / "kept"), ["k"], rows.schema)
    kept.merge(rows, 0)
    kept.merge(rows.withColumn("n", F.lit(2).cast("long")), 1)
    os.makedirs(tmp_path / "kept/base/1")  # without the mark of a whole write
    assert [r.n for r in kept.read().collect()] == [2]
    kept.compact()
    assert [r.n for r in kept.read().collect()] == [2] and len(kept.parts()) == 1
