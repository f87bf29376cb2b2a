"""Sessions: lists, filters, outcomes, distributions, ledgers, lineage sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.ranks import nearest_ranks
from lodestat.operators.views import anchored, days_spine, since_day
from lodestat.sources.shared import cut_lineage

DAY_MS = 86_400_000
RANGES = {"7d": 7, "30d": 30, "90d": 90}
SORTS = ("time_updated", "time_created", "tokens", "cost", "title")
SHORT_MS = 300_000
TIERS = {"p50": 50, "p90": 90, "p99": 99}
TOLERANCE = 0.02


# --- lists ------------------------------------------------------------------------------------------------
def filtered(sessions: DataFrame, as_of_ms: int, directory: str = "", range_: str = "", day: str = "") -> DataFrame:
    """Of a directory, updated in a range (unknown ones raise), updated on a local day (malformed ones keep all)."""
    if directory:
        sessions = sessions.where(F.col("directory") == directory)
    if range_:
        if range_ not in RANGES:
            raise ValueError(f"unknown range: {range_}")
        sessions = sessions.where(F.col("time_updated") >= as_of_ms - RANGES[range_] * DAY_MS)
    on = F.to_date(F.lit(day), "yyyy-MM-dd") if _is_day(day) else None
    if on is not None:
        sessions = sessions.where((F.col("time_updated") >= S.midnight_ms(on)) & (F.col("time_updated") < S.midnight_ms(F.date_add(on, 1))))
    return sessions


def _is_day(day: str) -> bool:
    from datetime import date

    try:
        return len(day) == 10 and bool(date.fromisoformat(day))
    except ValueError:
        return False


def session_tokens() -> Column:
    """Input + output + read, a missing one as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("tokens_input", "tokens_output", "tokens_cache_read")), F.lit(0))


def session_list(sessions: DataFrame, as_of_ms: int, sort: str = "time_updated", order: str = "desc", limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
    """A page of sessions by a listed key (else time_updated), then id; only exactly 'asc' turns the order."""
    key = F.col("tokens" if sort == "tokens" else sort if sort in SORTS else "time_updated")
    rows = filtered(sessions, as_of_ms, **filters).withColumn("tokens", session_tokens())
    return _listed(rows.orderBy(key.asc() if order == "asc" else key.desc(), "id").offset(max(offset, 0)).limit(max(1, min(limit, 500))))


def scan_sessions(sessions: DataFrame) -> DataFrame:
    """The list's eleven columns of every session."""
    return _listed(sessions.withColumn("tokens", session_tokens()))


def session_summary(sessions: DataFrame, id_: str) -> DataFrame:
    """The list's columns of one session, wherever in the list it is."""
    return _listed(sessions.where(F.col("id") == id_).withColumn("tokens", session_tokens()))


def _listed(rows: DataFrame) -> DataFrame:
    model = F.try_parse_json("model")
    return rows.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), S.name_or_unknown(S.json_text(model, "$.id")).alias("model_id"), S.text_or_empty(S.json_text(model, "$.providerID")).alias("provider_id"),
        S.name_or_unknown(F.col("agent")).alias("agent"), "directory", "time_created", "time_updated", S.wall_duration_ms(F.col("time_created"), F.col("time_updated")).alias("duration_ms"), "tokens", "cost",
    )


def session_enrichment(sessions: DataFrame, messages: DataFrame, steps: DataFrame) -> DataFrame:
    """Every session with its models (sorted), raw step count, reasoning and cache-write tokens, parent, and its direct children's number and tokens."""
    models = steps.where(F.col("raw_model_id").isNotNull()).select("session_id", "model_id")
    launch = S.json_text(F.try_parse_json("model"), "$.id")
    launched = sessions.select(F.col("id").alias("session_id"), launch.alias("model_id")).where("model_id is not null and model_id not in ('', 'unknown')")
    models = models.unionByName(launched).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("model_ids"))
    raw = messages.where(F.col("type") == "assistant").groupBy("session_id").agg(F.count("*").alias("step_count"))
    children = sessions.where("parent_id is not null").groupBy(F.col("parent_id").alias("session_id")).agg(F.count("*").alias("child_count"), F.sum(session_tokens()).alias("child_tokens"))
    out = sessions.select(F.col("id").alias("session_id"), "parent_id", "tokens_reasoning", "tokens_cache_write")
    for side in (models, raw, children):
        out = out.join(side, "session_id", "left")
    return out.na.fill("", ["model_ids"]).na.fill(0, ["step_count", "child_count", "child_tokens"])


def of_model(enriched: DataFrame, model: str) -> DataFrame:
    """Sessions that used a model."""
    return enriched.where(F.array_contains(F.split("model_ids", ","), model))


def session_strict_hit_rate(sessions: DataFrame) -> DataFrame:
    """Null where any of the three columns is missing, or all are 0."""
    return sessions.select("id", S.strict_hit_rate(F.col("tokens_cache_read"), F.col("tokens_input"), F.col("tokens_cache_write"), None).alias("strict_hit_rate"))


# --- behaviour --------------------------------------------------------------------------------------------
def hour_heatmap(steps: DataFrame, as_of_ms: int, days: int = 90) -> DataFrame:
    """A10: all 168 hours of the week (0 is Sunday) with the steps of the last local days in them."""
    rows = since_day(steps, as_of_ms, days) if days > 0 else steps.limit(0)
    t = F.col("time_created")
    sums = rows.where(t > 0).groupBy(S.local_weekday(t).cast("long").alias("weekday"), S.local_hour(t).cast("long").alias("hour")).agg(F.count("*").alias("steps"))
    grid = steps.sparkSession.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return grid.join(sums, ["weekday", "hour"], "left").na.fill(0).orderBy("weekday", "hour")


def session_survival(sessions: DataFrame) -> DataFrame:
    """Sessions, median duration in seconds (nearest rank, halves up), and the share of those under five minutes."""
    d = F.greatest(F.coalesce(F.col("time_updated") - F.col("time_created"), F.lit(0)), F.lit(0))
    counts = cut_lineage(sessions.groupBy(d.alias("d")).agg(F.count("*").alias("n")))
    n = F.coalesce(F.sum("n"), F.lit(0))
    sums = counts.agg(n.alias("total"), F.when(n > 0, F.sum(F.when(F.col("d") < SHORT_MS, F.col("n")).otherwise(0)) / n).otherwise(0.0).alias("short_share"))
    median = F.coalesce(F.floor(F.col("median") / 1000 + 0.5), F.lit(0)).alias("median_seconds")
    return sums.crossJoin(nearest_ranks(counts, [], "d", "n", {"median": 50})).select("total", median, "short_share")  # one row each


def idle_outcomes(sessions: DataFrame) -> DataFrame:
    """Sessions by idle outcome, `none` for a missing one."""
    return sessions.groupBy(F.coalesce(F.nullif("idle_outcome", F.lit("")), F.lit("none")).alias("outcome")).agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "outcome")


def compactions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Compaction messages with their reason."""
    reason = S.name_or_unknown(S.json_text(F.try_parse_json("data"), "$.reason"))
    return anchored(messages.where(F.col("type") == "compaction"), sessions).select("id", "session_id", "seq", "time_created", reason.alias("reason"))


def compaction_by_reason(compactions_: DataFrame) -> DataFrame:
    """A12, with the total in each row."""
    sums = compactions_.groupBy("reason").agg(F.count("*").alias("n"))
    return sums.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "reason")  # over a row for each reason


def compaction_daily(compactions_: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """Each of the last local days."""
    sums = since_day(compactions_, as_of_ms, days).groupBy(S.local_date(F.col("time_created")).alias("day")).agg(F.count("*").alias("n"))
    return days_spine(compactions_, as_of_ms, days).join(sums, "day", "left").na.fill(0).orderBy("day")


def compaction_top_sessions(compactions_: DataFrame, most: int = 10) -> DataFrame:
    """A14."""
    return compactions_.groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(most)


def directory_stats(sessions: DataFrame, messages: DataFrame, limit: int = 10) -> DataFrame:
    """By directory: sessions, steps (object rows, counted by session before the join), tokens, last_active; totals before the limit; by steps, sessions, name."""
    v = F.try_parse_json("data")
    per = messages.where((F.col("type") == "assistant") & (S.kind_of(v) == "OBJECT")).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("steps"))
    rows = sessions.where("directory is not null and directory != ''").join(per, "id", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = rows.groupBy("directory").agg(F.count("*").alias("sessions"), z("steps"), z("tokens_input"), z("tokens_output"), z("tokens_cache_read"), F.max("time_updated").alias("last_active"))
    totals = sums.agg(F.count("*").alias("total_directories"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("total_sessions"))
    named = sums.withColumn("name", S.last_segment(F.col("directory"))).crossJoin(totals)  # totals: one row
    return named.orderBy(F.desc("steps"), F.desc("sessions"), "directory").limit(max(1, min(limit, 50)))


# --- distributions ----------------------------------------------------------------------------------------
def _sig3(value: float) -> float:
    scale = 10.0 ** (math.floor(math.log10(value)) - 2)
    return math.floor(value / scale + 0.5) * scale


def bucket_edges(largest: float) -> list[float]:
    """0, then 10 ** (k / 2) to three digits for k = 0 .. 2 D + 1 with D = max(1, ceil(log10(largest)))."""
    digits = max(1, math.ceil(math.log10(largest)))
    return [0.0] + [_sig3(10 ** (k / 2)) for k in range(2 * digits + 1)]


def distribution(values: DataFrame, column: str) -> DataFrame:
    """Positive values in buckets [from, to), the last one open; with n, p50, p90, p99 (nearest rank), mean and max in each row; no rows without values."""
    rows = values.select(F.col(column).cast("double").alias("x")).where((F.col("x") > 0) & (F.col("x") < float("inf")))
    counts = cut_lineage(rows.groupBy("x").agg(F.count("*").alias("k")))
    mean = F.sum(F.col("x") * F.col("k")) / F.sum("k")
    whole = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), mean.alias("mean"), F.max("x").alias("largest"))
    whole = whole.crossJoin(nearest_ranks(counts, [], "x", "k", TIERS)).select("n", *TIERS, "mean", "largest")  # one row each
    edges = bucket_edges(counts.agg(F.max("x")).first()[0] or 1.0)
    place = sum((F.when(F.col("x") >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))
    sums = counts.groupBy(place.alias("bucket")).agg(F.sum("k").alias("count"))
    spine = values.sparkSession.createDataFrame([(i, e, edges[i + 1] if i + 1 < len(edges) else None) for i, e in enumerate(edges)], "bucket int, low double, high double")
    return spine.join(sums, "bucket", "left").na.fill(0, ["count"]).crossJoin(whole).where("n > 0").orderBy("bucket")  # whole: one row


def token_distribution(sessions: DataFrame) -> DataFrame:
    """A17."""
    return distribution(sessions.withColumn("x", session_tokens()), "x")


def step_distribution(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant rows of a session, whatever their data."""
    return distribution(anchored(messages.where(F.col("type") == "assistant"), sessions).groupBy("session_id").agg(F.count("*").alias("x")), "x")


def duration_distribution(sessions: DataFrame) -> DataFrame:
    """Milliseconds, of sessions that lasted."""
    return distribution(sessions.withColumn("x", S.wall_duration_ms(F.col("time_created"), F.col("time_updated"))), "x")


def percentile_tier(sessions: DataFrame) -> DataFrame:
    """The highest percentile of all sessions' tokens (A17) that a session reaches."""
    rows = sessions.select("id", session_tokens().cast("double").alias("x"))
    counts = cut_lineage(rows.where("x > 0").groupBy("x").agg(F.count("*").alias("k")))
    marks = nearest_ranks(counts, [], "x", "k", TIERS)
    tier = F.when(F.col("x") >= F.col("p99"), "p99").when(F.col("x") >= F.col("p90"), "p90").when(F.col("x") >= F.col("p50"), "p50").otherwise("below")
    return rows.crossJoin(marks).select("id", F.col("x").alias("tokens"), tier.alias("tier"))  # marks: one row


# --- parents ----------------------------------------------------------------------------------------------
def child_share(sessions: DataFrame) -> DataFrame:
    """Sessions with and without a parent, and their tokens."""
    child, t = F.col("parent_id").isNotNull(), session_tokens()
    s = sessions.agg(F.count("*").alias("total"), F.count_if(child).alias("children"), F.count_if(~child).alias("roots"), F.coalesce(F.sum(F.when(child, t)), F.lit(0)).alias("child_tokens"), F.coalesce(F.sum(F.when(~child, t)), F.lit(0)).alias("root_tokens"))
    return s.withColumn("child_token_share", F.when(F.col("child_tokens") + F.col("root_tokens") > 0, F.col("child_tokens") / (F.col("child_tokens") + F.col("root_tokens"))).otherwise(0.0))


def top_child_trees(sessions: DataFrame, most: int = 5) -> DataFrame:
    """Parents by the tokens of their direct children, with title and agent where the parent exists."""
    top = sessions.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"), F.sum(session_tokens()).alias("child_tokens")).orderBy(F.desc("child_tokens"), "parent_id").limit(most)
    return top.join(sessions.select(F.col("id").alias("parent_id"), "title", "agent"), "parent_id", "left").na.fill("", ["title", "agent"]).orderBy(F.desc("child_tokens"), "parent_id")


# --- outcomes ---------------------------------------------------------------------------------------------
def last_steps(steps: DataFrame) -> DataFrame:
    """The last object step of each session by seq, time and id; one aggregate, no sort."""
    row = F.struct("seq", "time_created", "message_id", "has_error", "error_type")
    return steps.groupBy("session_id").agg(F.max_by(row, F.struct("seq", "time_created", "message_id")).alias("r")).select("session_id", "r.*")


def session_outcomes(sessions: DataFrame, messages: DataFrame, steps: DataFrame) -> DataFrame:
    """Sessions, those with an assistant row, those whose last step has an error, and the share of these."""
    with_steps = anchored(messages.where(F.col("type") == "assistant"), sessions).agg(F.count_distinct("session_id").alias("sessions_with_steps"))
    broken = last_steps(steps).agg(F.count_if("has_error").alias("interrupted"))
    out = sessions.agg(F.count("*").alias("total_sessions")).crossJoin(with_steps).crossJoin(broken)  # one row each
    return out.withColumn("interrupted_share", F.when(F.col("sessions_with_steps") > 0, F.col("interrupted") / F.col("sessions_with_steps")).otherwise(0.0))


def outcome_error_types(steps: DataFrame) -> DataFrame:
    """Types of last errors that have one."""
    return last_steps(steps).where("has_error and error_type != ''").groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def recent_interrupted(sessions: DataFrame, steps: DataFrame, most: int = 5) -> DataFrame:
    """A24."""
    rows = last_steps(steps).where("has_error").join(sessions.select(F.col("id").alias("session_id"), "title", "time_updated"), "session_id")
    return rows.select("session_id", "title", "time_updated", "error_type").orderBy(F.desc("time_updated"), "session_id").limit(most)


# --- ledger -----------------------------------------------------------------------------------------------
def token_ledger(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """Every session: its steps' tokens by kind, beside its own columns; by prompt tokens, then id."""
    sums = steps.groupBy("session_id").agg(F.count("*").alias("messages"), *(F.sum(c).alias(n) for c, n in (("input", "prompt_input"), ("cache_read", "prompt_read"), ("cache_write", "prompt_write"), ("output", "output"), ("reasoning", "reasoning"))))
    rows = sessions.select(F.col("id").alias("session_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens_input", "tokens_cache_read", "tokens_cache_write", "tokens_output"))).join(sums, "session_id", "left").na.fill(0)
    total = F.col("prompt_input") + F.col("prompt_read") + F.col("prompt_write")
    return rows.withColumn("prompt_total", total).withColumn("cache_hit_rate", F.when(total > 0, F.col("prompt_read") / total)).orderBy(F.desc("prompt_total"), "session_id")


def token_ledger_totals(ledger: DataFrame) -> DataFrame:
    """Sums, anomalies, and how far the sessions' own columns are from the steps' sums."""
    kinds = ("prompt_input", "prompt_read", "prompt_write", "output", "reasoning", "tokens_input", "tokens_cache_read", "tokens_cache_write", "tokens_output")
    negative = F.lit(False)
    for k in kinds:
        negative = negative | (F.col(k) < 0)
    own = F.sum(F.col("tokens_input") + F.col("tokens_cache_read") + F.col("tokens_cache_write"))
    z = lambda c: F.coalesce(c, F.lit(0))
    s = ledger.agg(F.count("*").alias("sessions"), z(F.sum("messages")).alias("messages"), z(F.sum("prompt_total")).alias("prompt_total"), z(F.sum("output")).alias("output"), F.count_if(negative).alias("negative_components"), F.count_if(F.col("prompt_read") > F.col("prompt_total")).alias("cache_read_exceeds_prompt"), (z(own) - z(F.sum("prompt_total"))).alias("residual"))
    ratio = F.when(F.col("prompt_total") != 0, F.col("residual") / F.col("prompt_total"))
    return s.withColumn("balanced", (F.col("negative_components") == 0) & (F.col("cache_read_exceeds_prompt") == 0)).withColumn("residual_ratio", ratio).withColumn("within_tolerance", F.coalesce(F.abs(ratio) <= TOLERANCE, F.lit(True)))


# --- todos ------------------------------------------------------------------------------------------------
def todo_stats(todos: DataFrame) -> DataFrame:
    """Todos by status; others are only in the total."""
    n = F.count("*")
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    s = todos.agg(n.alias("total"), is_("completed"), is_("pending"), is_("in_progress"))
    return s.withColumn("other", F.col("total") - F.col("completed") - F.col("pending") - F.col("in_progress")).withColumn("completion_rate", F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(0.0))


def session_todos(todos: DataFrame, sessions: DataFrame, session_id: str) -> DataFrame:
    """S6."""
    return anchored(todos, sessions).where(F.col("session_id") == session_id).orderBy("position")


def todo_view(todos: DataFrame, page_size: int = 4) -> DataFrame:
    """Of sessions with open work, todos by status (in progress, pending, completed), then position, in pages from 0."""
    rank = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "pending", 1).when(F.col("status") == "completed", 2)
    own = Window.partitionBy("session_id")
    shown = todos.withColumn("rank", rank).where("rank is not null").withColumn("open", F.max((F.col("rank") < 2).cast("int")).over(own)).where("open = 1")
    place = F.row_number().over(own.orderBy("rank", "position", "content"))
    return shown.select("session_id", "content", "status", "position", place.alias("place"), F.floor((place - 1) / page_size).cast("int").alias("page")).orderBy("session_id", "place")


def system_prompt(states: DataFrame, blobs: DataFrame) -> DataFrame:
    """The latest instruction state of each session, each key with its text; keys without a known, non-empty text are left out."""
    latest = states.groupBy("session_id").agg(F.max_by("current_values", "epoch_start").alias("v"))
    keyed = latest.select("session_id", F.explode(F.from_json("v", "map<string,string>")).alias("key", "hash"))
    text = F.coalesce(F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"], F.col("value"))
    return keyed.join(blobs.select("hash", text.alias("text")), "hash").where("text != ''").select("session_id", "key", "text").orderBy("session_id", "key")
