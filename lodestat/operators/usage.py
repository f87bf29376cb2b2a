"""Usage over time, models and agents (A1-A6, A31-A36, A39, A40). Every order is total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.ranks import nearest_ranks
from lodestat.operators.views import clamp_days, days_spine, since_day, window_before
from lodestat.sources.shared import cut_lineage

TOP_MODELS = 7
CENTS_PER_MILLION = 0.13


def _usage():
    return S.usage_tokens(F.col("input"), F.col("output"), F.col("cache_read"))


def overview(steps: DataFrame, sessions: DataFrame, as_of_ms: int) -> DataFrame:
    """A1: one row of today's and all tokens, today's hit rate, steps, sessions and cost."""
    today = F.col("time_created") >= S.midnight_ms(S.local_date(F.lit(as_of_ms)))
    only = lambda c: F.coalesce(F.sum(F.when(today, c)), F.lit(0.0))
    used = steps.agg(
        only(_usage()).alias("today_tokens"), F.coalesce(F.sum(_usage()), F.lit(0.0)).alias("total_tokens"),
        S.hit_rate(only(F.col("cache_read")), only(F.col("input"))).alias("today_hit_rate"), F.count("*").alias("step_count"),
    )
    return used.crossJoin(sessions.agg(F.count("*").alias("session_count"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost")))  # one row each


def daily_trend(steps: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """A2: each of the last local days, with zeros: steps, input, cache_read, output, hit_rate."""
    days = clamp_days(days)
    if not days:
        return steps.sparkSession.createDataFrame([], "day date, steps long, input double, cache_read double, output double, hit_rate double")
    sums = since_day(steps, as_of_ms, days).groupBy(S.local_date(F.col("time_created")).alias("day")).agg(F.count("*").alias("steps"), *(F.sum(c).alias(c) for c in ("input", "cache_read", "output")))
    dense = days_spine(steps, as_of_ms, days).join(sums, "day", "left").na.fill(0)
    return dense.withColumn("hit_rate", S.hit_rate(F.col("cache_read"), F.col("input"))).orderBy("day")


def daily_trend_by_model(steps: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """A3: each day with each model of the window; models by tokens of the window, then id (model_rank from 1)."""
    days = clamp_days(days)
    rows = since_day(steps, as_of_ms, max(days, 1)).withColumn("day", S.local_date(F.col("time_created"))).where(F.lit(days > 0))
    sums = rows.groupBy("day", "model_id").agg(F.count("*").alias("steps"), F.sum(_usage()).alias("tokens"))
    models = sums.groupBy("model_id").agg(F.sum("tokens").alias("window_tokens")).withColumn("model_rank", F.row_number().over(Window.orderBy(F.desc("window_tokens"), "model_id")))
    spine = days_spine(steps, as_of_ms, max(days, 1)).crossJoin(models)  # days x models, what the result has
    return spine.join(sums, ["day", "model_id"], "left").na.fill(0, ["steps", "tokens"]).orderBy("day", "model_rank")


def model_leaderboard(steps: DataFrame, as_of_ms: int | None = None, days: int | None = None) -> DataFrame:
    """A4: by (model, provider, variant): steps, tokens, share, hit rate, output a step, context average, median and p95 (nearest rank), reasoning share, first and last seen; by tokens, then key."""
    rows = since_day(steps, as_of_ms, clamp_days(days)) if days and clamp_days(days) else steps
    rows = rows.withColumn("context", S.context_tokens(F.col("input"), F.col("cache_read"), F.col("cache_write")))
    key = ["model_id", "provider_id", "variant"]
    counts = cut_lineage(rows.groupBy(*key, "context").agg(
        F.count("*").alias("n"), F.sum(_usage()).alias("tokens"), *(F.sum(c).alias(c) for c in ("input", "cache_read", "output", "reasoning")),
        F.min("time_created").alias("first_seen"), F.max("time_created").alias("last_seen"),
    ))
    sums = counts.groupBy(*key).agg(
        F.sum("n").alias("steps"), F.sum("tokens").alias("tokens"), F.sum("input").alias("i"), F.sum("cache_read").alias("r"), F.sum("output").alias("o"), F.sum("reasoning").alias("why"),
        (F.sum(F.col("context") * F.col("n")) / F.sum(F.when(F.col("context").isNotNull(), F.col("n")))).alias("context_avg"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    ranks = nearest_ranks(counts, key, "context", "n", {"context_median": 50, "context_p95": 95}).withColumnsRenamed({k: f"_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    sums = sums.join(ranks, same, "left").drop(*(f"_{k}" for k in key))
    total = F.sum("tokens").over(Window.partitionBy())  # over a row for each model
    return sums.select(
        *key, "steps", "tokens", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("token_share"), S.hit_rate(F.col("r"), F.col("i")).alias("hit_rate"),
        (F.col("o") / F.col("steps")).alias("output_per_step"), "context_avg", "context_median", "context_p95",
        F.when(F.col("o") + F.col("why") > 0, F.col("why") / (F.col("o") + F.col("why"))).otherwise(0.0).alias("reasoning_share"), "first_seen", "last_seen",
    ).orderBy(F.desc("tokens"), *key)


def model_leaderboard_comparison(steps: DataFrame, as_of_ms: int, days: int | None = None) -> DataFrame:
    """A5: A4 with the tokens of the window before, 0 where the model had none; models of that window only are left out."""
    key, days = ["model_id", "provider_id", "variant"], clamp_days(days)
    now = model_leaderboard(steps, as_of_ms, days or None)
    if not days:
        return now.withColumn("previous_tokens", F.lit(0.0))
    before = window_before(steps, as_of_ms, days).groupBy(*key).agg(F.sum(_usage()).alias("previous_tokens"))
    return now.join(before, key, "left").na.fill(0, ["previous_tokens"]).orderBy(F.desc("tokens"), *key)


def agent_stats(steps: DataFrame, tool_parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """By agent: sessions that name it or have a step of it, steps, tokens, tools (count by name, most used first)."""
    member = sessions.where(F.col("agent").isNotNull() & (F.col("agent") != "")).select("agent", F.col("id").alias("session_id"))
    counts = member.unionByName(steps.select("agent", "session_id")).distinct().groupBy("agent").agg(F.count("*").alias("sessions"))
    used = steps.groupBy("agent").agg(F.count("*").alias("steps"), F.sum(_usage()).alias("tokens"))
    tools = agent_tools(tool_parts).groupBy("agent").agg(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("order"), "tool", "calls"))).alias("t"))
    listed = F.array_join(F.transform("t", lambda x: F.concat_ws("=", x["tool"], x["calls"])), ",")
    out = counts.join(used, "agent", "full_outer").join(tools, "agent", "left")
    return out.select("agent", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "steps", "tokens")), F.coalesce(listed, F.lit("")).alias("tools")).orderBy(F.desc("tokens"), "agent")


def agent_tools(tool_parts: DataFrame) -> DataFrame:
    """(agent, tool, calls): the long form of A6's counts."""
    return tool_parts.groupBy("agent", "tool").agg(F.count("*").alias("calls"))


def preferred_tools(tool_parts: DataFrame, most: int = 3) -> DataFrame:
    """The tools each agent calls most."""
    place = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("calls"), "tool"))
    return agent_tools(tool_parts).withColumn("place", place).where(F.col("place") <= most)


def stacked_models(steps: DataFrame, as_of_ms: int, days: int = 30, most: int = TOP_MODELS) -> DataFrame:
    """Day by day, the window's top models, and `other` for what they leave of the day (never below 0)."""
    trend = daily_trend_by_model(steps, as_of_ms, days)
    named = trend.where(F.col("model_rank") <= most).select("day", F.col("model_id").alias("series"), F.col("model_rank").alias("place"), "tokens")
    sums = trend.groupBy("day").agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("model_rank") <= most, F.col("tokens")).otherwise(0.0)).alias("top"))
    other = sums.select("day", F.lit("other").alias("series"), F.lit(most + 1).alias("place"), F.greatest(F.col("all") - F.col("top"), F.lit(0.0)).alias("tokens"))
    return named.unionByName(other).orderBy("day", "place")


def token_funnel(steps: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """Over the window: supply (read + input), cached, paid, output."""
    t = daily_trend(steps, as_of_ms, days)
    return t.agg(F.sum(F.col("cache_read") + F.col("input")).alias("supply"), F.sum("cache_read").alias("cached"), F.sum("input").alias("paid"), F.sum("output").alias("output"))


def overview_extension(steps: DataFrame, as_of_ms: int) -> DataFrame:
    """today's input and output, yesterday's hit rate and steps, fourteen days of tokens, and an estimate of today's cost."""
    t = daily_trend(steps, as_of_ms, 14).withColumn("tokens", S.usage_tokens(F.col("input"), F.col("output"), F.col("cache_read")))
    today = S.local_date(F.lit(as_of_ms))
    on = lambda c, back: F.max(F.when(F.col("day") == F.date_sub(today, back), F.col(c)))
    series = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "tokens"))), lambda x: x["tokens"].cast("long")), ",")
    return t.agg(on("input", 0).alias("today_input"), on("output", 0).alias("today_output"), on("hit_rate", 1).alias("yesterday_hit_rate"), on("steps", 1).alias("yesterday_steps"), series.alias("sparkline"), F.round(on("tokens", 0) / 1e6 * CENTS_PER_MILLION, 2).alias("cost_estimate"))


def calendar_levels(steps: DataFrame, as_of_ms: int, days: int = 366) -> DataFrame:
    """Each day's tokens and level: how many of the values at index floor(q n) of the n active days, q = .25, .5, .75, .9, it reaches; 0 on a day without tokens."""
    t = daily_trend(steps, as_of_ms, days).select("day", S.usage_tokens(F.col("input"), F.col("output"), F.col("cache_read")).alias("tokens"))
    active = t.where("tokens > 0").withColumn("i", F.row_number().over(Window.orderBy("tokens")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))  # one row a day
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col("tokens")))
    marks = active.agg(F.count("*").alias("active_days"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("year_tokens"), *(at(q).alias(f"t{i}") for i, q in enumerate((0.25, 0.5, 0.75, 0.9))))
    level = sum((F.when((F.col("tokens") > 0) & (F.col("tokens") >= F.col(f"t{i}")), 1).otherwise(0) for i in range(4)), F.lit(0))
    return t.crossJoin(marks).select("day", "tokens", level.alias("level"), "active_days", "year_tokens").orderBy("day")  # marks: one row


def model_cache_support(leaderboard: DataFrame) -> DataFrame:
    """What a hit rate tells: no cache reported, nothing to hit, high, or normal."""
    flag = F.when((F.col("hit_rate") == 0) & (F.col("tokens") > 0), "not_reported").when(F.col("hit_rate") == 0, "zero_denominator").when(F.col("hit_rate") >= 0.9, "high").otherwise("normal")
    return leaderboard.select("model_id", "provider_id", "variant", "tokens", "hit_rate", flag.alias("cache_support"))


def trend_pivot(trend: DataFrame) -> DataFrame:
    """A3 as one dense series per model: (model_id, model_rank, series) with days joined by commas, oldest first."""
    listed = F.array_sort(F.collect_list(F.struct("day", "tokens")))
    return trend.groupBy("model_id", "model_rank").agg(F.array_join(F.transform(listed, lambda x: F.coalesce(x["tokens"], F.lit(0)).cast("long")), ",").alias("series")).orderBy("model_rank")


def deltas(now: DataFrame, key: str = "model_id") -> DataFrame:
    """F35 over A5: relative change of tokens; null without a base or with a base of 0."""
    return now.withColumn("relative_delta", S.relative_delta(F.col("tokens"), F.col("previous_tokens")))
