"""Tools: health, errors over time, tokens by tool, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.views import clamp_days, days_spine, since_day

HIGH_ERROR = 0.10
FILE_TOOLS = {"read": "reads", "edit": "edits", "write": "writes"}


def tool_health(tool_parts: DataFrame) -> DataFrame:
    """By tool: completed, error, running, total (which has other statuses too), error_rate; by total, then name."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    sums = tool_parts.groupBy("tool").agg(is_("completed"), is_("error"), is_("running"), F.count("*").alias("total"))
    return sums.withColumn("error_rate", F.col("error") / F.col("total")).orderBy(F.desc("total"), "tool")


def tool_error_trend(tool_parts: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """Each of the last local days: tool_calls, errors, error_rate (0 without calls)."""
    days = clamp_days(days)
    if not days:
        return tool_parts.sparkSession.createDataFrame([], "day date, tool_calls long, errors long, error_rate double")
    sums = since_day(tool_parts, as_of_ms, days).groupBy(S.local_date(F.col("time_created")).alias("day")).agg(F.count("*").alias("tool_calls"), F.count_if(F.col("status") == "error").alias("errors"))
    dense = days_spine(tool_parts, as_of_ms, days).join(sums, "day", "left").na.fill(0)
    return dense.withColumn("error_rate", F.when(F.col("tool_calls") > 0, F.col("errors") / F.col("tool_calls")).otherwise(0.0)).orderBy("day")


def part_weight():
    """F18 over the text a tool part puts into the context: its input and output."""
    text_in, text_out = F.coalesce(S.json_text("p", "$.state.input"), F.lit("")), S.tool_output_text(F.col("p"))
    return S.estimate_tokens(F.length(text_in) + F.length(text_out), F.octet_length(text_in) + F.octet_length(text_out))


def tool_tokens(steps: DataFrame, tool_parts: DataFrame) -> DataFrame:
    """A step's tokens (F7, whole) shared out to its distinct tools by weight, alike where no tool has any.

    Shares are rounded down; what is left goes, one each, to the largest remainders, then names, so that the
    tokens of a step are kept to the unit. Steps without tools count for the tool ''. By tokens, then name.
    """
    weights = tool_parts.groupBy("message_id", "tool").agg(F.sum(part_weight()).alias("weight"))
    step = Window.partitionBy("message_id")  # a step's distinct tools, a handful
    used = steps.select("message_id", F.floor(S.usage_tokens(F.col("input"), F.col("output"), F.col("cache_read"))).alias("step_tokens"))
    rows = used.join(weights, "message_id", "left").withColumn("tool", F.coalesce("tool", F.lit("")))
    rows = rows.withColumn("all", F.coalesce(F.sum("weight").over(step), F.lit(0.0))).withColumn("n", F.count("*").over(step))
    exact = F.col("step_tokens") * F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(F.lit(1.0) / F.col("n"))
    rows = rows.withColumn("exact", exact).withColumn("whole", F.floor("exact"))
    left = F.col("step_tokens") - F.sum("whole").over(step)
    place = F.row_number().over(step.orderBy(F.desc(F.col("exact") - F.col("whole")), "tool"))
    rows = rows.withColumn("left", left).withColumn("place", place).withColumn("part", F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0))
    sums = rows.groupBy("tool").agg(F.sum("part").alias("tokens"), F.count("*").alias("steps"))
    total = F.sum("tokens").over(Window.partitionBy())  # over a row for each tool
    return sums.select("tool", "tokens", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("share"), "steps").orderBy(F.desc("tokens"), "tool")


def top_token_tools(tokens: DataFrame, most: int = 10) -> DataFrame:
    """T3 over A9: named tools with tokens."""
    return tokens.where("tokens > 0 and tool != ''").orderBy(F.desc("tokens"), "tool").limit(most)


def top_tools(tool_parts: DataFrame, most: int = 10) -> DataFrame:
    """The tools called most, with their share of all calls, error rate, the error rate of all calls, and a flag from 10 % errors on."""
    sums = tool_parts.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"))
    all_ = Window.partitionBy()  # over a row for each tool
    rate = F.col("errors") / F.col("calls")
    out = sums.select("tool", "calls", (F.col("calls") / F.sum("calls").over(all_)).alias("share"), rate.alias("error_rate"), (F.sum("errors").over(all_) / F.sum("calls").over(all_)).alias("global_error_rate"), (rate >= HIGH_ERROR).alias("high_error"))
    return out.orderBy(F.desc("calls"), "tool").limit(most)


def file_activity(parts: DataFrame, limit: int = 20, home: str = "") -> DataFrame:
    """By path (normalised, home redacted): reads, edits, writes, sessions, last_active; totals before the limit; by operations, then path.

    A part counts by its `name`, or by the legacy key only where that is absent; paths that are empty or hold
    JSON don't count.
    """
    p = F.col("p")
    tool = F.coalesce(S.json_text(p, "$.name"), S.json_text(p, "$.tool"))
    path = F.coalesce(*(S.json_text(p, f"$.state.input.{k}") for k in ("path", "filePath", "file_path")))
    rows = parts.where(F.col("kind") == "tool").select("session_id", "time_created", tool.alias("tool"), path.alias("path"))
    rows = rows.where(F.col("tool").isin(*FILE_TOOLS) & F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").rlike(r"^[\[{]"))
    rows = rows.withColumn("path", S.redacted_home(S.normal_path(F.col("path")), home))
    sums = rows.groupBy("path").agg(*(F.count_if(F.col("tool") == t).alias(n) for t, n in FILE_TOOLS.items()), F.count_distinct("session_id").alias("sessions"), F.max("time_created").alias("last_active"), F.count("*").alias("operations"))
    totals = sums.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("operations"), F.lit(0)).alias("total_operations"))
    return sums.crossJoin(totals).orderBy(F.desc("operations"), "path").limit(max(1, min(limit, 100)))  # totals: one row
