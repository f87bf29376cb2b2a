"""The views that all metrics read: steps, parts, tool parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import scalars as S

MOST_DAYS = 366


def anchored(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of sessions that still exist."""
    return messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def in_sessions(df: DataFrame, session_id: str | DataFrame | None) -> DataFrame:
    """Of one session, or of a set of ids (a DataFrame with session_id); None or '' keeps all."""
    if isinstance(session_id, DataFrame):
        return df.join(session_id.select("session_id"), "session_id", "left_semi")
    return df.where(F.col("session_id") == session_id) if session_id else df


def since_day(df: DataFrame, as_of_ms: int, days: int) -> DataFrame:
    """The last `days` local days, the one of `as_of_ms` included; one bound that reaches the files."""
    first = F.date_sub(S.local_date(F.lit(as_of_ms)), days - 1)
    return df.where(F.col("time_created") >= S.midnight_ms(first))


def window_before(df: DataFrame, as_of_ms: int, days: int, back: int = 1) -> DataFrame:
    """The window of P7 shifted back by `back` times its days of fixed length; its end is exclusive."""
    first = S.midnight_ms(F.date_sub(S.local_date(F.lit(as_of_ms)), days - 1))
    shift = days * 86_400_000
    return df.where((F.col("time_created") >= first - back * shift) & (F.col("time_created") < first - (back - 1) * shift))


def clamp_days(days: int | None) -> int:
    """1 to 366; 0 for none, not positive or not a number."""
    if days is None or days != days or days <= 0:
        return 0
    return min(int(days), MOST_DAYS)


def steps(messages: DataFrame, sessions: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Assistant messages whose data is a JSON object, of existing sessions, parsed once.

    Token counts without a valid number are 0. `content` is that part of the data as a variant.
    """
    rows = messages.where(F.col("type") == "assistant")
    if since_ms is not None:
        rows = rows.where(F.col("time_created") >= since_ms)
    v = F.col("v")
    rows = anchored(rows, sessions).withColumn("v", F.try_parse_json("data")).where(v.isNotNull()).where(S.kind_of(v) == "OBJECT")
    model, error = S.json_text(v, "$.model.id"), F.try_variant_get(v, "$.error", "variant")
    return rows.select(
        F.col("id").alias("message_id"), "session_id", "seq", F.coalesce("time_created", F.lit(0)).alias("time_created"),
        S.name_or_unknown(S.json_text(v, "$.agent")).alias("agent"), S.name_or_unknown(model).alias("model_id"), model.alias("raw_model_id"),
        S.text_or_empty(S.json_text(v, "$.model.providerID")).alias("provider_id"), S.text_or_empty(S.json_text(v, "$.model.variant")).alias("variant"),
        *(S.json_number(v, f"$.tokens.{path}").alias(name) for name, path in (("input", "input"), ("output", "output"), ("reasoning", "reasoning"), ("cache_read", "cache.read"), ("cache_write", "cache.write"))),
        (error.isNotNull() & ~F.coalesce(F.is_variant_null(error), F.lit(True))).alias("has_error"), S.text_or_empty(S.json_text(v, "$.error.type")).alias("error_type"), F.try_variant_get(v, "$.content", "variant").alias("content"),
    )


def parts(steps_: DataFrame) -> DataFrame:
    """S3: one row for each element of a step's `content`, with its place; none where that is no array.

    A message is parsed once, for its step; parts are taken from that variant, and bring the step's agent along.
    """
    rows = steps_.where(S.kind_of(F.col("content")) == "ARRAY").select("message_id", "session_id", "seq", "time_created", "agent", "content")
    rows = rows.lateralJoin(steps_.sparkSession.tvf.variant_explode(F.col("content").outer()))
    return rows.select("message_id", "session_id", "seq", "time_created", "agent", "pos", F.col("value").alias("p"), S.json_text("value", "$.type").alias("kind"))


def tool_parts(parts_: DataFrame) -> DataFrame:
    """Tool parts that have a name, with their status."""
    p = F.col("p")
    rows = parts_.where(F.col("kind") == "tool").withColumn("tool", S.tool_name(S.json_text(p, "$.name"), S.json_text(p, "$.tool")))
    return rows.where(F.col("tool").isNotNull()).withColumn("status", S.tool_status(p))


def session_exists(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """S8 for many ids: those of (id) that there are."""
    return ids.join(sessions.select("id"), "id", "left_semi")


def session_messages(messages: DataFrame, sessions: DataFrame, session_id: str | DataFrame) -> DataFrame:
    """All messages of a session, with their data as a variant (null where it is no JSON), in order."""
    rows = in_sessions(anchored(messages, sessions), session_id)
    return rows.withColumn("v", F.try_parse_json("data")).orderBy("session_id", "seq", "time_created", "id")


def days_spine(steps_or_other: DataFrame, as_of_ms: int, days: int) -> DataFrame:
    """(day): the last `days` local days, oldest first, whether or not there are rows."""
    today = S.local_date(F.lit(as_of_ms))
    return steps_or_other.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))


def of_kind(column: Column, *kinds: str) -> Column:
    """P10."""
    return column.isin(*kinds)
