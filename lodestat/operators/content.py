"""What messages hold: characters by category, message types, credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.views import anchored

# Categories of content, and types of messages that a report counts.
CATEGORIES = ("assistantText", "toolOutput", "toolInput", "reasoning", "userText", "other")
TYPES = ("user", "assistant", "system", "model-switched", "compaction")


def content_composition(messages: DataFrame, sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """Characters by category, all six always there, with share, total, sessions that hold any, and estimated tokens of tools; by characters, then name.

    A part without a type counts nowhere. One pass over the parts and one over user messages, each summed
    before they meet.
    """
    p, kind = F.col("p"), F.col("kind")
    text = F.coalesce(S.json_text(p, "$.text"), F.lit(""))
    taken = F.coalesce(S.json_text(p, "$.state.input"), F.lit(""))
    given = S.tool_output_text(p)
    pick = lambda k, t: F.when(kind == k, t)
    other = F.when(kind.isNotNull() & ~kind.isin("text", "reasoning", "tool"), F.to_json(p))
    named = [("assistantText", pick("text", text)), ("reasoning", pick("reasoning", text)), ("toolInput", pick("tool", taken)), ("toolOutput", pick("tool", given)), ("other", other)]
    long = parts.select("session_id", F.explode(F.array(*(F.struct(F.lit(n).alias("category"), c.alias("text")) for n, c in named))).alias("x")).select("session_id", "x.category", "x.text")
    user = anchored(messages.where(F.col("type") == "user"), sessions).select("session_id", F.lit("userText").alias("category"), S.message_text(F.try_parse_json("data")).alias("text"))
    rows = long.unionByName(user).where("text != ''")
    sums = rows.groupBy("category", "session_id").agg(F.sum(F.length("text")).alias("c"), F.sum(F.octet_length("text")).alias("b")).groupBy("category").agg(F.sum("c").alias("chars"), F.sum("b").alias("octets"), F.count("*").alias("sessions"))
    spine = parts.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    out = spine.join(sums, "category", "left").na.fill(0)
    all_ = Window.partitionBy()  # over six rows
    total = F.sum("chars").over(all_)
    estimate = F.when(F.col("category").isin("toolInput", "toolOutput"), S.estimate_tokens(F.col("chars"), F.col("octets"))).otherwise(0.0)
    return out.select("category", "chars", F.when(total > 0, F.col("chars") / total).otherwise(0.0).alias("share"), total.alias("total"), "sessions", estimate.alias("tool_estimated_tokens")).orderBy(F.desc("chars"), "category")


def session_report(messages: DataFrame, sessions: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """K3: every session's messages by category (unknown types are other; idle and synthetic aren't counted), and the length of its system prompt."""
    rows = anchored(messages.where(~F.col("type").isin("idle", "synthetic")), sessions)
    is_ = lambda t: F.count_if(F.col("type") == t).alias(t.replace("-", "_"))
    sums = rows.groupBy("session_id").agg(*(is_(t) for t in TYPES), F.count_if(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))).alias("other"))
    out = sessions.select(F.col("id").alias("session_id")).join(sums, "session_id", "left")
    if prompts is None:
        return out.na.fill(0).withColumn("prompt_chars", F.lit(0).cast("long")).orderBy("session_id")
    lengths = prompts.groupBy("session_id").agg(F.sum(F.length("text")).alias("prompt_chars"))
    return out.join(lengths, "session_id", "left").na.fill(0).orderBy("session_id")


def redact_messages(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """F32 at scale: texts with their secrets shortened, and how many there were."""
    return texts.select(key, S.redacted(F.coalesce(F.col(text), F.lit(""))).alias("redacted"), S.credential_hits(F.coalesce(F.col(text), F.lit(""))).alias("hits"))


def estimated_tokens(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    """F18 summed: characters, bytes and estimated tokens of texts by group."""
    t = F.coalesce(F.col(text), F.lit(""))
    sums = texts.groupBy(group).agg(F.sum(F.length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("octets"))
    return sums.withColumn("tokens", S.estimate_tokens(F.col("chars"), F.col("octets")))
